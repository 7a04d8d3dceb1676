"""SimHash fingerprints of whole texts and their near-duplicate classes, by tiled exact comparison of fingerprints or, within what they find, of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_digest

from loamworks.llm.components import connected_components
from loamworks.llm.shared import materialize, spanning_edges

#: Fingerprints in a tile, about.
TILE = 1024
#: Tiles of a cell that meet another cell's, or its own, in one task: a cell of many tiles is several tasks' work.
GROUP = 8
SEED = 42
_AT_ONCE, _RUN = 1 << 15, 128
#: Texts in a tile of a family, about, and their shingles.
FAMILY_TILE, FAMILY_SHINGLES = 512, 1_000_000
#: Pairs of tiles that a Python worker is given at once: some 80 KB each of fingerprints, up to 16 MB each of texts' shingles.
PAIRS, FAMILY_PAIRS = 256, 2


def shingles_of(text: str | None, width: int) -> list[bytes]:
    """The word shingles of a text in order, repeats included, see ``fingerprint``."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return [joined]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    return [joined[a:b] for a, b in zip((ends - sizes).tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: str | None, width: int = 3, words: int = 1) -> tuple[bytes, int]:
    """The SimHash of 64 bits a word of the word shingles of a text, big-endian, and the number of shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width`` words joined by spaces, repeats included.
    Fewer words: the whole sequence is the one shingle. None (null, empty or blank text): zeros. A bit is set if it is in over half of the
    shingles' hashes: XXH64 with seed 42, and for further words the seeds that follow.
    """
    return _bits(shingles_of(text, width), words)


def _bits(pieces: list[bytes], words: int) -> tuple[bytes, int]:
    if not pieces:
        return bytes(8 * words), 0
    out = []
    for seed in range(SEED, SEED + words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(pieces), _AT_ONCE):
            raw = b"".join(map(xxh64_digest, pieces[i : i + _AT_ONCE], repeat(seed)))
            raw += bytes(-len(raw) % (8 * _RUN))  # whole runs: counts in a run fit a byte, which adds fast
            runs = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, _RUN, 64)
            ones += np.add.reduce(runs, axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(pieces)).tobytes())
    return b"".join(out), len(pieces)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """(id_col, fp binary, shingles bigint) for every row, repeats and null ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width, words) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "fp", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp binary, shingles bigint")


def set_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, words: int) -> DataFrame:
    """(id_col, own, fp binary, shingles bigint, same binary) for every row: fingerprint and number of the distinct shingles.

    own: a hash of the text; same: a hash of 128 bits that texts of the same set of shingles share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (sorted(set(shingles_of(x.as_py(), width))) for x in batch.column(2))
            found = [(*_bits(x, words), xxh3_128_digest(b"\n".join(x))) for x in sets]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[id_col, "own", "fp", "shingles", "same"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.md5(text_col).alias("own"), text_col).mapInArrow(run, f"`{id_col}` {kind}, own string, fp binary, shingles bigint, same binary")


def radius_of(similarity: float, bits: int, deviations: float = 2.0) -> int:
    """Differing bits that pairs of texts of one length and that Jaccard similarity of shingles stay within, all but those beyond the deviations.

    The share of differing bits is the angle between the texts' shingle counts over pi, whose cosine is 2 s / (1 + s).
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * share + deviations * sqrt(bits * share * (1 - share)))


def search_radius(similarity: float, bits: int, deviations: float = 4.0) -> int:
    """Differing bits within which texts are worth comparing: 4 deviations beyond what is expected of sets just as similar, of any size.

    Small sets differ by more than the angle says, for ties: with 4 shingles in 5, 3 bits in 16.
    """
    share = max(acos(2 * similarity / (1 + similarity)) / pi, *(_small_share(n, x, similarity) for n in range(1, 65) for x in range(n + 1)))
    return ceil(bits * share + deviations * sqrt(bits * share * (1 - share)))


def _small_share(common: int, left: int, similarity: float) -> float:
    """Share of differing bits of two sets with so many common shingles, ``left`` only in the one and as many in the other as the similarity allows."""
    right = int(common / similarity + 1e-9) - common - left
    if right < 0:
        return 0.0
    over = lambda n, k, size: sum(comb(n, j) for j in range(n + 1) if 2 * (k + j) > size) / 2**n
    total = 0.0
    for k in range(common + 1):
        a, b = over(left, k, common + left), over(right, k, common + right)
        total += comb(common, k) / 2**common * (a + b - 2 * a * b)
    return total


def _matrix(values: pa.Array) -> np.ndarray:
    """Equally long binaries as rows of unsigned 64-bit numbers."""
    flat = b"".join(values.to_pylist())
    return np.frombuffer(flat, np.uint64).reshape(len(values), -1)


def _cells(fps: np.ndarray, shingles: np.ndarray, radius: int, similarity: float | None) -> np.ndarray:
    """A number for each fingerprint, such that those within the radius differ by one of ``_steps``.

    Small radius: the population counts of the four quarters, in 5 bits each (a quarter has 16 bits). Else the band of the whole population count, bands
    being wider than the radius. Given a similarity, the band of the number of shingles too: counts of similar texts are no further apart
    than the similarity as a factor.
    """
    if radius <= 3 and fps.shape[1] == 1:
        parts = np.bitwise_count(fps.view(np.uint16)).astype(np.int64)
        return parts @ (32 ** np.arange(parts.shape[1]))
    band = np.bitwise_count(fps).sum(1, dtype=np.int64) // (radius + 1)
    size = 0 if similarity is None else np.floor(np.log(np.maximum(shingles, 1)) / log(1 / similarity)).astype(np.int64)
    return (size + 1) * 1024 + band


def _steps(radius: int, words: int) -> list[int]:
    """Differences of the cells of fingerprints that may be within the radius, each pair of cells from one side only."""
    if radius <= 3 and words == 1:
        span = range(-radius, radius + 1)
        near = [d for d in np.array(np.meshgrid(*[span] * 4)).T.reshape(-1, 4).tolist() if sum(map(abs, d)) <= radius and tuple(d) >= (0, 0, 0, 0)]
        return [sum(x * 32**k for k, x in enumerate(d[::-1])) for d in near]
    return [0, 1, 1023, 1024, 1025]


def links(nodes: DataFrame, radius: int = 2, words: int = 1, similarity: float | None = None, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints that connect all that differ in at most ``radius`` bits.

    nodes: node bigint, fp binary, shingles bigint. Tiles hold fingerprints of one cell, see ``_cells``: pairs of tiles whose population counts differ
    beyond the radius are never built. The others are compared in full with exclusive-or and bit counts, and each gives a spanning forest of
    its links, so a large group of near copies yields no more edges than rows. The work is quadratic within neighbouring cells.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _cells(_matrix(batch.column(1)), batch.column(2).to_numpy(), radius, similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int64())], names=["node", "fp", "cell"])

    distinct = nodes.select("node", "fp", "shingles").mapInArrow(place, "node bigint, fp binary, cell bigint")
    # a row a cell: at most 17^4 cells of quarters, or a few hundred of bands
    sizes = distinct.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("slots"))
    placed = distinct.join(F.broadcast(sizes), "cell").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    tiles = materialize(placed.groupBy("cell", "slot").agg(F.collect_list("node").alias("ids"), F.collect_list("fp").alias("fps")).withColumn("part", F.floor(F.col("slot") / GROUP)))
    pairs = tile_pairs(tiles, sizes, _steps(radius, words)).select("left_ids", "left_fps", "ids", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for i in range(batch.num_rows):
                ids, other = (batch.column(k)[i].values.to_numpy() for k in (0, 2))
                x, y = (_matrix(batch.column(k)[i].values) for k in (1, 3))
                p, q = [], []
                for lo in range(0, len(x), 128):
                    away = np.zeros((len(x[lo : lo + 128]), len(y)), np.uint16)
                    for k in range(words):
                        away += np.bitwise_count(x[lo : lo + 128, None, k] ^ y[None, :, k])
                    a, b = np.nonzero(away <= radius)
                    p.append(a + lo)
                    q.append(b)
                p, q = np.concatenate(p), np.concatenate(q)
                if not len(p):
                    continue
                nodes_, inverse = np.unique(np.concatenate([ids, other]), return_inverse=True)
                a, b = spanning_edges(inverse[p], inverse[len(x) + q], len(nodes_))
                if len(a):
                    out.append(np.stack([nodes_[a], nodes_[b]]))
            found = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def tile_pairs(tiles: DataFrame, sizes: DataFrame, steps: list[int]) -> DataFrame:
    """Each two tiles of one cell, and of cells a step apart, once: left_ids, left_fps, ids, fps.

    tiles: (cell, slot, part, ids, fps); sizes: (cell, slots), a row a cell. They are joined on the cell and on parts of ``GROUP`` tiles of it, so a cell with a third of all tiles is
    dealt to as many tasks as it has parts; a tile is sent to each part that it meets.
    """
    left = tiles.select(
        F.col("cell").alias("own"), F.col("slot").alias("own_slot"), F.col("part").alias("own_part"), F.col("ids").alias("left_ids"), F.col("fps").alias("left_fps"), F.explode(F.array(*[F.col("cell") + d for d in steps])).alias("cell")
    )
    met = left.join(F.broadcast(sizes), "cell")
    first = F.when(F.col("own") == F.col("cell"), F.col("own_part")).otherwise(F.lit(0).cast("bigint"))
    sent = met.withColumn("part", F.explode(F.sequence(first, F.floor((F.col("slots") - 1) / GROUP)))).drop("slots")
    return sent.join(tiles, ["cell", "part"]).filter("own <> cell OR own_slot <= slot")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int | None = None, words: int = 4, similarity: float = 0.8) -> DataFrame:
    """(id_col, fp binary, component_id) for every row of ``docs``.

    With a ``radius``, fingerprints of ``words`` times 64 bits link within that many differing bits. By default, texts link whose sets of shingles
    have a Jaccard similarity of ``similarity`` or more, exactly; the fingerprints, then of distinct shingles, find what to compare, see ``search_radius``. component_id
    is the least id reachable over links, the row's own id included. Texts that are null, empty or blank have the same empty set and link. Rows with a null
    id link too, but only non-null ids name a class: a class of null ids alone has a null component_id. Other columns of ``docs`` are not read. No
    rows give no rows.
    """
    if radius is None:
        return _similar(docs, id_col, text_col, width, words, similarity)
    fps = materialize(fingerprints(docs, id_col, text_col, width, words))
    # equal fingerprints are one node, whose number of shingles is the least among them
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.min("shingles").alias("shingles")).withColumn("node", F.monotonically_increasing_id()))
    roots = connected_components(materialize(links(nodes, radius, words), PAIRS))
    named = nodes.select("node", "fp", "least").join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(materialize(named.join(names, "root").select("fp", "component_id")), "fp").select(id_col, "fp", "component_id")


def _similar(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, similarity: float) -> DataFrame:
    """``classes`` by exact similarity: fingerprints only find the families of texts that are compared."""
    fps = materialize(set_fingerprints(docs, id_col, text_col, width, words))
    # texts of the same set are one node
    nodes = fps.groupBy("same").agg(
        F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.min(id_col).alias("least"), F.min(F.struct(F.col(id_col).alias("id"), "own")).alias("one")
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    radius = search_radius(similarity, 64 * words)
    families = connected_components(materialize(links(nodes, radius, words, similarity), PAIRS)).withColumnRenamed("root", "family")
    members = materialize(nodes.select("node", "fp", "shingles", "one").join(families, "node"))
    found = verified_links(docs.select(F.col(id_col).alias("id"), F.md5(text_col).alias("own"), F.col(text_col).alias("text")), members, width, similarity, radius)
    roots = connected_components(materialize(found, FAMILY_PAIRS))
    named = nodes.select("node", "same", "least").join(roots, "node", "left").select("same", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(materialize(named.join(names, "root").select("same", "component_id")), "same").select(id_col, "fp", "component_id")


def verified_links(texts: DataFrame, members: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """Edges (a, b) that connect, within each family, all nodes whose fingerprints differ in at most ``radius`` bits and whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    texts: (id, own, text), own a hash of the text; members: (node, fp, shingles, one (id, own), family). Sets are sorted XXH64 hashes of shingles. A family
    is dealt into tiles, each two of which are a row. Texts are compared only where their fingerprints are candidates, so what a family merely chains together
    costs an exclusive-or a pair; nodes that are linked already are not compared again, and a row gives a spanning forest of its links, so that a large group
    of near copies yields no more edges than nodes.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), width).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "family", "fp", "hashes"])

    wanted = members.select("node", "family", "fp", F.col("one.id").alias("id_"), F.col("one.own").alias("own_"))
    # own is null where the text is
    found = texts.join(wanted, texts.id.eqNullSafe(F.col("id_")) & texts.own.eqNullSafe(F.col("own_"))).select("node", "family", "fp", "text").dropDuplicates(["node"])
    sets = found.mapInArrow(hashes, "node bigint, family bigint, fp binary, hashes binary")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / FAMILY_TILE, F.sum("shingles") / FAMILY_SHINGLES)).cast("int").alias("slots"))
    placed = sets.join(sizes, "family").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    tiles = materialize(placed.groupBy("family", "slot", "slots").agg(F.collect_list("node").alias("ids"), F.collect_list("hashes").alias("sets"), F.collect_list("fp").alias("fps")))
    left = tiles.select("family", F.col("slot").alias("own_slot"), F.col("ids").alias("left_ids"), F.col("sets").alias("left_sets"), F.col("fps").alias("left_fps"), F.explode(F.sequence("slot", F.col("slots") - 1)).alias("slot"))
    pairs = left.join(tiles.drop("slots"), ["family", "slot"]).select("left_ids", "left_sets", "ids", "sets", (F.col("own_slot") == F.col("slot")).alias("same"), "left_fps", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                ids, other = (batch.column(k)[i].values.to_numpy() for k in (0, 2))
                x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in batch.column(k)[i].values] for k in (1, 3))
                fx, fy = (_matrix(batch.column(k)[i].values) for k in (5, 6))
                near = lambda p: np.bitwise_count(fx[p] ^ fy).sum(1) <= radius  # noqa: E731, B023
                for p, q in set_links(x, None if batch.column(4)[i].as_py() else y, similarity, near):
                    a.append(ids[p])
                    b.append(other[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 hashes."""
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, shingles_of(text, width), repeat(SEED))), np.uint64))


def set_links(x: list[np.ndarray], y: list[np.ndarray] | None, similarity: float, candidates: Callable[[int], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """(i, j) that connect all x[i] and y[j], or those of x where y is None, of a Jaccard similarity of ``similarity`` or more; of the pairs that ``candidates`` of i tells, if given."""
    own = y is None
    y, base = (x, 0) if own else (y, len(x))
    sizes = np.array([len(v) for v in y])
    label = np.arange(len(y) + base)
    for i, v in enumerate(x):
        if not len(v):
            continue
        near = (label[base:] != label[i]) & (np.minimum(sizes, len(v)) >= similarity * np.maximum(sizes, len(v)) - 1e-6)
        if candidates is not None:
            near &= candidates(i)
        if own:
            near[: i + 1] = False
        near = np.flatnonzero(near)
        if not len(near):
            continue
        flat = np.concatenate([y[j] for j in near])
        hit = v[np.minimum(np.searchsorted(v, flat), len(v) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        near = near[both / (len(v) + sizes[near] - both) >= similarity]
        if len(near):
            labels, first = np.unique(label[base + near], return_index=True)
            label[np.isin(label, labels)] = label[i]
            yield from ((i, int(near[k])) for k in first)
