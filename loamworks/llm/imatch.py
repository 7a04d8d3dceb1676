"""I-Match fingerprints: terms within a band of inverse document frequency, hashed by randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Document frequencies are counted in so many hash buckets: the bound of what is broadcast is a bit for each, 1 MB. A bucket's share of
#: foreign terms stays the same relative to the number of documents, however many there are.
BUCKETS, CHUNKS = 1 << 23, 64
#: Terms in more than this share of documents are left out, and those in less than this share.
COMMON, RARE = 0.02, 0.00002
#: Lexicons of each density; densities are 1/LEXICONS over powers of 4, so that each length of text has some that hold a few of its terms.
LEXICONS, DENSITIES = 32, 5
#: Range blocks of ids, at most; each is read through once and needs no more memory for being large.
BLOCKS, BLOCK_DOCS = 20_000, 1024


def term_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words of a text, A-Z lower-cased."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    return np.sort(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprint(terms: np.ndarray, band: np.ndarray) -> bytes:
    """A byte for each lexicon: 0 if it holds no term of the document, else a hash, 1 to 255, of the sorted terms that it holds.

    terms: sorted distinct hashes; band: a bit for each bucket, whether its terms lie in the band. A document with terms, none of them in the band,
    falls back to a hash of all its terms in every lexicon; one without terms has zeros.
    """
    bucket = (terms >> np.uint64(40)) & np.uint64(BUCKETS - 1)
    kept = terms[(band[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    if not len(kept):
        return bytes([xxh64_intdigest(terms.tobytes()) % 255 + 1] * (LEXICONS * DENSITIES)) if len(terms) else bytes(LEXICONS * DENSITIES)
    out = bytearray(LEXICONS * DENSITIES)
    for d in range(DENSITIES):
        mixed = _mix(kept, d + 1)
        inside = (mixed >> np.uint64(8)) & np.uint64(4**d - 1) == 0
        some, lexicon = kept[inside], (mixed[inside] & np.uint64(LEXICONS - 1)).astype(np.int64)
        if not len(some):
            continue
        order = np.argsort(lexicon, kind="stable")
        raw, which = some[order].tobytes(), lexicon[order]
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        for a, b in zip(cuts, cuts[1:]):
            out[d * LEXICONS + int(which[a])] = xxh64_intdigest(raw[8 * a : 8 * b], d) % 255 + 1
    return bytes(out)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: over the densities, the largest share of equal hashes among the lexicons that hold terms of either; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v, np.uint8).reshape(DENSITIES, LEXICONS) for v in (a, b))
    either, same = ((x > 0) | (y > 0)).sum(1), ((x == y) & (x > 0)).sum(1)
    return float((same / np.maximum(either, 6)).max())


def frequency_band(docs: DataFrame, text_col: str = "text", common: float = COMMON, rare: float = RARE) -> np.ndarray:
    """Packed bits: the buckets whose document frequency, over all documents, lies within the band.

    Tasks count in buckets and send what is not zero; a chunk of buckets is summed in one task, whatever the number of documents.
    """
    width = BUCKETS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for x in batch.column(0):
                n += 1
                bucket = (term_hashes(x.as_py() or "") >> np.uint64(40)) & np.uint64(BUCKETS - 1)
                np.add.at(counts, bucket.astype(np.int64), 1)
        if n:
            parts = [zlib.compress(counts[k * width : (k + 1) * width].tobytes(), 1) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * CHUNKS, pa.int64())], names=["chunk", "counts", "docs"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(width, np.uint64)
        for batch in batches:
            for part, some in zip(batch.column(1), batch.column(2)):
                counts += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
                n += some.as_py()
        bits = np.packbits((counts <= max(1.0, common * n)) & (counts >= rare * n) & (counts > 0), bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["chunk", "bits"])

    sent = docs.select(text_col).mapInArrow(count, "chunk int, counts binary, docs bigint")
    found = sent.groupBy("chunk").applyInArrow(add, "chunk int, bits binary").orderBy("chunk").collect()  # CHUNKS rows, BUCKETS bits
    return np.frombuffer(b"".join(r["bits"] for r in found), np.uint8) if found else np.zeros(BUCKETS // 8, np.uint8)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: float = COMMON, rare: float = RARE) -> DataFrame:
    """(id_col, n_chars bigint, edited_sha256, fingerprint, edited_fingerprint, near_edited double, near_next double) for every row.

    A text's edited version has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next document's text: the next by
    descending id, null ids after all others, rows of one id by ascending text; after the last comes the first. Null texts are empty. near_edited and
    near_next are the likeness of its fingerprint to the edited text's and to the next document's. A single row is its own next. Other
    columns are not read. No rows give no rows.

    Ids are cut into ranges at some of the ids themselves; each range also gets the rows of the id just below it, so that every row finds its
    next in its own range, and texts are shuffled once.
    """
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(frequency_band(docs, text_col, common, rare))
    n = docs.count()
    if not n:
        bounds: list = []
    else:
        many = min(BLOCKS, -(-n // BLOCK_DOCS))
        marks = docs.agg(F.percentile_approx(id_col, [(i + 1) / many for i in range(many)], max(10_000, 10 * many)).alias("q"), F.max(id_col).alias("top")).first()
        bounds = sorted({*(marks["q"] or []), marks["top"]} - {None})
    # bounds[b] is the largest id of block b; null ids go to block 0
    cuts = spark.sparkContext.broadcast(np.array(bounds, np.int64))
    kind = docs.schema[id_col].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = cuts.value
        for batch in batches:
            ids = np.array([0 if v is None else v for v in batch.column(0).to_pylist()], np.int64)
            null = np.array(batch.column(0).is_null())
            block = np.where(null, 0, np.searchsorted(ends, ids)) if len(ends) else np.zeros(len(ids), np.int64)
            at = np.arange(len(ids))
            edge = at[~null][ends[block[~null]] == ids[~null]] if len(ends) else at
            to = (block[edge] + 1) % max(1, len(ends))  # what comes after the last range's first is the first of all
            rows = np.concatenate([at, edge])
            guest = np.arange(len(rows)) >= len(at)
            columns = [pa.array(np.concatenate([block, to]), pa.int32()), pa.array(guest), *(c.take(pa.array(rows)) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "guest", id_col, text_col])

    dealt = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)).mapInArrow(deal, f"block int, guest boolean, `{id_col}` {kind}, `{text_col}` string")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "guest", F.desc_nulls_last(id_col), text_col)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = band.value
        last, block, rows, met = None, None, [], False
        mark = lambda text: fingerprint(term_hashes(text), bits)

        def told(row: tuple, then: tuple) -> tuple:
            key, text, own = row
            swap = len(text) // 3
            edited = text[: len(text) - swap] + then[1][:swap]
            changed = own if edited == text else mark(edited)
            return key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, then[2])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            id_type = batch.schema.field(2).type
            for b, guest, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != block:
                    last, block, met = None, b, False
                if guest and met:
                    continue  # only the first guest comes next
                row = (key, text, mark(text))
                if last is not None:
                    rows.append(told(last, row))
                last, met = (None, True) if guest else (row, False)
            if rows:
                yield flush()

    schema = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(walk, schema)
