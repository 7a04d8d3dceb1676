"""Near-duplicate vectors by cosine: cover trees over blocks, and a dual traversal of each pair of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm import shared
from loamworks.llm.components import connected_components
from loamworks.llm.shared import materialize, spanning_edges

#: Cells at the top of the tree, at least and at most, the vectors of a cell between, about, and the vectors sampled to place them: a documented bound, see ``pivots``.
CELLS, MOST_CELLS, CELL, SAMPLE = 4, 256, 4096, 1024
#: Vectors in a block, which holds several cells or a part of one, and components of all its vectors, about; blocks that fewer vectors are dealt into.
BLOCK, COMPONENTS, BLOCKS = 16384, 1 << 20, 16
#: Radii of the nets below a cell, each half of the one above.
RADII = (0.5, 0.25)
#: Slack of the distance bounds; what is kept is decided by the cosine itself.
EPS = 1e-7
#: Directions in which the uppermost nodes are screened, and the slack for doing so in single precision.
DIRECTIONS, SINGLE = 20, 1e-5
#: Nodes with so many pairs of vectors below them are multiplied whole; rows and columns that are multiplied at once.
DENSE, ROWS, COLUMNS = 4096, 256, 2048
#: Links that are held before they are reduced to a spanning forest, about.
HELD = 1 << 20


def unit_rows(values: pa.Array) -> np.ndarray:
    """Rows of equally long, finite, non-zero vectors, each scaled to length 1, in double precision."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _net(x: np.ndarray, rows: np.ndarray, radius: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net of x[rows]: (centers, place of each row's center). rows[0] is the first center; centers are more than radius apart, to single precision."""
    limit = 1 - radius * radius / 2  # a distance of unit vectors as a dot product
    place = np.full(len(rows), -1)
    centers, found = np.empty(len(rows), np.int64), 0
    held = np.empty((len(rows), x.shape[1]), np.float32)
    for lo in range(0, len(rows), step):
        some = rows[lo : lo + step]
        mine = np.full(len(some), -1)
        if found:
            best = (x[some].astype(np.float32) @ held[:found].T).argmax(1)
            mine = np.where(np.einsum("ij,ij->i", x[some], x[centers[best]]) >= limit, best, -1)
        open_ = np.flatnonzero(mine < 0)
        dots = x[some[open_]] @ x[some[open_]].T
        free = np.ones(len(open_), bool)
        for i in range(len(open_)):
            if free[i]:
                inside = free & (dots[i] >= limit)
                inside[i] = True
                mine[open_[inside]] = found
                centers[found], held[found] = some[open_[i]], x[some[open_[i]]]
                found += 1
                free &= ~inside
        place[lo : lo + step] = mine
    return centers[:found], place


def cover_tree(x: np.ndarray, radii: tuple = RADII) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nested nets of unit vectors: (place, head, reach), each with a row per vector and a column per radius.

    place: number of the vector's center at that level, counted in the order of the centers above; head: whether the vector is that
    center (a center stays one at all finer levels); reach: the center's covering radius, the largest distance to any vector below it.
    """
    n = len(x)
    place, head, reach = np.zeros((n, len(radii)), np.int64), np.zeros((n, len(radii)), bool), np.zeros((n, len(radii)))
    upper, owner = np.zeros(1, np.int64), np.zeros(n, np.int64)
    for k, r in enumerate(radii):
        order = np.argsort(owner, kind="stable")
        groups = np.split(order, np.searchsorted(owner[order], np.arange(1, len(upper))))
        centers, now = [], np.zeros(n, np.int64)
        for first, rows in zip(upper, groups):
            if len(rows) == 1:
                now[rows] = len(centers)
                centers.append(first)
                continue
            own, at = _net(x, np.concatenate([[first], rows[rows != first]]), r)
            now[np.concatenate([[first], rows[rows != first]])] = len(centers) + at
            centers.extend(own.tolist())
        upper, owner = np.array(centers), now
        far = np.zeros(len(upper))
        np.maximum.at(far, owner, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, x[upper[owner]]), 0)))
        place[:, k], reach[:, k] = owner, far[owner]
        head[upper, k] = True
    return place, head, reach


class Level(NamedTuple):
    """The nodes of a level: their centers, covering radii, first vectors, numbers of vectors, first children and numbers of children."""

    at: np.ndarray
    reach: np.ndarray
    start: np.ndarray
    size: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _levels(place: np.ndarray, head: np.ndarray, reach: np.ndarray) -> list[Level]:
    """The levels of a cover tree whose vectors are in the order of the finest places, and so in that of all; the last level is the vectors themselves."""
    out, n = [], len(place)
    for k in range(place.shape[1]):
        at = np.flatnonzero(head[:, k])
        size = np.bincount(place[:, k], minlength=len(at))
        start = np.cumsum(size) - size
        if k + 1 == place.shape[1]:
            child, children = start, size
        else:
            child = place[start, k + 1]
            children = place[start + size - 1, k + 1] - child + 1
        out.append(Level(at, reach[at, k], start, size, child, children))
    none = np.zeros(n, np.int64)
    return [*out, Level(np.arange(n), np.zeros(n), np.arange(n), none + 1, none, none)]


def _screens(x: np.ndarray, reach: np.ndarray, far: float, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b of nodes around x, such that of two nodes a . b is at least 1 - far^2 / 2 if their centers are no further apart than far and both covering radii.

    Columns of ``base`` are orthonormal: of what lies outside their directions the lengths are multiplied, which is no less than its dot product. The rest is
    (far + r + s)^2 / 2 - far^2 / 2 = (far r + r^2 / 2) + (far s + s^2 / 2) + r s.
    """
    if base is not None:
        x = x @ base
        x = np.concatenate([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))[:, None]], 1)
    own, one = far * reach + reach * reach / 2, np.ones(len(x))
    return tuple(np.concatenate([x, np.stack(c, 1)], 1).astype(np.float32) for c in ((reach, own, one), (reach, one, own)))


def _screened(a: np.ndarray, b: np.ndarray, least: float, same: bool, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks (p, q) of the pairs with a[p] . b[q] >= least, with p <= q if ``same``; in single precision, so with some slack.

    until: so many rows of b come into question for each row of a, no more than for the one before. Pairs beyond may be among the chunks or not.
    """
    b, dots, p, q, held = np.ascontiguousarray(b.T), np.empty(ROWS * COLUMNS, np.float32), [], [], 0
    for lo in range(0, len(a), ROWS):
        rows = a[lo : lo + ROWS]
        for at in range(lo // COLUMNS * COLUMNS if same else 0, until[lo], COLUMNS):
            cols = b[:, at : min(at + COLUMNS, until[lo])]
            tile = dots[: len(rows) * cols.shape[1]].reshape(len(rows), cols.shape[1])
            hit = np.flatnonzero(np.matmul(rows, cols, out=tile) >= least - SINGLE)
            if len(hit):
                p.append(hit // cols.shape[1] + lo)
                q.append(hit % cols.shape[1] + at)
                held += len(hit)
            if held > HELD:
                yield np.concatenate(p), np.concatenate(q)
                p, q, held = [], [], 0
    if held:
        yield np.concatenate(p), np.concatenate(q)


class Block:
    """A block of vectors in the order of its cover tree, with how often each occurs and with what its nodes are screened by."""

    def __init__(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], times: np.ndarray, least: float, base: np.ndarray | None = None):
        self.x, self.times, self.levels = x, times, _levels(*tree)
        top = self.levels[0]
        self.mean = x[top.at].mean(0)
        self.screens = _screens(x[top.at], top.reach, float(np.sqrt(2 - 2 * least)), base)


def dual_links(a: Block, b: Block, least: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Links of the vectors of a with those of b, or among a's if b is a, with a cosine of ``least`` or more: (how many each has, edges).

    Vectors are numbered through both blocks, and counted as often as they occur. The edges are a spanning forest. Both trees are descended together.
    A pair of nodes goes on only if its centers are no further apart than the threshold's distance and both covering radii, so no link is
    lost; the uppermost are screened for that along what lies between the blocks and in few directions. The vectors at the end are compared in double precision.
    """
    same, x, y, tx, ty = a is b, a.x, b.x, a.levels, b.levels
    far, last, shift = float(np.sqrt(2 - 2 * least)), len(tx) - 1, 0 if same else len(x)
    n = shift + len(y)
    counts, edges, held = np.zeros(n, np.int64), [], 0

    def tell(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal edges, held
        edges.append((i, j + shift))
        held += len(i)
        if held > HELD:
            edges = [spanning_edges(*map(np.concatenate, zip(*edges)), n)]
            held = 0

    def whole(p: int, q: int) -> None:
        """All vectors of node p of a's finest net with all of b's q."""
        (r0, r1), (c0, c1) = ((int(t[-2].start[k]), int(t[-2].start[k] + t[-2].size[k])) for t, k in ((tx, p), (ty, q)))
        for lo in range(r0, r1, ROWS):
            for at in range(c0, c1, COLUMNS):
                rows, cols = np.arange(lo, min(lo + ROWS, r1)), np.arange(at, min(at + COLUMNS, c1))
                near = x[rows] @ y[cols].T >= least
                if same and p == q:
                    near[rows[:, None] == cols] = False
                else:  # else the others are rows of their own
                    counts[shift + cols] += (a.times[rows].astype(float) @ near).astype(np.int64)
                counts[rows] += (near @ b.times[cols].astype(float)).astype(np.int64)
                i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(i):
                    continue
                i, j = np.concatenate([i, near[:, j].argmax(0)]), np.concatenate([near[i].argmax(1), j])
                label = np.arange(len(rows) + len(cols))
                child, root = spanning_edges(i, j + len(rows), len(label))
                label[child] = root
                more = np.nonzero(near & (label[: len(rows), None] != label[None, len(rows) :]))
                tell(rows[np.concatenate([i, more[0]])], cols[np.concatenate([j, more[1]])])

    def near_of(k: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        i, j = tx[k].at[p], ty[k].at[q]
        dots = np.concatenate([np.einsum("ij,ij->i", x[i[m : m + 65536]], y[j[m : m + 65536]]) for m in range(0, len(i), 65536)])
        keep = dots >= least if k == last else 2 - 2 * dots <= (far + tx[k].reach[p] + ty[k].reach[q] + EPS) ** 2
        return keep & (p < q if k == last else p <= q) if same else keep

    # Along any direction two vectors are no further apart than in all: nodes of a are taken as they come from b's side, each with those of b that far towards a
    order, until = (np.arange(len(tx[0].at)), np.arange(len(ty[0].at))), np.full(len(tx[0].at), len(ty[0].at))
    if not same and np.linalg.norm(apart := a.mean - b.mean) > 1e-3:
        apart /= np.linalg.norm(apart)
        low, high = x[tx[0].at] @ apart - tx[0].reach, y[ty[0].at] @ apart + ty[0].reach
        order = np.argsort(low), np.argsort(-high)
        until = np.searchsorted(-high[order[1]], far + EPS - low[order[0]], "right")
    for top in _screened(a.screens[0][order[0]], b.screens[1][order[1]], least, same, until):
        top = tuple(o[v] for o, v in zip(order, top))
        keep = near_of(0, *top)
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, *(v[keep] for v in top))]
        while todo:
            k, p, q = todo.pop()
            if k == last:
                i, j = tx[k].at[p], ty[k].at[q]
                np.add.at(counts, i, b.times[j])
                np.add.at(counts, shift + j, a.times[i])
                tell(i, j)
                continue
            if k == last - 1:
                fat = tx[k].size[p] * ty[k].size[q] >= DENSE
                for i, j in zip(p[fat].tolist(), q[fat].tolist()):
                    whole(i, j)
                p, q = p[~fat], q[~fat]
            times = tx[k].children[p] * ty[k].children[q]
            cuts = np.flatnonzero(np.diff(np.cumsum(times) >> 18)) + 1  # bounds the pairs that are open at once
            for some, p_, q_ in zip(np.split(times, cuts), np.split(p, cuts), np.split(q, cuts)):
                if not len(some):
                    continue
                row = np.repeat(np.arange(len(some)), some)
                nth, wide = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some), ty[k].children[q_][row]
                i, j = tx[k].child[p_][row] + nth // wide, ty[k].child[q_][row] + nth % wide
                keep = near_of(k + 1, i, j)
                if keep.any():
                    todo.append((k + 1, i[keep], j[keep]))
    return counts, spanning_edges(*map(np.concatenate, zip(*edges)), n) if edges else (counts[:0], counts[:0])


def pivots(nodes: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
    """By dimension, up to ``cells`` vectors that stand for the top of the tree, and the directions in which the sample is widest (none if they would not be fewer).

    Fitted on a bounded sample: the ``sample`` nodes that come first by hash. Each pivot is the sampled vector farthest from those
    before it. They decide only how work is dealt out and what is screened first; every vector is compared, so results don't depend on them.
    """
    found: dict[int, list] = {}
    for row in nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("embedding").collect():
        found.setdefault(len(row[0]), []).append(row[0])
    tops = {}
    for dim, rows in found.items():
        x = unit_rows(pa.array(rows, pa.list_(pa.float64())))
        at, dots = [0], x @ x[0]
        while len(at) < cells and dots.min() < 1 - EPS:
            at.append(int(dots.argmin()))
            dots = np.maximum(dots, x @ x[at[-1]])
        off = x - x.mean(0)
        tops[dim] = x[at], np.linalg.eigh(off.T @ off)[1][:, -DIRECTIONS:] if dim > DIRECTIONS + 1 else None
    return tops


def _packed(table: pa.Table) -> bytes:
    """A table as Arrow's stream of bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()


def comparable(c: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite and non-null, not all zero."""
    ok = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & ok & F.exists(c, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id_col, n_links bigint, component_id, kept boolean) for every row of ``vectors``.

    Rows are linked if the cosine of their vectors, in double precision, is ``least`` or more; vectors of unequal lengths never are,
    nor are those that are null, empty, zero or hold null or non-finite components: such a row has no links and is its own component.
    Rows that repeat an id count as rows of their own. Rows with a null id link but don't name a component, and are never kept.
    Other columns are not read. No rows give no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    good = rows.filter(comparable(F.col("embedding")))
    # equal vectors are one node, so that a group of copies costs one vector
    nodes = materialize(good.groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    tops = pivots(nodes, min(MOST_CELLS, max(CELLS, -(-total // min(block, CELL)))))
    far = float(np.sqrt(2 - 2 * least))
    kind = nodes.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            dims = np.diff(vecs.offsets.to_numpy())
            cell, dist = np.zeros(len(vecs), np.int32), np.full(len(vecs), 2.0)
            for dim in set(dims.tolist()) & set(tops):
                at = np.flatnonzero(dims == dim)
                dots = unit_rows(vecs.take(pa.array(at))) @ tops[dim][0].T
                cell[at] = dots.argmax(1)
                dist[at] = np.sqrt(np.maximum(2 - 2 * dots.max(1), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vecs, pa.array(dims.astype(np.int32)), pa.array(cell), pa.array(dist)], names=["node", "n", "embedding", "dim", "cell", "dist"])

    placed = nodes.select("node", "n", "embedding").mapInArrow(place, f"node bigint, n bigint, embedding {kind}, dim int, cell int, dist double")
    size = F.least(F.lit(min(block, max(CELL, total // BLOCKS))), F.greatest(F.lit(256), F.floor(F.lit(COMPONENTS) / F.col("dim"))))
    stats = placed.groupBy("dim", "cell").agg(F.max("dist").alias("reach"), F.count("*").alias("n"))
    # a row for each dimension and cell: cells that follow each other share a block up to its size, and larger ones are dealt into slots
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("cell")) - F.col("n")
    stats = materialize(stats.select("dim", "cell", "reach", F.floor(before / size).alias("block"), F.ceil(F.col("n") / size).cast("int").alias("slots")))
    # at most MOST_CELLS numbers for each dimension of the sample
    reaches: dict[int, np.ndarray] = {dim: np.full(len(top), -10.0) for dim, (top, _) in tops.items()}
    for r in stats.filter(F.col("dim").isin(*tops)).select("dim", "cell", "reach").collect() if tops else ():
        reaches[r["dim"]][r["cell"]] = r["reach"]
    # joined, and broadcast only if Spark finds it small
    placed = placed.join(stats.select("dim", "cell", "block", "slots"), ["dim", "cell"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))

    def grow(key: tuple, vectors_: pa.Table) -> pa.Table:
        dim, trees_ = key[0].as_py(), []
        for cell in sorted(set(vectors_.column("cell").to_pylist())):
            part = vectors_.filter(pc.equal(vectors_.column("cell"), cell)).combine_chunks()
            x = unit_rows(part.column("embedding").chunk(0))
            place_, head, reach = cover_tree(x)
            visits = [cell]
            if dim in tops:  # the cells that what is below any uppermost node may have links into
                at = np.flatnonzero(head[:, 0])
                away = np.sqrt(np.maximum(2 - 2 * (x[at] @ tops[dim][0].T), 0))
                visits = np.flatnonzero((away <= reaches[dim] + far + reach[at, 0][:, None] + 1e-6).any(0)).tolist()
            order = np.argsort(place_[:, -1], kind="stable")
            lists = [pa.array(list(t[order]), pa.list_(kind_)) for t, kind_ in zip((place_, head, reach), (pa.int32(), pa.bool_(), pa.float64()))]
            packed = _packed(pa.table([part.column(c).take(pa.array(order)) for c in ("node", "n", "embedding")] + lists, names=["node", "n", "embedding", "place", "head", "reach"]))
            trees_.append({"cell": cell, "visits": visits, "tree": packed})
        kind_ = pa.list_(pa.struct([("cell", pa.int32()), ("visits", pa.list_(pa.int32())), ("tree", pa.binary())]))
        return pa.table([*([k.as_py()] for k in key), [sorted({v for t in trees_ for v in t["visits"]})], pa.array([trees_], kind_)], names=["dim", "block", "slot", "visits", "trees"]).cast(
            pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("slot", pa.int32()), ("visits", pa.list_(pa.int32())), ("trees", kind_)])
        )

    grown = placed.select("node", "n", "embedding", "dim", "block", "slot", "cell").groupBy("dim", "block", "slot")
    trees = materialize(grown.applyInArrow(grow, "dim int, block bigint, slot int, visits array<int>, trees array<struct<cell: int, visits: array<int>, tree: binary>>"))

    # Each two blocks are a row, where both have nodes that may reach one of the other's cells. Both sides are read from what was written, so nothing is shuffled for it;
    # of the two orders one is taken by turns, so that tasks get equal shares
    sides = trees.select("dim", "visits", F.col("trees.cell").alias("cells"), F.struct("block", "slot").alias("at"), (F.col("block") + F.col("slot")).alias("turn"), "trees")
    x, y = ({c: F.col(f"{s}.{c}") for c in sides.columns} for s in "ab")
    once = (x["at"] == y["at"]) | ((x["at"] < y["at"]) == ((x["turn"] + y["turn"]) % 2 == 0))
    meet = (x["dim"] == y["dim"]) & F.arrays_overlap(x["visits"], y["cells"]) & F.arrays_overlap(y["visits"], x["cells"]) & once
    pairs = sides.alias("a").join(sides.alias("b").hint("shuffle_replicate_nl"), meet).select(x["dim"], (x["at"] == y["at"]).alias("same"), x["trees"].alias("left"), y["trees"].alias("right"))

    def opened(tree: pa.Scalar, base: np.ndarray | None) -> tuple[Block, np.ndarray, int, set[int]]:
        t = _unpacked(tree["tree"])
        grid = [t.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in ("place", "head", "reach")]
        block_ = Block(unit_rows(t.column("embedding").chunk(0)), grid, t.column("n").to_numpy(), least, base)
        return block_, t.column("node").to_numpy(), tree["cell"].as_py(), set(tree["visits"].as_py())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, same, left, right in zip(*batch.columns):
                base = tops.get(dim.as_py(), (None, None))[1]
                rows_ = [opened(t, base) for t in left]
                cols = rows_ if same.as_py() else [opened(t, base) for t in right]
                out = []
                for i, (a, ids, cell, visits) in enumerate(rows_):
                    for b, others, other, back in cols[i:] if same.as_py() else cols:
                        if a is b or (other in visits and cell in back):
                            counts, edges = dual_links(a, b, least)
                            names, hit = ids if a is b else np.concatenate([ids, others]), np.flatnonzero(counts)
                            out.append((names[hit], counts[hit], names[edges[0]], names[edges[1]]))
                if out:
                    yield _found(*map(np.concatenate, zip(*out)))

    # rows are two blocks large, so workers are given one at once
    found = shared.materialize(pairs.mapInArrow(compare, "node bigint, links bigint, a bigint, b bigint"), 1)
    links = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("a IS NOT NULL").select("a", "b"))
    named = nodes.select("node", "least", "n", "embedding").join(roots, "node", "left").join(links, "node", "left")
    named = named.select("embedding", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(names, "root").select("embedding", "n_links", "component_id"))
    # the hash comes first, as rows are sorted by it much faster than by vectors
    linked = good.withColumn("hash", F.xxhash64("embedding")).join(named.withColumn("hash", F.xxhash64("embedding")), ["hash", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.filter(~comparable(F.col("embedding"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def _found(node, links, a, b) -> pa.RecordBatch:
    rows = len(node) + len(a)
    out = np.zeros((4, rows), np.int64)
    out[0, : len(node)], out[1, : len(node)], out[2, len(node) :], out[3, len(node) :] = node, links, a, b
    late = np.arange(rows) >= len(node)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64(), mask=m) for v, m in zip(out, (late, late, ~late, ~late))], names=["node", "links", "a", "b"])
