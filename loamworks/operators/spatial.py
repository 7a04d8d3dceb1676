"""Points, segments and polygons: spatial joins over a grid of cells, exact tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as no turn.
NEAR = 1e-9

#: Fixed value: about how many polygons of one ring go in one row before the rows are made; changes no result.
HELD = 1000


def _edges(ring: Column) -> Column:
    """(a, b) of each edge of a closed ring of points (x, y), the last back to the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1)), lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b))


def area(ring: Column) -> Column:
    """Signed area of a ring, positive where it turns from x to y."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring: a ray from it to the right crosses an odd number of edges, those counted that have one end above it."""
    return _odd(_edges(ring), x, y)


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray from a point to the right crosses an odd number of these edges."""
    crossed = lambda e: ((e["b"]["y"] > y) != (e["a"]["y"] > y)) & (x < (e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]) / F.nullif(e["a"]["y"] - e["b"]["y"], F.lit(0.0)) + e["b"]["x"])
    return F.aggregate(edges, F.lit(False), lambda s, e: s != F.coalesce(crossed(e), F.lit(False)))


def distance(ring: Column, x: Column, y: Column) -> Column:
    """From a point to the nearest point of a ring's edges; null for a ring without points."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(_edges(ring), to_edge))


def meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments from a to b and from c to d have a point in common, ends included."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    d1, d2, d3, d4 = turn(c, d, a), turn(c, d, b), turn(a, b, c), turn(a, b, d)
    apart = lambda p, q: ((p > NEAR) & (q < -NEAR)) | ((p < -NEAR) & (q > NEAR))
    within = lambda p, q, r, k: (F.least(p[k], q[k]) - NEAR <= r[k]) & (r[k] <= F.greatest(p[k], q[k]) + NEAR)
    on = lambda turned, p, q, r: (F.abs(turned) <= NEAR) & within(p, q, r, "x") & within(p, q, r, "y")
    return (apart(d1, d2) & apart(d3, d4)) | on(d1, c, d, a) | on(d2, c, d, b) | on(d3, a, b, c) | on(d4, a, b, d)


def _cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, cell: float) -> DataFrame:
    """A row for each cell of the grid that a box touches, as cx and cy."""
    at = lambda v: F.floor(v / cell)
    return df.withColumn("cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("cy", F.explode(F.sequence(at(y0), at(y1))))


def inside(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(columns of points, columns of polygons but ring) for each point that lies in a polygon.

    points: x, y and more; polygons: ring array<struct<x, y>> and more. Equal places and equal rings are tested once, however many points and polygons have them: the distinct ones meet in the cells, of
    width ``cell``, that they touch (a place stands in one, a ring in those of its bounding box, so no pair is met twice) and are tested exactly within the box; points and polygons are joined to what was
    found, which makes the rows. So tests grow with distinct places times distinct rings, and only the rows themselves with points times polygons. A cell or a place with a third of all points is split by
    adaptive execution, as each join has nothing above it that wants its rows together. Polygons of one ring come in rows of about ``HELD``. Points with a null place, and rings of fewer than three points, lie in nothing. The width costs or saves tests, but
    changes no result: about that of a usual polygon is best.
    """
    ring, x, y = F.col("ring"), F.col("x"), F.col("y")
    xs, ys = ring["x"], ring["y"]
    pad = NEAR * F.greatest(F.abs(F.array_min(xs)), F.abs(F.array_max(xs)))  # where a ray crosses an edge is rounded
    shaped = polygons.filter(F.size("ring") >= 3).withColumn("_shape", F.unhex(F.sha2(ring.cast("string"), 256)))
    rings = shaped.select("_shape", "ring").distinct()
    boxed = rings.select("_shape", _edges(ring).alias("edges"), (F.array_min(xs) - pad).alias("x0"), (F.array_max(xs) + pad).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    held = _cells(boxed, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), cell)
    placed = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    places = placed.select("x", "y").distinct().withColumns({"cx": F.floor(x / cell), "cy": F.floor(y / cell)})
    found = places.join(held, ["cx", "cy"]).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").filter(_odd(F.col("edges"), x, y)).select("x", "y", "_shape")
    carried = [c for c in polygons.columns if c != "ring"]
    told = shaped.select("_shape", F.struct(*(carried or ["_shape"])).alias("_one"))
    parts = told.groupBy("_shape").agg(F.ceil(F.count("*") / HELD).alias("parts"))
    parted = told.join(parts, "_shape").withColumn("part", F.pmod(F.xxhash64(F.col("_one").cast("string")), "parts"))
    members = parted.repartition("_shape", "part").groupBy("_shape", "part").agg(F.collect_list("_one").alias("_held")).drop("part")
    met = placed.join(found.hint("merge"), ["x", "y"]).join(members, "_shape").select(*points.columns, F.explode("_held").alias("_one"))
    return met.select(*points.columns, *[F.col("_one")[c].alias(c) for c in carried])


def crossings(polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, i, j): pairs of edges of one polygon, from 0, that have a point in common without being neighbours; a simple polygon has none.

    Edges meet in the cells that their boxes touch, so a ring of many short edges costs few tests; each pair is told once, in the first cell that both touch.
    """
    edges = polygons.select(key, F.size("ring").alias("n"), F.posexplode(_edges(F.col("ring"))).alias("i", "e"))
    a, b = F.col("e.a"), F.col("e.b")
    low = lambda k: F.least(a[k], b[k])
    high = lambda k: F.greatest(a[k], b[k])
    placed = _cells(edges.withColumns({"lx": F.floor(low("x") / cell), "ly": F.floor(low("y") / cell)}), low("x"), high("x"), low("y"), high("y"), cell)
    other = placed.select(key, F.col("i").alias("j"), F.col("e").alias("f"), F.col("lx").alias("mx"), F.col("ly").alias("my"), "cx", "cy")
    pairs = placed.join(other, [key, "cx", "cy"]).filter("i < j AND j <> i + 1 AND NOT (i = 0 AND j = n - 1) AND cx = greatest(lx, mx) AND cy = greatest(ly, my)")
    return pairs.filter(meet(F.col("e.a"), F.col("e.b"), F.col("f.a"), F.col("f.b"))).select(key, "i", "j")
