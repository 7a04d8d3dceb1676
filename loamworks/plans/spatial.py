"""Points among polygons: events are points, suppliers have polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.operators import spatial
from loamworks.plans.registry import query
from loamworks.session import table

#: Directions of a polygon's vertices, in hundredths.
_DIRECTIONS = ((100, 0), (62, 78), (-22, 97), (-90, 43), (-90, -43), (-22, -97), (62, -78))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, ring): seven vertices around a place, at distances of their own; of every tenth, two are swapped."""
    k = F.col("s_suppkey")
    plain = [F.struct(F.lit(n).alias("n"), F.lit(dx).alias("x"), F.lit(dy).alias("y")) for n, (dx, dy) in enumerate(_DIRECTIONS)]
    swapped = [plain[0], plain[2], plain[1], *plain[3:]]
    vertex = lambda v: F.struct(*[((k * m % 1000).cast("double") + (k * (v["n"] + 3) % 40 + 15) * v[c] / 100.0).alias(c) for c, m in (("x", 37), ("y", 91))])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(F.when(k % 10 == 0, F.array(*swapped)).otherwise(F.array(*plain)), vertex).alias("ring"))


_EDGES = f"""d(n, dx, dy) AS (VALUES {", ".join(f"({n}, {x}, {y})" for n, (x, y) in enumerate(_DIRECTIONS))}),
    v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 AND n IN (1, 2) THEN 3 - n ELSE n END AS i, CAST(s_suppkey * 37 % 1000 AS DOUBLE) + (s_suppkey * (n + 3) % 40 + 15) * dx / 100.0::DOUBLE AS x, CAST(s_suppkey * 91 % 1000 AS DOUBLE) + (s_suppkey * (n + 3) % 40 + 15) * dy / 100.0::DOUBLE AS y FROM supplier, d),
    e AS (SELECT a.s_suppkey, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.s_suppkey = b.s_suppkey AND b.i = (a.i + 1) % 7)"""


@query(
    f"""WITH {_EDGES}, p AS (SELECT event_id, event_id * 7919 % 100000 / 100.0::DOUBLE AS x, event_id * 104729 % 100000 / 100.0::DOUBLE AS y FROM events)
    SELECT event_id, s_suppkey FROM p JOIN e ON (y2 > p.y) <> (y1 > p.y) AND p.x < (x1 - x2) * (p.y - y2) / (y1 - y2) + x2 GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which polygons each point lies in."""
    at = lambda m: (F.col("event_id") * m % 100_000) / F.lit(100.0)
    points = table(spark, sf_dir, "events").select("event_id", at(7919).alias("x"), at(104_729).alias("y"))
    return spatial.inside(points, polygons(spark, sf_dir), 50.0).select("event_id", "s_suppkey")


@query(
    f"""WITH {_EDGES}, q AS (SELECT a.s_suppkey, a.i, b.i AS j, (b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) AS d1, (b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS d2,
        (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS d3, (a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS d4 FROM e a JOIN e b ON a.s_suppkey = b.s_suppkey AND a.i < b.i AND b.i <> a.i + 1 AND NOT (a.i = 0 AND b.i = 6))
    SELECT s_suppkey, i, j FROM q WHERE d1 * d2 < 0 AND d3 * d4 < 0"""
)
def polygon_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one polygon that cross."""
    return spatial.crossings(polygons(spark, sf_dir), "s_suppkey", 25.0)
