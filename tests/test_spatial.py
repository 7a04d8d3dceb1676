"""Spatial joins and tests against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.operators import spatial

POLYGONS = "polygon int, ring array<struct<x: double, y: double>>"


def plain_contains(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
            inside = not inside
    return inside


def star(rng, n, cx, cy):
    angles = np.sort(rng.random(n)) * 2 * math.pi
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles.tolist(), (rng.random(n) * 30 + 2).tolist())]


@pytest.mark.parametrize("cell", [3.0, 20.0, 1000.0])
def test_points_in_polygons(spark, cell):
    rng = np.random.default_rng(2)
    rings = [star(rng, int(rng.integers(3, 12)), *(rng.random(2) * 100 - 50).tolist()) for _ in range(20)] + [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(0.0, 0.0), (1.0, 1.0)], []]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((300, 2)) * 160 - 80)] + [(1000, 0.0, 0.0), (1001, 10.0, 5.0), (1002, 5.0, 5.0), (1003, None, 1.0), (1004, float("nan"), 1.0)]
    got = spatial.inside(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(list(enumerate(rings)), POLYGONS), cell)
    want = {(i, k) for i, x, y in points if x is not None and x == x for k, ring in enumerate(rings) if len(ring) >= 3 and plain_contains(ring, x, y)}
    assert sorted((r["id"], r["polygon"]) for r in got.collect()) == sorted(want)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def joined(node):
    """(keys, rows out) of each join of a plan that has run."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    own = [(node.leftKeys().toString(), node.metrics().get("numOutputRows").get().value())] if name in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") else []
    return own + [j for i in inner for j in joined(i)]


@pytest.mark.parametrize("held", [spatial.HELD, 7])
def test_equal_places_and_rings_are_tested_once(spark, monkeypatch, held):
    monkeypatch.setattr(spatial, "HELD", held)
    rng = np.random.default_rng(5)
    rings = [star(rng, 7, *(rng.random(2) * 60 - 30).tolist()) for _ in range(8)] + [[(-0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], [(0.0, -0.0), (10.0, 0.0), (10.0, 10.0)]]
    places = [*(rng.random((60, 2)) * 80 - 40).tolist(), [5.0, 0.0], [5.0, -0.0], [0.0, 0.0], [-0.0, 0.0]]
    points = [(i, *p) for i, p in enumerate(places * 20)] + [(7, *places[7])]  # one point is there twice
    polygons = list(enumerate(rings * 30))
    got = spatial.inside(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(polygons, POLYGONS), 20.0)
    inside = {(p, r): plain_contains(ring, *place) for p, place in enumerate(places) for r, ring in enumerate(rings)}
    want = [(i, k) for i, (id, _, _) in enumerate(points) for k, _ in polygons if inside[id % len(places), k % len(rings)]]
    assert sorted((r["id"], r["polygon"]) for r in got.collect()) == sorted((points[i][0], k) for i, k in want)
    (tests,) = [rows for keys, rows in joined(got._jdf.queryExecution().executedPlan()) if "cx#" in keys]
    assert tests <= sum(inside.values()) < len(want) / 500


def test_crossings(spark):
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (4, 0), (2, 0), (2, 3)], [(0, 0), (9, 0), (9, 9), (5, 0), (0, 9)], [(0, 0), (1, 0), (0, 1)]]
    frame = spark.createDataFrame([(k, [tuple(map(float, p)) for p in r]) for k, r in enumerate(rings)], POLYGONS)
    want = {(1, 0, 2), (2, 1, 3), (3, 0, 2), (3, 0, 3)}
    for cell in (0.5, 3.0, 100.0):
        got = sorted(map(tuple, spatial.crossings(frame, "polygon", cell).collect()))
        assert {g for g in got if g[0] != 2} == {w for w in want if w[0] != 2} and len(got) == len(set(got))
        assert any(g[0] == 2 for g in got)


def test_area_and_distance(spark):
    frame = spark.createDataFrame([(0, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (1, [(0.0, 0.0), (0.0, 3.0), (4.0, 3.0), (4.0, 0.0)]), (2, [(1.0, 1.0)])], POLYGONS)
    got = frame.select("polygon", spatial.area(F.col("ring")).alias("a"), spatial.distance(F.col("ring"), F.lit(7.0), F.lit(7.0)).alias("d"), spatial.distance(F.col("ring"), F.lit(2.0), F.lit(1.0)).alias("e")).orderBy("polygon").collect()
    assert [(r["a"], r["d"]) for r in got] == [(12.0, 5.0), (-12.0, 5.0), (0.0, pytest.approx(math.hypot(6, 6)))] and got[0]["e"] == 1.0
