"""Weighted median cut against a plain one."""

from collections import defaultdict
from math import floor

import numpy as np
import pytest

from loamworks.operators import palettes
from loamworks.plans import catalogue


def oklab(r, g, b):
    lin = [x / 255 / 12.92 if x / 255 <= 0.04045 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in (r, g, b)]
    m = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]) @ lin
    return (np.array([[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]]) @ np.cbrt(m)).tolist()


def nearest_whole(x):
    return floor(x + 0.5)


def plain(pixels, count, steps=4):
    sums = defaultdict(lambda: [0.0] * 4)
    for r, g, b, a in pixels:
        if a:
            s = sums[(r >> 3) << 10 | (g >> 3) << 5 | b >> 3]
            for k, v in enumerate((r, g, b)):
                s[k] += v * a / 255
            s[3] += a / 255
    points = []
    for key, (*rgb, w) in sorted(sums.items()):
        rgb = [v / w for v in rgb]
        points.append((key, rgb, oklab(*map(nearest_whole, rgb)), w))
    if not points:
        return []
    boxes = [points]
    while len(boxes) < count:
        best = (0.0, None, None)
        for i, box in enumerate(boxes):
            ranges = [max(p[2][k] for p in box) - min(p[2][k] for p in box) for k in range(3)]
            score = max(ranges) * sum(p[3] for p in box)
            if len(box) > 1 and score > best[0]:
                best = (score, i, ranges.index(max(ranges)))
        if best[1] is None:
            break
        box = sorted(boxes[best[1]], key=lambda p: (p[2][best[2]], p[0]))
        half, mass, at = sum(p[3] for p in box) / 2, 0.0, 0
        while mass < half:
            mass += box[at][3]
            at += 1
        at = min(max(1, at), len(box) - 1)
        boxes[best[1] : best[1] + 1] = [box[:at], box[at:]]
    mean = lambda ps: tuple(nearest_whole(sum(p[1][k] * p[3] for p in ps) / sum(p[3] for p in ps)) for k in range(3))
    palette = [mean(b) for b in boxes]
    for _ in range(steps):
        labs, near = [oklab(*c) for c in palette], defaultdict(list)
        for p in points:
            near[min(range(len(labs)), key=lambda i: (sum((x - y) ** 2 for x, y in zip(p[2], labs[i])), i))].append(p)
        palette = [mean(near[i]) if near[i] else c for i, c in enumerate(palette)]
    return palette


@pytest.mark.parametrize("count", [1, 2, 7, 16])
def test_against_a_plain_cut(spark, count):
    rng = np.random.default_rng(count)
    images = {0: [(10, 20, 30, 255)] * 5, 1: [(0, 0, 0, 0)], 4: [(255, 0, 0, 255)] * 1000 + [(0, 255, 0, 1), (0, 0, 255, 1)]}
    for i in (2, 3, 5):
        centers = rng.integers(0, 256, (i * 3, 3))
        images[i] = [(*np.clip(centers[rng.integers(len(centers))] + rng.integers(-12, 13, 3), 0, 255).tolist(), int(rng.choice([255, 128, 1, 0]))) for _ in range(300)]
    rows = [(i, *map(int, p)) for i, ps in images.items() for p in ps] + [(9, None, 1, 1, 255)]
    frame = spark.createDataFrame(rows, "img int, r int, g int, b int, a int")
    got = defaultdict(list)
    for r in palettes.palettes(frame, "img", count).orderBy("img", "place").collect():
        got[r["img"]].append((r["red"], r["green"], r["blue"]))
    assert dict(got) == {i: p for i, ps in images.items() if (p := plain(ps, count))}


def test_query(spark, sf):
    from loamworks.plans.grids import pixels

    images = defaultdict(list)
    for r in pixels(spark, sf).collect():
        images[r["img"]].append((r["r"], r["g"], r["b"], r["a"]))
    got = defaultdict(list)
    for r in catalogue.QUERIES["median_cut_palettes"](spark, sf).orderBy("img", "place").collect():
        got[r["img"]].append((r["red"], r["green"], r["blue"]))
    assert dict(got) == {i: plain(ps, 8) for i, ps in images.items()}
