"""Grids of sheets: planted ones are found, and an axis's candidates are those of a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.operators import sheets

#: name: (cell width, cell height, margin, spacing, columns, rows)
PLANTED = {"even": (16, 16, 0, 0, 6, 4), "spaced": (16, 16, 2, 2, 5, 5), "wide": (24, 16, 0, 1, 4, 5), "margin": (32, 32, 4, 0, 3, 3), "odd": (20, 20, 0, 0, 5, 4)}


def sheet(cw, ch, margin, spacing, columns, rows, seed):
    """Alpha of a sheet whose cells hold sprites that touch their cell's ground, alike but not the same."""
    rng = np.random.default_rng(seed)
    out = np.zeros((2 * margin + rows * (ch + spacing) - spacing, 2 * margin + columns * (cw + spacing) - spacing), int)
    for r in range(rows):
        for k in range(columns):
            y, x = margin + r * (ch + spacing), margin + k * (cw + spacing)
            sprite = np.zeros((ch, cw), int)
            top = 1 + int(rng.integers(2))
            half = cw // 2 - 2
            sprite[top:, cw // 2 - half : cw // 2 + half] = rng.random((ch - top, 2 * half)) < 0.9
            sprite[ch // 2 :, 1 : cw - 1] = 1
            sprite[ch // 2 + 2, 0] = 1  # it reaches its cell's first column
            out[y : y + ch, x : x + cw] = sprite
    return out


@pytest.fixture(scope="module")
def images():
    return {k: sheet(*v, seed) for seed, (k, v) in enumerate(PLANTED.items())} | {"empty": np.zeros((8, 8), int)}


@pytest.fixture(scope="module")
def pixels(spark, images):
    return spark.createDataFrame([(k, x, y, int(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a)], "img string, x int, y int, a int")


def test_planted_grids_lead(pixels):
    got = {r["img"]: r for r in sheets.grids(pixels, F.col("a") > 0).filter("place = 1").collect()}
    assert {k: (r["cell_x"], r["cell_y"], r["margin_x"], r["spacing_x"], r["columns"], r["rows"]) for k, r in got.items()} == PLANTED


def plain_axis(ink, across):
    """{pitch: (cell, margin, spacing, score)} by trying everything in loops."""
    dim, acf = len(ink), []
    off = ink - ink.mean()
    for lag in range(dim):
        acf.append(max(0.0, float((off[: dim - lag] * off[lag:]).sum() / (off**2).sum())) if lag and (off**2).sum() else 0.0)
    peaks = sorted((-acf[k], k) for k in range(4, max(4, min(512, dim // 2)) + 1) if k < dim and acf[k] >= 0.25 and acf[k] > acf[k - 1] and acf[k] >= (acf[k + 1] if k + 1 < dim else 0))[:3]
    room = lambda p: min(16, max(1, p // 4))
    cells = {*sheets.CELLS, *(p - s for _, k in peaks for p in (k - 1, k, k + 1) for s in range(room(p) + 1)), *(dim // n for n in range(2, 33) if dim % n == 0 and dim // n >= 8)}
    best = {}
    for cell in sorted(x for x in cells if 1 < x <= dim):
        for spacing in range(min(room(cell), dim - cell) + 1):
            for margin in range(min(64, dim - cell) + 1):
                pitch = cell + spacing
                n = (dim - 2 * margin + spacing) // pitch
                end = margin + n * pitch - spacing
                if n < 1 or end + margin > dim:
                    continue
                gaps = [*range(margin), *range(end, dim), *(v for i in range(1, n) for v in range(margin + i * pitch - spacing, margin + i * pitch))]
                share = sum(ink[v] == 0 for v in gaps) / len(gaps) if gaps else None
                if gaps and 1 - sum(ink[v] for v in gaps) / (len(gaps) * across) >= 0.995 and share >= 0.8:
                    share = max(share, 0.98)
                if share is not None and share < 0.98 and (spacing or margin):
                    continue
                cuts = [margin + i * pitch - spacing for i in range(1, n)]
                dip = min(1, max(0, 1 - np.mean([(ink[b - 1] + ink[min(dim - 1, b)]) / 2 for b in cuts]) / ink.mean())) if n > 1 else 0
                parts = [ink[margin + i * pitch : margin + i * pitch + cell] for i in range(n)]
                pads = [abs(int(np.flatnonzero(p)[0]) - int(np.flatnonzero(p[::-1])[0])) for p in parts if p.any()]
                symmetry = min(1, max(0, 1 - np.mean(pads) / cell)) if pads else 0
                score = min(1, (acf[pitch] if n > 1 else 0) * 0.32 + n * cell / dim * 0.26 + symmetry * 0.22 + dip * 0.2) * (1 if cell in sheets.CELLS else 0.92)
                tight = any(p[0] or p[-1] for p in parts)
                key = (tight, round(score + (0.03 if end + margin == dim else 0), 9), -cell, -margin)
                if pitch not in best or key > best[pitch][0]:
                    best[pitch] = (key, (cell, margin, spacing, score))
    return {p: v for p, (_, v) in best.items()}


def test_axis_candidates_against_a_plain_version(pixels, images):
    got = {}
    for r in sheets.axis_candidates(sheets.profiles(pixels, F.col("a") > 0)).collect():
        got.setdefault((r["img"], r["axis"]), {})[r["pitch"]] = (r["cell"], r["margin"], r["spacing"], pytest.approx(r["score"]))
    for name in ("spaced", "odd"):
        a = images[name]
        assert got[name, "x"] == plain_axis(a.sum(0), a.shape[0]) and got[name, "y"] == plain_axis(a.sum(1), a.shape[1])
    assert not [k for k in got if k[0] == "empty"]


def test_runs(spark):
    px = spark.createDataFrame([(1, x, y, a) for y, row in enumerate(("1101", "0000", "0111")) for x, a in enumerate(row)], "img int, x int, y int, a string")
    assert sorted(map(tuple, sheets.runs(px, F.col("a") == "1").collect())) == [(1, 0, 0, 2), (1, 0, 3, 4), (1, 2, 1, 4)]
