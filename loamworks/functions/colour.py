"""Colours and shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Oklab matrices, from linear sRGB to cone responses and from their cube roots to L, a and b.
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
#: The weights of red, green and blue in relative luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)


def linear(c: Column) -> Column:
    """Linear light of an sRGB component of 0 to 1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _weighted(weights: tuple[float, ...], parts: list[Column]) -> Column:
    a, b, c = (F.lit(w) * p for w, p in zip(weights, parts))
    return a + b + c


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of a colour of three sRGB components of 0 to 1; null if one is null."""
    light = [linear(r), linear(g), linear(b)]
    roots = [F.cbrt(_weighted(w, light)) for w in TO_CONES]
    lab = [_weighted(w, roots) for w in TO_LAB]
    return lab[0], lab[1], lab[2]


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance, 0 to 1."""
    return _weighted(LUMINANCE, [linear(r), linear(g), linear(b)])


def contrast(one: Column, other: Column) -> Column:
    """Contrast ratio of two luminances, 1 to 21, whichever is lighter."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def polygon_area(x: Column, y: Column) -> Column:
    """Area of the polygon of two arrays of coordinates, whichever way round; 0 for fewer than three corners."""
    n = F.size(x)
    after = lambda v, i: F.element_at(v, (i % n + 1).cast("int"))
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) * after(y, i) - after(x, i) * F.element_at(y, i))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2)
