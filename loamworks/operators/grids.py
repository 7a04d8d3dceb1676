"""Operators on pixels as rows (img, x, y, r, g, b, a), on rectangles and on series of levels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def swap_colour(px: DataFrame, source: tuple, target: tuple, tolerance: float, shading: bool = False) -> DataFrame:
    """Opaque pixels within ``tolerance`` of one colour set to another; with ``shading``, lighter and darker ones stay so."""
    away = F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - v) * (F.col(c) - v) for c, v in zip(CHANNELS, source)]))
    delta = sum(((F.col(c) - v) * w for c, v, w in zip(CHANNELS, source, (0.2126, 0.7152, 0.0722))), F.lit(0.0)) if shading else F.lit(0.0)
    hit = (F.col("a") > 0) & (away <= tolerance)
    return px.withColumns({c: F.when(hit, F.greatest(F.lit(0.0), F.least(F.lit(255.0), delta + v))).otherwise(F.col(c).cast("double")) for c, v in zip(CHANNELS, target)})


def bayer(n: int) -> list[list[int]]:
    """The ordered-dither matrix of a power of two: each quarter is the matrix of half the size, four times, plus 0, 2, 3 or 1."""
    if n == 1:
        return [[0]]
    half = bayer(n // 2)
    return [[4 * half[y % (n // 2)][x % (n // 2)] + ((0, 2), (3, 1))[y * 2 // n][x * 2 // n] for x in range(n)] for y in range(n)]


def nearest(px: DataFrame, palette: list[tuple], bias: Column | None = None) -> DataFrame:
    """Opaque pixels with ``colour``, the nearest palette entry's number, the least of equally near ones, and ``distance``, squared. A palette holds 256 entries at most."""
    if len(palette) > 256:
        raise ValueError("a palette holds 256 entries at most")
    bias = F.lit(0.0) if bias is None else bias
    square = lambda p: sum(((F.col(c) + bias - v) * (F.col(c) + bias - v) for c, v in zip(CHANNELS, p)), F.lit(0.0))
    best = F.array_min(F.array(*[F.struct(F.round(square(p), 6).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(palette)]))
    return px.filter("a > 0").withColumn("_best", best).withColumns({"colour": F.col("_best.k"), "distance": F.col("_best.d")}).drop("_best")


def dithered(px: DataFrame, palette: list[tuple], n: int, amount: float = 1.0) -> DataFrame:
    """``nearest`` under a dither matrix of n by n."""
    flat = [v / (n * n) for row in bayer(n) for v in row]
    centre = (n * n - 1) / (2 * n * n)
    at = (F.col("y") % n * n + F.col("x") % n + 1).cast("int")
    return nearest(px, palette, (F.element_at(F.array(*map(F.lit, flat)), at) - centre) * (48 * amount))


def metrics(one: DataFrame, other: DataFrame) -> DataFrame:
    """(img, mse, psnr, alpha_rmse, exact) of images of the same pixels; psnr is null where nothing differs."""
    b = other.select("img", "x", "y", *[F.col(c).alias(f"_{c}") for c in (*CHANNELS, "a")])
    square = lambda c: (F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))
    sums = one.join(b, ["img", "x", "y"]).groupBy("img").agg((F.sum(square("r") + square("g") + square("b")) / (F.count("*") * 3)).alias("mse"), F.sqrt(F.avg(square("a"))).alias("alpha_rmse"))
    return sums.select("img", "mse", F.when(F.col("mse") > 0, 10 * F.log10(65025 / F.col("mse"))).alias("psnr"), "alpha_rmse", ((F.col("mse") == 0) & (F.col("alpha_rmse") == 0)).alias("exact"))


def margins(px: DataFrame, shown: Column) -> DataFrame:
    """(img, left, top, right, bottom, rows_used, fullest) of images that show anything: margins, how many rows do, and the most in one row."""
    rows = px.withColumn("_on", shown).groupBy("img", "y").agg(
        F.count_if("_on").alias("n"), F.min(F.when(F.col("_on"), F.col("x"))).alias("x0"), F.max(F.when(F.col("_on"), F.col("x"))).alias("x1"), F.max("x").alias("w")
    )
    used = F.when(F.col("n") > 0, F.col("y"))
    out = rows.groupBy("img").agg(
        F.min("x0").alias("left"), F.min(used).alias("top"), (F.max("w") - F.max("x1")).alias("right"), (F.max("y") - F.max(used)).alias("bottom"), F.count(used).alias("rows_used"), F.max("n").alias("fullest")
    )
    return out.filter("rows_used > 0")


def _away(p: str, q: str) -> Column:
    return sum((F.abs(F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) for c in CHANNELS), F.lit(0)) / 3.0


def seams(px: DataFrame, width: int) -> DataFrame:
    """(img, edge, base, seamless, next_edge, next_fits): mean difference across the seam of a tile repeated to the right, of neighbouring columns, and to the next image.

    A seam is none if it differs by no more than 1.25 times what neighbours do, or 2.
    """
    colour = F.struct(*CHANNELS)
    row = px.groupBy("img", "y").agg(F.max_by(colour, F.when(F.col("x") == width - 1, 1)).alias("last"), F.max_by(colour, F.when(F.col("x") == 0, 1)).alias("first"))
    edge = row.groupBy("img").agg(F.avg(_away("last", "first")).alias("edge"))
    w = Window.partitionBy("img", "y").orderBy("x")
    near = px.select("img", "x", colour.alias("p"), F.lag(colour).over(w).alias("q"), F.lag("x").over(w).alias("x0")).filter("x0 = x - 1")
    base = near.groupBy("img").agg(F.avg(_away("p", "q")).alias("base"))
    following = row.select((F.col("img") - 1).alias("img"), "y", F.col("first").alias("then"))
    match = row.join(following, ["img", "y"]).groupBy("img").agg(F.avg(_away("last", "then")).alias("next_edge"))
    limit = F.greatest(F.lit(2.0), F.col("base") * 1.25)
    out = edge.filter("edge IS NOT NULL").join(base, "img").join(match, "img", "left")
    return out.select("img", "edge", "base", (F.col("edge") <= limit).alias("seamless"), "next_edge", (F.col("next_edge") <= limit).alias("next_fits"))


def suggested_cuts(ink: DataFrame, target: int, radius: int, least: int, most: int = 200) -> DataFrame:
    """(strip, nth, cut, verdict) from (strip, row, ink), ink being the share of a row that is drawn on.

    Each cut is looked for up to ``radius`` rows above the wanted height below the one before, at least ``least`` rows from it and the end: the row of
    least ink and distance. A cut depends on the one before, so a strip's rows are folded in one value, ``most`` cuts at most (more raise).
    """
    strips = ink.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("row", "ink"))).alias("_rows"), (F.max("row") + 1).alias("_h"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<nth:int,cut:int,verdict:string>>").alias("cuts"))

    def step(acc: Column, n: Column) -> Column:
        low, high = F.greatest(acc["at"] + least, acc["at"] + target - radius), F.least(F.col("_h") - least, acc["at"] + target)
        window = F.filter("_rows", lambda r: (r["row"] >= low) & (r["row"] <= high))
        scored = F.transform(window, lambda r: F.struct(F.round(r["ink"] + F.abs(r["row"] - acc["at"] - target) / float(max(1, radius)) * 0.15, 9).alias("s"), r["row"].alias("row")))
        best = F.array_min(scored)
        found = (acc["at"] + target < F.col("_h")) & best.isNotNull()
        cut = F.struct(n.alias("nth"), best["row"].alias("cut"), F.when(best["s"] > 0.35, "uncertain").otherwise("candidate").alias("verdict"))
        return F.struct(F.when(found, best["row"]).otherwise(acc["at"]).alias("at"), F.when(found, F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"]).alias("cuts"))

    wanted = F.ceil(F.col("_h") / float(max(1, min(least, target)))).cast("int")
    many = F.when(wanted > most, F.raise_error(F.lit(f"more than {most} cuts"))).otherwise(F.greatest(wanted, F.lit(1)))
    return strips.select("strip", F.inline(F.aggregate(F.sequence(F.lit(1), many), start, step, lambda acc: acc["cuts"])))


def palette_usage(px: DataFrame, palette: list[tuple]) -> DataFrame:
    """(img, colour, n, exact, share) of every palette entry in every image with opaque pixels."""
    sums = nearest(px, palette).groupBy("img", "colour").agg(F.count("*").alias("n"), F.count_if(F.col("distance") == 0).alias("exact"))
    filled = sums.groupBy("img").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("colour", F.struct("n", "exact")))).alias("m"))  # one entry a colour
    out = filled.select("img", "total", "m", F.explode(F.sequence(F.lit(0), F.lit(len(palette) - 1))).alias("colour")).withColumn("s", F.try_element_at("m", F.col("colour")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("img", "colour", zero(F.col("s.n")).alias("n"), zero(F.col("s.exact")).alias("exact"), (zero(F.col("s.n")) / F.col("total")).alias("share"))


def periods(px: DataFrame, shown: Column, pitches: Iterable[int]) -> DataFrame:
    """(img, pitch, score): autocorrelation, at each pitch, of how many pixels of each column show something."""
    columns = px.groupBy("img", "x").agg(F.count_if(shown).alias("n"))
    z = columns.withColumn("z", F.col("n") - F.avg("n").over(Window.partitionBy("img")))
    w = Window.partitionBy("img").orderBy("x")
    moved = z.select("img", "z", *[F.sum("z").over(w.rangeBetween(p, p)).alias(f"z{p}") for p in pitches])
    sums = moved.groupBy("img").agg(F.sum(F.col("z") * F.col("z")).alias("all"), *[F.sum(F.col("z") * F.col(f"z{p}")).alias(f"s{p}") for p in pitches])
    told = F.array(*[F.struct(F.lit(p).alias("pitch"), F.try_divide(F.col(f"s{p}"), F.col("all")).alias("score")) for p in pitches])
    return sums.select("img", F.inline(told)).filter("score IS NOT NULL")


def reading_order(boxes: DataFrame, page: str, share: float = 0.35) -> DataFrame:
    """(page, id, line, place) of boxes (page, id, x, y, h): a line ends where the next centre, from above, is further than a share of the median height, at least 2, below."""
    tolerance = F.greatest(F.lit(2.0), F.floor(F.percentile("h", F.lit(0.5)) * share + 0.5))
    rows = boxes.join(boxes.groupBy(page).agg(tolerance.alias("_tol")), page).withColumn("_c", F.col("y") + F.col("h") / 2.0)
    w = Window.partitionBy(page).orderBy("_c", "x", "id")
    starts = F.coalesce(F.col("_c") - F.lag("_c").over(w) > F.col("_tol"), F.lit(True))
    lines = rows.withColumn("_s", starts.cast("bigint")).withColumn("line", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.select(page, "id", "line", F.row_number().over(Window.partitionBy(page).orderBy("line", "x", "y", "id")).cast("bigint").alias("place"))


def levels(rows: DataFrame, key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """(key, n, starts, ends, crossings, peak, rms): first and last place, from 0, at or above the threshold in size, sign changes, largest size, root mean square."""
    w = Window.partitionBy(key).orderBy(*order)
    s = rows.select(key, (F.row_number().over(w) - 1).cast("bigint").alias("_i"), F.col(value).alias("_v"), F.lag(value).over(w).alias("_b"))
    loud = F.when(F.abs("_v") >= threshold, F.col("_i"))
    return s.groupBy(key).agg(
        F.count("*").alias("n"), F.min(loud).alias("starts"), F.max(loud).alias("ends"), F.count_if((F.col("_v") >= 0) != (F.col("_b") >= 0)).alias("crossings"), F.max(F.abs("_v")).alias("peak"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rms")
    )
