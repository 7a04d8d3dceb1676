"""Grids of sprite sheets: what cell, margin and spacing a sheet was drawn with, by evidence from its lines, its runs of ink and its cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.operators import graph
from loamworks.operators.relational import top_per_key

#: Usual cell sizes, the largest margin and spacing, the shares of empty separators that a grid needs, the crossings that count against none.
CELLS = (8, 16, 24, 32, 48, 64, 96, 128)
MAX_MARGIN, MAX_SPACING = 64, 16
GATE, PIXEL_GATE, LINE_GATE, CROSSINGS = 0.98, 0.995, 0.8, 0.03
#: What unusual cells keep of a score; how much each piece of evidence weighs, on an axis and of a whole grid.
UNUSUAL = 0.92
AXIS_WEIGHTS = {"periodicity": 0.32, "tiling": 0.26, "symmetry": 0.22, "dip": 0.20}
GRID_WEIGHTS = {"periodicity": 0.24, "consistency": 0.24, "tiling": 0.20, "symmetry": 0.12, "coverage": 0.10, "within": 0.10}
#: Candidates of an axis that meet those of the other.
SHORTLIST = 4


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def profiles(px: DataFrame, shown: Column) -> DataFrame:
    """(img, axis, dim, across, ink array<int>, inked array<int>, blank array<int>, acf array<double>) of each axis of an image that shows anything.

    ink: how many pixels of each column (x) or row (y) show; inked and blank: how many before each line, and how many lines before it are empty; acf: the lines' autocorrelation by lag. An
    image is as wide and high as its pixels tell, of which all, or at least its last column and row, are given.
    """
    marked = px.withColumn("_on", F.coalesce(shown, F.lit(False)))
    size = marked.groupBy("img").agg((F.max("x") + 1).cast("int").alias("x"), (F.max("y") + 1).cast("int").alias("y"), F.count_if("_on").alias("n")).filter("n > 0")
    frames = []
    for axis, other in (("x", "y"), ("y", "x")):
        lines = size.select("img", F.lit(axis).alias("axis"), F.col(axis).alias("dim"), F.col(other).alias("across"), F.explode(F.sequence(F.lit(0), F.col(axis) - 1)).alias("at"))
        ink = marked.filter("_on").groupBy("img", F.col(axis).cast("int").alias("at")).agg(F.count("*").cast("int").alias("ink"))
        frames.append(lines.join(ink, ["img", "at"], "left").withColumn("ink", F.coalesce("ink", F.lit(0))))
    before = Window.partitionBy("img", "axis").orderBy("at")
    lines = frames[0].unionByName(frames[1]).withColumns({"inked": F.sum("ink").over(before).cast("int"), "blank": F.sum((F.col("ink") == 0).cast("int")).over(before).cast("int")})
    listed = lines.groupBy("img", "axis", "dim", "across").agg(F.sort_array(F.collect_list(F.struct("at", "ink", "inked", "blank"))).alias("s"))
    zero = F.array(F.lit(0))
    out = listed.select("img", "axis", "dim", "across", F.col("s")["ink"].alias("ink"), F.concat(zero, F.col("s")["inked"]).alias("inked"), F.concat(zero, F.col("s")["blank"]).alias("blank"))
    out = out.withColumn("off", F.transform("ink", lambda v: v - F.element_at("inked", -1) / F.col("dim")))
    out = out.withColumn("den", F.aggregate("off", F.lit(0.0), lambda a, v: a + v * v))
    dot = lambda lag: F.aggregate(F.zip_with(F.slice("off", 1, F.col("dim") - lag), F.slice("off", lag + 1, F.col("dim") - lag), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    acf = F.transform(F.sequence(F.lit(0), F.col("dim") - 1), lambda lag: F.when((lag > 0) & (F.col("den") > 0), F.greatest(F.lit(0.0), dot(lag) / F.col("den"))).otherwise(0.0))
    return out.withColumn("acf", acf).drop("off", "den")


def _cells_of(dim: Column, acf: Column) -> Column:
    """Cell sizes worth trying: usual ones, what the three strongest peaks of the autocorrelation leave beside a spacing, and what divides the axis into 2 to 32."""
    lags = F.filter(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.lit(512), F.floor(dim / 2).cast("int")))), lambda k: (F.get(acf, k) >= 0.25) & (F.get(acf, k) > F.get(acf, k - 1)) & (F.get(acf, k) >= F.coalesce(F.get(acf, k + 1), F.lit(0.0))))
    peaks = F.transform(F.slice(F.array_sort(F.transform(lags, lambda k: F.struct((-F.get(acf, k)).alias("v"), k.alias("k")))), 1, 3), lambda s: s["k"])
    spaced = lambda p: F.transform(F.sequence(F.lit(0), F.least(F.lit(MAX_SPACING), F.greatest(F.lit(1), F.floor(p / 4).cast("int")))), lambda s: p - s)
    found = F.flatten(F.transform(F.flatten(F.transform(peaks, lambda k: F.array(k - 1, k, k + 1))), spaced))
    whole = F.transform(F.filter(F.sequence(F.lit(2), F.lit(32)), lambda n: (dim % n == 0) & (dim / n >= 8)), lambda n: (dim / n).cast("int"))
    return F.filter(F.array_distinct(F.concat(F.array(*map(F.lit, CELLS)), found, whole)), lambda c: (c > 1) & (c <= dim))


def axis_candidates(lines: DataFrame) -> DataFrame:
    """(img, axis, cell, margin, spacing, pitch, count, separator, periodicity, dip, symmetry, tiling, exact, tight, score): for each pitch of an axis the cell, margin and spacing that describe it best.

    A margin or spacing whose lines aren't nearly all empty is none. Of one pitch, cells whose first or last line shows something come first, then by score, with a little
    more for a layout that ends where the image does, then the smaller cell, margin.
    """
    c = F.col
    tried = lines.select("*", F.explode(_cells_of(c("dim"), c("acf"))).alias("cell"))
    room = c("dim") - c("cell")
    most = F.least(F.lit(MAX_SPACING), F.greatest(F.lit(1), F.floor(c("cell") / 4)), room).cast("int")
    tried = tried.select("*", F.explode(F.sequence(F.lit(0), most)).alias("spacing"))
    tried = tried.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(MAX_MARGIN), c("dim") - c("cell")))).alias("margin"), (c("cell") + c("spacing")).alias("pitch"))
    tried = tried.withColumn("count", F.floor((c("dim") - 2 * c("margin") + c("spacing")) / c("pitch")).cast("int")).filter("count >= 1 AND 2 * margin + count * pitch - spacing <= dim")
    end = c("margin") + c("count") * c("pitch") - c("spacing")
    between = lambda name, a, b: F.get(c(name), b) - F.get(c(name), a)
    inner = F.when(c("count") > 1, F.sequence(F.lit(1), c("count") - 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda i: c("margin") + i * c("pitch")
    gaps = lambda name: F.aggregate(inner, F.lit(0), lambda a, i: a + between(name, cut(i) - c("spacing"), cut(i)))
    outer = lambda name: F.get(c(name), c("margin")) + F.get(c(name), c("dim")) - F.get(c(name), end)
    tried = tried.withColumns({"lines": c("margin") + c("dim") - end + (c("count") - 1) * c("spacing"), "empty": outer("blank") + gaps("blank"), "stray": outer("inked") + gaps("inked")})
    line_share = c("empty") / c("lines")
    clear = (1 - c("stray") / (c("lines") * c("across")) >= PIXEL_GATE) & (line_share >= LINE_GATE)
    tried = tried.withColumn("separator", F.when(c("lines") > 0, F.when(clear, F.greatest(line_share, F.lit(GATE))).otherwise(line_share)))
    tried = tried.filter(f"separator IS NULL OR separator >= {GATE} OR (spacing = 0 AND margin = 0)")
    level = F.get(c("inked"), c("dim")) / c("dim")
    edges = F.transform(inner, lambda i: (F.get(c("ink"), cut(i) - c("spacing") - 1) + F.get(c("ink"), F.least(c("dim") - 1, cut(i) - c("spacing")))) / 2.0)
    cells = F.transform(F.sequence(F.lit(0), c("count") - 1), lambda i: F.slice(c("ink"), cut(i) + 1, c("cell")))
    filled = F.filter(cells, lambda v: F.exists(v, lambda n: n > 0))
    first = lambda v: F.array_position(F.transform(v, lambda n: n > 0), True)
    pads = F.transform(filled, lambda v: F.abs(first(v) - first(F.reverse(v))).cast("double"))
    tried = tried.withColumns({
        "periodicity": F.when(c("count") > 1, F.coalesce(F.get(c("acf"), c("pitch")), F.lit(0.0))).otherwise(0.0), "dip": F.when(c("count") > 1, _unit(1 - _mean(edges) / level)).otherwise(0.0), "symmetry": F.when(F.size(filled) > 0, _unit(1 - _mean(pads) / c("cell"))).otherwise(0.0),
        "tiling": c("count") * c("cell") / c("dim"), "exact": (end + c("margin")) == c("dim"), "tight": F.exists(cells, lambda v: (v[0] > 0) | (F.element_at(v, -1) > 0)),
    })
    score = _unit(sum(w * c(k) for k, w in AXIS_WEIGHTS.items())) * F.when(c("cell").isin(*CELLS), 1.0).otherwise(UNUSUAL)
    tried = tried.withColumn("score", score)
    order = [F.desc("tight"), F.desc(F.round(c("score") + F.when(c("exact"), 0.03).otherwise(0.0), 9)), c("cell"), c("margin")]
    return top_per_key(tried, ["img", "axis", "pitch"], order).select("img", "axis", "cell", "margin", "spacing", "pitch", "count", "separator", "periodicity", "dip", "symmetry", "tiling", "exact", "tight", "score")


def runs(px: DataFrame, shown: Column) -> DataFrame:
    """(img, y, start, stop): the stretches of each row that show something, stop excluded."""
    on = px.filter(F.coalesce(shown, F.lit(False))).select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    place = F.row_number().over(Window.partitionBy("img", "y").orderBy("x"))
    return on.withColumn("_k", F.col("x") - place).groupBy("img", "y", "_k").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("stop")).drop("_k")


def grids(px: DataFrame, shown: Column) -> DataFrame:
    """(img, cell_x, cell_y, margin_x, margin_y, spacing_x, spacing_y, columns, rows, filled, consistency, coverage, cross, outside, split, score, place): candidate grids of each image, the likeliest first.

    The best candidates of the axes meet, with those of a cell that leads the other axis and the whole axis as one cell. A grid's score is that of its axes and of how alike what its cells hold is placed, less for
    ink that crosses cells or lies outside them, for empty lines that still split what cells hold, for long cells, and for one cell along an axis that repeats itself. A finer grid whose lines take in all of the leader's goes first
    if its axes score as well and it cuts no more. Images that show nothing have none.
    """
    c = F.col
    lines = graph.settle(profiles(px, shown))
    axes = graph.settle(axis_candidates(lines))
    place = F.row_number().over(Window.partitionBy("img", "axis").orderBy(F.desc(F.round("score", 9)), "pitch"))
    ranked = axes.withColumn("n", place)
    lead = ranked.filter("n <= 3").select("img", F.when(c("axis") == "x", "y").otherwise("x").alias("axis"), "cell", F.lit(True).alias("leads")).distinct()
    short = ranked.join(lead, ["img", "axis", "cell"], "left").filter(f"n <= {SHORTLIST} OR leads OR count = 1")
    strong = lines.select("img", "axis", F.exists(F.slice("acf", 5, 10**6), lambda v: v >= 0.6).alias("repeats"))
    short = short.join(strong, ["img", "axis"])
    side = lambda a: short.filter(c("axis") == a).select("img", *[c(k).alias(f"{k}_{a}") for k in ("cell", "margin", "spacing", "pitch", "count", "periodicity", "symmetry", "tiling", "score", "repeats")])
    grid = side("x").join(side("y"), "img")
    grid = graph.settle(grid.withColumn("grid", F.struct("cell_x", "cell_y", "margin_x", "margin_y", "spacing_x", "spacing_y")))
    frame = grid.select("img", "grid", *[f"{k}_{a}" for k in ("cell", "margin", "pitch", "count") for a in "xy"])
    ink = graph.settle(runs(px, shown))
    # each run meets the image's few grids; it is cut at their cells
    met = ink.join(frame, "img")
    at = lambda v, a: F.floor((v - c(f"margin_{a}")) / c(f"pitch_{a}")).cast("int")
    inside_row = (at(c("y"), "y") >= 0) & (at(c("y"), "y") < c("count_y")) & (F.pmod(c("y") - c("margin_y"), c("pitch_y")) < c("cell_y")) & (c("y") >= c("margin_y"))
    clamp = lambda v: F.greatest(F.lit(0), F.least(v, c("count_x") - 1))
    crossed = clamp(at(c("stop") - 1, "x")) - clamp(at(c("start"), "x"))
    met = met.withColumns({"row": F.when(inside_row, at(c("y"), "y")), "crossed": crossed})
    cross_x = met.groupBy("img", "grid").agg(F.sum("crossed").alias("cross_x"), F.count_distinct("y").alias("used"), F.sum(c("stop") - c("start")).alias("all_ink"))
    pieces = met.filter("row IS NOT NULL").withColumn("col", F.explode(F.sequence(clamp(at(c("start"), "x")), clamp(at(c("stop") - 1, "x")))))
    left = c("margin_x") + c("col") * c("pitch_x")
    pieces = pieces.withColumns({"x0": F.greatest(c("start"), left), "x1": F.least(c("stop"), left + c("cell_x"))}).filter("x0 < x1")
    cells = pieces.groupBy("img", "grid", "row", "col").agg(
        F.sum(c("x1") - c("x0")).alias("area"), F.min("x0").alias("l"), F.max("x1").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.first(c("cell_x")).alias("cw"), F.first(c("cell_y")).alias("ch"),
        (F.min("x0") - F.first(left)).alias("inset"), (F.first(c("margin_y") + c("row") * c("pitch_y") + c("cell_y")) - 1 - F.max("y")).alias("under"),
    )
    spread = lambda v, size: _unit(1 - F.stddev_pop(v) / (F.first(size) * 0.5))
    alike = sum((spread(v, s) for v, s in (("w", "cw"), ("h", "ch"), ("inset", "cw"), ("under", "ch"))), F.lit(0.0)) / 4
    # lines without ink that still split what a cell holds
    blank = lambda a: lines.filter(c("axis") == a).select("img", c("blank").alias(f"blank_{a}"))
    holes = lambda name, a, b: F.greatest(F.lit(0), F.coalesce(F.get(c(name), b) - F.get(c(name), a), F.lit(0)))
    cells = cells.join(blank("x"), "img").join(blank("y"), "img").withColumns({"hx": holes("blank_x", c("l") + 1, c("r") - 1), "hy": holes("blank_y", c("t") + 1, c("b"))}).drop("blank_x", "blank_y")
    split = (F.sum("hx") / F.sum("w") + F.sum("hy") / F.sum("h")) / 2
    held = cells.groupBy("img", "grid").agg(F.count("*").alias("filled"), F.sum("area").alias("within"), F.when(F.count("*") > 1, alike).otherwise(0.5).alias("consistency"), split.alias("split"))
    # ink that goes on over a line between two rows of cells
    upper = ink.select("img", (c("y") + 1).alias("y"), c("start").alias("s"), c("stop").alias("t"))
    shared = ink.join(upper, ["img", "y"]).withColumn("n", F.least("stop", "t") - F.greatest("start", "s")).filter("n > 0").groupBy("img", "y").agg(F.sum("n").alias("n"))
    cuts = frame.filter("count_y > 1").select("img", "grid", F.explode(F.transform(F.sequence(F.lit(1), c("count_y") - 1), lambda i: c("margin_y") + i * c("pitch_y"))).alias("y"))
    cross_y = cuts.join(shared, ["img", "y"], "left").groupBy("img", "grid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cross_y"), F.count("*").alias("cuts"))
    wide = lines.filter("axis = 'x'").select("img", c("dim").alias("width"))
    told = reduce(lambda a, b: a.join(b, ["img", "grid"]), (held, cross_x), grid).join(cross_y, ["img", "grid"], "left").join(wide, "img")
    cross = _unit((c("cross_x") / (c("used") * F.greatest(F.lit(1), c("count_x") - 1)) + F.coalesce(c("cross_y") / (c("cuts") * c("width")), F.lit(0.0))) / 2)
    told = told.withColumns({"cross": cross, "coverage": c("filled") / (c("count_x") * c("count_y")), "outside": 1 - c("within") / c("all_ink")})
    both = lambda k: (c(f"{k}_x") + c(f"{k}_y")) / 2
    evidence = {"periodicity": both("periodicity"), "consistency": c("consistency"), "tiling": both("tiling"), "symmetry": both("symmetry"), "coverage": c("coverage"), "within": 1 - c("outside")}
    usual = lambda a: F.when(c(f"cell_{a}").isin(*CELLS), 1.0).otherwise(UNUSUAL)
    aspect = F.greatest("cell_x", "cell_y") / F.least("cell_x", "cell_y")
    lone = lambda a: F.when((c(f"count_{a}") == 1) & c(f"repeats_{a}"), 0.6).otherwise(1.0)
    score = _unit(sum(w * evidence[k] for k, w in GRID_WEIGHTS.items())) * (1 - _unit(F.greatest(F.lit(0.0), c("cross") - CROSSINGS) * 8)) * (1 - c("outside")) * (1 - _unit(c("split"))) * usual("x") * usual("y")
    told = told.withColumn("score", score * F.when(aspect > 8, 0.6).when(aspect > 4, 0.8).otherwise(1.0) * lone("x") * lone("y"))
    order = [F.desc(F.round("score", 9)), F.desc(c("count_x") * c("count_y")), "cell_x", "cell_y", "margin_x", "margin_y"]
    told = graph.settle(told.withColumn("n", F.row_number().over(Window.partitionBy("img").orderBy(*order))))
    top = told.filter("n = 1").select("img", *[c(k).alias(f"t_{k}") for k in ("cell_x", "cell_y", "margin_x", "margin_y", "spacing_x", "spacing_y", "pitch_x", "pitch_y", "score_x", "score_y", "score", "cross", "split")])
    same = reduce(lambda a, b: a & b, [c(k) == c(f"t_{k}") for k in ("margin_x", "margin_y", "spacing_x", "spacing_y")])
    divides = (c("t_pitch_x") % c("pitch_x") == 0) & (c("t_pitch_y") % c("pitch_y") == 0) & ((c("cell_x") < c("t_cell_x")) | (c("cell_y") < c("t_cell_y")))
    as_good = (c("score_x") >= c("t_score_x") - 0.005) & (c("score_y") >= c("t_score_y") - 0.005) & (c("score") >= c("t_score") - 0.12) | (c("score") >= c("t_score") - 0.03)
    finer = told.join(top, "img").withColumn("finer", same & divides & as_good & (c("cross") <= c("t_cross") + 0.01) & (c("split") <= c("t_split") + 0.01))
    final = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("finer"), *order)).cast("bigint")
    return finer.withColumn("place", final).select(
        "img", "cell_x", "cell_y", "margin_x", "margin_y", "spacing_x", "spacing_y", c("count_x").alias("columns"), c("count_y").alias("rows"), "filled", "consistency", "coverage", "cross", "outside", "split", "score", "place"
    )
