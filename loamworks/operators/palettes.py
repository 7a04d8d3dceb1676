"""Palettes of images: weighted median cut in Oklab with boxes as rows, then Lloyd steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions import colour
from loamworks.operators import graph
from loamworks.operators.relational import top_per_key

#: Lloyd steps after the cut.
STEPS = 4
_AXES = ("l", "a", "b")


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + 0.5).cast("int")


def _lab(*channels: str) -> dict[str, Column]:
    return dict(zip(_AXES, colour.oklab(*[F.col(c) / 255.0 for c in channels])))


def colours(px: DataFrame, image: str = "img") -> DataFrame:
    """(image, key, red, green, blue, weight, l, a, b): the mean colour of each 5-bit key that an image holds, weighted by opacity, in Oklab too; at most 32768 rows an image.

    px: (image, r, g, b, a), 0 to 255. Pixels without opacity, or with nulls, count nowhere.
    """
    w = F.col("a") / 255.0
    key = sum(F.shiftright(F.col(c).cast("int"), 3) * m for c, m in (("r", 1024), ("g", 32), ("b", 1)))
    seen = px.filter("a > 0 AND r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").select(image, key.alias("key"), w.alias("weight"), *[(F.col(c) * w).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
    sums = seen.groupBy(image, "key").agg(*[F.sum(c).alias(c) for c in ("weight", "red", "green", "blue")])
    mean = sums.select(image, "key", *[(F.col(c) / F.col("weight")).alias(c) for c in ("red", "green", "blue")], "weight")
    whole = mean.withColumns({f"_{c}": rounded(F.col(c)) for c in ("red", "green", "blue")})
    return whole.withColumns(_lab("_red", "_green", "_blue")).drop("_red", "_green", "_blue")


def median_cut(points: DataFrame, image: str, count: int) -> DataFrame:
    """``points`` with the ``box`` that each falls into: texts of 0 and 1, in whose order the boxes come; at most ``count`` an image.

    One box of all points is split at the weighted median of its widest axis, then the box of the greatest width times weight, and so on. A box's halves weigh less than it and
    are no wider, so the boxes that are split are those with the ``count`` - 1 greatest products of all that splitting gives, whichever comes first: boxes are split level
    by level, all images' at once, as long as they are among them. Equal products go by box, equal values of an axis by key.
    """
    now = graph.settle(points.withColumns({"box": F.lit(""), "open": F.lit(True)}))
    known = None
    while True:
        wide = now.filter("open").groupBy(image, "box").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"), F.array(*[F.max(x) - F.min(x) for x in _AXES]).alias("ranges"))
        scored = wide.withColumn("score", F.array_max("ranges") * F.col("mass")).filter("n > 1 AND score > 0")
        scored = scored.select(image, "box", "score", "mass", (F.array_position("ranges", F.array_max("ranges")) - 1).cast("int").alias("axis"), F.lit(True).alias("fresh"))
        every = scored if known is None else known.withColumn("fresh", F.lit(False)).unionByName(scored)
        before, known = known, graph.settle(top_per_key(every, [image], [F.desc("score"), F.col("box")], count - 1))
        if before is not None:
            graph.drop_settled(before)
        split = known.filter("fresh").select(image, "box", "mass", "axis")
        if split.isEmpty():
            break
        joined = now.join(split, [image, "box"], "left")
        value = F.when(F.col("axis") == 0, F.col("l")).when(F.col("axis") == 1, F.col("a")).otherwise(F.col("b"))
        order = Window.partitionBy(image, "box").orderBy("value", "key")
        told = joined.withColumn("value", value).withColumns({"lighter": F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "last": F.lead("key").over(order).isNull()})
        half = F.when((F.col("lighter") < F.col("mass") / 2) & ~F.col("last"), "0").otherwise("1")
        after = graph.settle(told.select(*points.columns, F.when(F.col("mass").isNull(), F.col("box")).otherwise(F.concat("box", half)).alias("box"), F.col("mass").isNotNull().alias("open")))
        graph.drop_settled(now)
        now = after
    # splits that later ones outdid are undone: a point's box is as long as its ancestors among the chosen are many
    chosen = known.groupBy(image).agg(F.collect_set("box").alias("chosen"))  # count - 1 an image
    depth = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.length("box")), lambda n: F.left(F.col("box"), n)), lambda p: F.array_contains("chosen", p)))
    return now.join(chosen, image, "left").withColumn("box", F.when(F.col("chosen").isNull(), "").otherwise(F.left(F.col("box"), depth))).select(*points.columns, "box")


def lloyd(points: DataFrame, palette: DataFrame, image: str, steps: int = STEPS) -> DataFrame:
    """``palette`` (image, place, red, green, blue) after so many steps: points go to the entry that is nearest in Oklab, of equally near ones to the first, and entries become their weighted means; an entry without points stays."""
    for _ in range(steps):
        labs = palette.withColumns({f"p{k}": v for k, v in _lab("red", "green", "blue").items()})
        # at most as many entries as the palette has
        held = labs.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("place", "pl", "pa", "pb"))).alias("entries"))
        away = lambda e: F.pow(F.col("l") - e["pl"], 2) + F.pow(F.col("a") - e["pa"], 2) + F.pow(F.col("b") - e["pb"], 2)
        near = F.array_min(F.transform("entries", lambda e: F.struct(away(e).alias("d"), e["place"].alias("place"))))["place"]
        sums = points.join(held, image).withColumn("place", near).groupBy(image, "place").agg(F.sum("weight").alias("w"), *[F.sum(F.col(c) * F.col("weight")).alias(f"s_{c}") for c in ("red", "green", "blue")])
        moved = [F.coalesce(rounded(F.col(f"s_{c}") / F.col("w")), F.col(c)).alias(c) for c in ("red", "green", "blue")]
        palette = graph.settle(palette.join(sums, [image, "place"], "left").select(image, "place", *moved))
    return palette


def palettes(px: DataFrame, image: str, count: int, steps: int = STEPS) -> DataFrame:
    """(image, place bigint, red, green, blue int): a palette of at most ``count`` colours for each image, see ``median_cut`` and ``lloyd``; places from 0. Images without visible pixels have none."""
    points = graph.settle(colours(px, image))
    boxes = median_cut(points, image, count).groupBy(image, "box").agg(F.sum("weight").alias("w"), *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("red", "green", "blue")])
    place = (F.row_number().over(Window.partitionBy(image).orderBy("box")) - 1).cast("bigint")
    return lloyd(points, graph.settle(boxes.select(image, place.alias("place"), *[rounded(F.col(c) / F.col("w")).alias(c) for c in ("red", "green", "blue")])), image, steps)
