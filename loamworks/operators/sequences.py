"""Operators over ordered rows: islands, episodes, smoothing, retention, autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of each key's rows from 1; a run starts where ``starts`` holds, which may look at the row before."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("bigint")).withColumn(name, F.sum("_starts").over(run)).drop("_starts")


def before(column: str, keys: list[str], order: list[str], n: int = 1) -> Column:
    """A column's value n rows before."""
    return F.lag(column, n).over(Window.partitionBy(*keys).orderBy(*order))


def retain(df: DataFrame, keys: list[str], at: str, tie: str, now: int, always: int = 20, most: int = 1000, max_age: int = 90 * 86_400_000) -> DataFrame:
    """Keeps the newest ``always`` rows of each key, and of the others those among the newest ``most`` and not older than ``max_age``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))
    kept = df.withColumn("_place", place).filter((F.col("_place") <= always) | ((F.col("_place") <= most) & (F.lit(now) - F.col(at) <= max_age)))
    return kept.drop("_place")


def moving_mean(column: str, keys: list[str], order: str, half: int) -> Column:
    """Centered mean over 2 half + 1 rows, fewer at the ends."""
    return F.avg(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def moving_quadratic(column: str, position: str, keys: list[str], half: int) -> Column:
    """Value at the row itself of the parabola fitted to the centered window by least squares; the mean where fewer than three rows are in it.

    position: consecutive integers. Solved from sums over the window, in closed form.
    """
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(-half, half)
    # positions relative to the row itself: a window function can't see the current row inside its sum, so powers are shifted afterwards
    p, y = F.col(position).cast("double"), F.col(column).cast("double")
    s = [F.sum(F.pow(p, F.lit(float(k)))).over(w) for k in range(5)]
    t = [F.sum(y * F.pow(p, F.lit(float(k)))).over(w) for k in range(3)]
    n, c = s[0], p
    m1 = s[1] - c * n
    m2 = s[2] - 2 * c * s[1] + c * c * n
    m3 = s[3] - 3 * c * s[2] + 3 * c * c * s[1] - c * c * c * n
    m4 = s[4] - 4 * c * s[3] + 6 * c * c * s[2] - 4 * c * c * c * s[1] + c * c * c * c * n
    b0, b1, b2 = t[0], t[1] - c * t[0], t[2] - 2 * c * t[1] + c * c * t[0]
    det = n * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)
    top = b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2)
    return F.when(n >= 3, top / det).otherwise(b0 / n)


def running_total(column: str, keys: list[str], order: list[str]) -> Column:
    """struct(exact, near) of the doubles up to each row of its key: their sum as decimals, which no order of adding changes, and as doubles.

    Doubles count as the shortest decimals that mean them, to 18 places, so 0.1 ten times is 1. exact is null from the first value of 10^12 or more, or none of finite size, on; there near has to
    do. Nulls add nothing, and both are null until the first value.
    """
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(column)
    small = F.abs(value) < 1e12
    exact = F.try_sum(F.when(small, value).cast("decimal(38,18)")).over(run)
    return F.struct(F.when(F.count_if(~small).over(run) == 0, exact).alias("exact"), F.sum(value).over(run).alias("near"))


def before_in_blocks(rows: DataFrame, value: str, keys: list[str], block: Column, order: list[str], name: str = "before") -> DataFrame:
    """Adds the value of the row before within the keys, where ``block`` never falls along the order: lags are taken within blocks, and a block's first row gets the last of the block before."""
    marked = rows.withColumn("_block", block)
    last = marked.groupBy(*keys, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    edges = last.withColumn("_carried", carried["v"]).drop("_last")
    own = Window.partitionBy(*keys, "_block").orderBy(*order)
    joined = marked.withColumn("_lag", F.lag(value).over(own)).withColumn("_first", F.row_number().over(own) == 1).join(edges, [*keys, "_block"])
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).select(*rows.columns, name)


def islands_in_blocks(rows: DataFrame, keys: list[str], block: Column, order: list[str], starts: Column) -> DataFrame:
    """Adds ``island``: how many rows up to this one start an island, within the keys, where ``block`` never falls along the order."""
    marked = rows.withColumn("_block", block).withColumn("_start", F.coalesce(starts, F.lit(False)).cast("bigint"))
    sums = marked.groupBy(*keys, "_block").agg(F.sum("_start").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_start").over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(sums.withColumn("_before", before).drop("_n"), [*keys, "_block"]).withColumn("island", F.col("_own") + F.col("_before")).select(*rows.columns, "island")
