"""Relational operators: latest rows, top rows, as-of and either-end joins, verdicts, suppressed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order that must be total; their place as ``rank``, if named.

    Spark keeps n rows a key and task before it shuffles.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    out = df.withColumn("_place", place).filter(F.col("_place") <= n)
    return out.withColumnRenamed("_place", rank) if rank else out.drop("_place")


def extremal(df: DataFrame, keys: list[str], order: Column, columns: list[str], greatest: bool = True) -> DataFrame:
    """The columns of the row with the greatest (or least) order of each key, by one aggregation without sorting."""
    pick = (F.max_by if greatest else F.min_by)(F.struct(*columns), order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Rows of ``left`` with the columns of the last row of ``right`` of the same key at or before their time; nulls if there is none.

    One shuffle of both sides together: no join is spread over all earlier rows. Rows of ``right`` with equal times are taken by their columns.
    """
    value = F.struct(F.col(right_time), *columns)
    both = left.withColumn("_right", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).withColumn("_at", F.col(left_time)).withColumn("_left", F.lit(1))
    marks = right.select(F.col(key), value.alias("_right"), F.col(right_time).alias("_at"), F.lit(0).alias("_left"))
    order = Window.partitionBy(key).orderBy("_at", "_left", "_right").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(marks, allowMissingColumns=True).withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).filter("_left = 1")
    return joined.select(*left.columns, *[F.col("_seen")[c].alias(c) for c in columns])


def either_end(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """(node, edge columns) for each edge that touches a node at either end: one equi join on an edge's distinct ends instead of one on OR, so edges are worked out once. A null end touches nothing."""
    ends = edges.withColumn(node, F.explode(F.array_distinct(F.array(a, b))))
    return nodes.select(node).join(ends, node)


def vote_verdict(votes: DataFrame, key: str, user: str, at: str, result: str, weight: Column, now_ms: int, half_life_ms: float) -> DataFrame:
    """Weighted verdict of each key from the latest report of each user, weights halving with age.

    result: works, works_with_issues or broken. Ties in time keep the least result. Columns: key, users, positive, negative, verdict, trust.
    """
    last = top_per_key(votes, [key, user], [F.desc(at), F.col(result)])
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col(at)).cast("double"))
    w = weight * F.pow(F.lit(0.5), age / half_life_ms)
    part = lambda r: F.sum(F.when(F.col(result) == r, w).otherwise(0.0))
    sums = last.groupBy(key).agg(
        F.count("*").alias("users"), part("works").alias("works"), part("works_with_issues").alias("issues"), part("broken").alias("negative"),
        F.count_if(F.col(result) != "broken").alias("n_pos"), F.count_if(F.col(result) == "broken").alias("n_neg"),
    )
    positive = F.col("works") + F.col("issues")
    share = positive / (positive + F.col("negative"))
    minority = F.least(share, 1 - share)
    good = positive >= F.col("negative")
    verdict = F.when(good, F.when(F.col("issues") >= 0.4 * positive, "works_with_issues").otherwise("works")).otherwise("broken")
    side = F.when(good, F.col("n_pos")).otherwise(F.col("n_neg"))
    heavy = F.greatest(positive, F.col("negative"))
    trust = (
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (minority >= 0.3), "DISPUTED")
        .when((side >= 3) & (heavy >= 1.5) & (minority < 0.2), "COMMUNITY_VERIFIED")
        .otherwise("COMMUNITY")
    )
    return sums.select(key, "users", positive.alias("positive"), "negative", verdict.alias("verdict"), trust.alias("trust"))


def suppressed_share(votes: DataFrame, keys: list[str], has: Column, least: int = 5) -> DataFrame:
    """(keys, n, pct) over grouping sets of no key, each key and all keys; pct is null where fewer than ``least`` voted."""
    sets = [[], *[[k] for k in keys], *([keys] if len(keys) > 1 else [])]
    cells = votes.groupingSets(sets, *keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(has).alias("yes"))
    return cells.withColumn("pct", F.when(F.col("n") >= least, F.floor(100 * F.col("yes") / F.col("n") + 0.5))).drop("yes")


def places(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in an order over all rows: ranges are ordered each in its task, and a range starts after the rows of those before."""
    from loamworks.operators.graph import settle

    # written, since a range's bounds are sampled and must be the same for all that follows
    dealt = settle(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(before.select("_range", "_before"), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def blocked_places(rows: DataFrame, keys: list[str], block: Column, order: list[Column], descending: bool = False, name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, among those of its keys, where ``block`` never falls along the order (never rises, if ``descending``).

    Rows are numbered within blocks, and a block starts after the rows of those before, so that a key with a third of all rows is no one task's.
    """
    marked = rows.withColumn("_block", block)
    by = F.desc_nulls_last("_block") if descending else F.asc_nulls_last("_block")
    sizes = marked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_before")
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = marked.withColumn("_own", own).join(offsets, same).withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint"))
    return out.select(*rows.columns, name)
