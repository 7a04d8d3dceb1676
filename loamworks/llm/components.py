"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.shared import materialize, release


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m) of ``pairs`` (u, v): the least of u and its vs.

    Written, so that a join with it shuffles both sides as they are read, which lets adaptive execution split a u that many pairs hold.
    """
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node with an edge can reach.

    edges: columns a and b, of one integer type; loops, repeats and nulls are ignored. No rows give no rows.
    Each round joins at most the edges there were with their least ends, and is written to the shared folder, so lineage stays short
    and a lost executor repeats one round at most. Raises RuntimeError if ``rounds`` don't suffice.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if found == mark or not found["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = found
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: each larger neighbour goes to the least one; only those pairs are carried, the least is taken over all
        least = _least(both)
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: a node and its smaller neighbours go to the least of them
        lower = _least(large)
        tied = large.join(lower, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = materialize(tied.filter("a <> b").distinct())
        for used in (now, least, large, lower):
            release(used)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
