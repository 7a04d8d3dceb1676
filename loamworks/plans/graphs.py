"""Closures, hops, propagation, rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.operators import brackets, graph
from loamworks.plans.registry import query
from loamworks.session import table

_EDGES = """edges AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): region to nation, nation to customer."""
    first = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return first.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b")))


@query(
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region
        UNION ALL SELECT root, b, depth + 1 FROM walk JOIN edges ON id = a WHERE depth < 2)
    SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id"""
)
def closure_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that stands below each region, two steps deep."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.closure(part_of(spark, sf_dir), roots, 2)


@query(
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS id, 0 AS depth FROM customer
        UNION ALL SELECT root, a, depth + 1 FROM walk JOIN edges ON id = b WHERE depth < 2)
    SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id"""
)
def closure_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that stands above each customer."""
    roots = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    up = part_of(spark, sf_dir).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return graph.closure(up, roots, 2)


@query(
    """SELECT a.s_suppkey, count(DISTINCT b.s_suppkey) AS reach FROM supplier a JOIN nation x ON a.s_nationkey = x.n_nationkey JOIN nation y ON x.n_regionkey = y.n_regionkey
    JOIN supplier b ON b.s_nationkey = y.n_nationkey WHERE a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey"""
)
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other suppliers stand in the same region: counted by region, not paired."""
    of = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    n = of.groupBy("n_regionkey").agg((F.count_distinct("s_suppkey") - 1).alias("reach"))
    return of.join(n, "n_regionkey").filter("reach > 0").select("s_suppkey", "reach")


@query(
    """WITH RECURSIVE s AS (SELECT p_partkey AS id, p_partkey % 7 AS state FROM part), d AS (SELECT p_partkey AS id, p_partkey // 3 AS needs FROM part WHERE p_partkey // 3 > 0),
    walk AS (SELECT id, id AS at FROM s UNION ALL SELECT w.id, d.needs FROM walk w JOIN d ON w.at = d.id)
    SELECT w.id, max(s.state) AS state FROM walk w JOIN s ON w.at = s.id GROUP BY w.id"""
)
def dep_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part takes the worst state of all that it depends on."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    needs = parts.select("id", F.floor(F.col("id") / 3).alias("needs")).filter("needs > 0")
    return graph.propagate(parts.select("id", (F.col("id") % 7).alias("state")), needs)


@query(
    """WITH RECURSIVE e AS (SELECT a.vec_id AS a, a.vec_id - a.vec_id % 5 AS b FROM embeddings a), w AS (SELECT vec_id AS id, vec_id AS c FROM embeddings
        UNION SELECT e2.x, w.c FROM w JOIN (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e) e2 ON w.id = e2.y)
    SELECT id, min(c) AS component FROM w GROUP BY id"""
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components over given edges."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    edges = v.select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 5).alias("b"))
    return graph.components(v, edges)


@query(
    """WITH RECURSIVE p AS (SELECT c_nationkey AS bracket, c_custkey AS id, c_acctbal AS strength, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS slot, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    r(bracket, round, slot, id, strength, n) AS (SELECT bracket, 0, slot, id, strength, n FROM p UNION ALL
        SELECT * FROM (SELECT bracket, round + 1, slot // 2, arg_max(id, (strength, -id)), max(strength), any_value((n + 1) // 2) FROM r WHERE n > 1 GROUP BY bracket, round, slot // 2))
    SELECT bracket, CAST(round AS INTEGER) AS round, slot, id FROM r WHERE round > 0"""
)
def tournament_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of each round of each nation's bracket: the stronger of each pair goes on; a slot without a partner has a bye."""
    by = Window.partitionBy("c_nationkey")
    first = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("bracket"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("strength"),
        (F.row_number().over(by.orderBy("c_custkey")) - 1).cast("bigint").alias("slot"), F.count("*").over(by).alias("n"),
    )
    # a round's winner is the strongest of the 2^round slots below it
    rounds = first.filter("n > 1").select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.log2("n")).cast("int"))).alias("round"))
    at = F.floor(F.col("slot") / F.pow(F.lit(2), F.col("round"))).alias("slot")
    return rounds.groupBy("bracket", "round", at).agg(F.max_by("id", F.struct("strength", -F.col("id"))).alias("id"))


def bracket_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brackets of eight customers each, the first with as many as there are, and an event for each order: its customer says to have won a match of theirs."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    seats = table(spark, sf_dir, "customer").select(F.floor(key / 8).alias("bracket"), (key % 8).cast("int").alias("slot"), key.alias("entrant"))
    every = seats.select("bracket").distinct().select("bracket", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot"))
    events = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 8).alias("bracket"), order.alias("seq"), (order % 3).cast("int").alias("round"), F.floor(F.col("o_custkey") % 8 / F.pow(F.lit(2), order % 3 + 1)).cast("int").alias("match"), F.col("o_custkey").alias("winner"))
    return every.join(seats, ["bracket", "slot"], "left"), events


@query()
def bracket_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of each bracket after all events, changed results included; held against a plain board in the tests."""
    return brackets.boards(*bracket_tables(spark, sf_dir))
