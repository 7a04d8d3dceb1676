"""Joins, set operations, paging and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import relational
from loamworks.plans.registry import query
from loamworks.session import table

#: Quantisations with bits per weight, in the order of precision.
QUANTS = (("F16", 16.0), ("Q8", 8.5), ("Q6", 6.6), ("Q5", 5.7), ("Q4", 4.8), ("Q3", 3.9))
#: Orders, about, that a task works on.
ORDERS_A_PART = 100_000
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def edge_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at the other side of each region's edges, as one list."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_regionkey", "r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def semi_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order."""
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_custkey")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'O')")
def anti_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an open order."""
    open_ = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O").select("o_custkey")
    return table(spark, sf_dir, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    """SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS newest FROM supplier"""
)
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and newest row of each supplier, zero and null for none."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("newest"))
    out = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("lines"), "newest")


@query(
    """SELECT node, count(*) AS edges FROM (SELECT DISTINCT n_nationkey AS node, o_orderkey FROM nation, (SELECT o_orderkey, c_nationkey AS a, s_nationkey AS b FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1) WHERE n_nationkey = a OR n_nationkey = b) GROUP BY node"""
)
def or_join_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a node at either end, by an equi join on their ends.

    Each order's rows stay in the part that it was dealt to, and parts are as many as the orders ask for, so what a task holds of orders doesn't grow with the table.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = 1 + orders.count() // ORDERS_A_PART
    first = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").repartition(parts, "l_orderkey")
    edges = orders.repartition(parts, "o_orderkey").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = edges.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
    edges = edges.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return relational.either_end(edges.select("o_orderkey", "a", "b"), nodes, "a", "b", "node").select("node", "o_orderkey").distinct().groupBy("node").agg(F.count("*").alias("edges"))


@query(
    """SELECT o_orderkey, coalesce(epoch_us(e.ts) // 1000, -1) AS seen_at, coalesce(e.event_id, -1) AS event_id FROM (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey % 700) AS moment FROM orders) o
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o.user_id = e.user_id AND o.moment >= e.ts"""
)
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of the same user at or before each order's time."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(o_orderkey % 700 AS INT))")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), at.alias("at"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.col("ts").alias("seen_at"), "event_id")
    return relational.as_of(orders, events, "user_id", "at", "ts", ["seen_at", "event_id"]).select(
        "o_orderkey", F.coalesce(scalar.millis(F.col("seen_at")), F.lit(-1)).alias("seen_at"), F.coalesce("event_id", F.lit(-1)).alias("event_id")
    )


@query(
    "WITH q(name, bpw, ord) AS (VALUES " + ", ".join(f"('{n}', {b}, {i})" for i, (n, b) in enumerate(QUANTS)) + """),
    g AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS params FROM part), b(gib) AS (VALUES (8.0), (16.0), (24.0), (48.0)),
    x AS (SELECT params, gib, name, ord, params * 1e9 * bpw / 8 AS weights FROM g, q, b),
    y AS (SELECT *, weights + 0.5 * 1073741824 AS low, weights * 1.05 + 1073741824 AS high, gib * 1073741824 AS vram FROM x),
    z AS (SELECT *, CASE WHEN low > vram THEN 'does_not_fit' WHEN high > 0.9 * vram THEN 'tight' ELSE 'fits' END AS verdict FROM y)
    SELECT params, gib, coalesce(arg_min(name, ord) FILTER (WHERE verdict = 'fits'), arg_min(name, ord) FILTER (WHERE verdict = 'tight')) AS best,
        count(*) FILTER (WHERE verdict = 'fits') AS n_fits FROM z GROUP BY params, gib"""
)
def cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most precise quantisation of each model size that fits each memory; the fixed side of the product is spelled out per row."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("params")).distinct()
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("bpw"), F.lit(i).alias("ord")) for i, (n, b) in enumerate(QUANTS)])
    rows = sizes.withColumn("gib", F.explode(F.array(*map(F.lit, (8.0, 16.0, 24.0, 48.0))))).select("params", "gib", F.inline(options))
    weights, vram, gib = F.col("params") * 1e9 * F.col("bpw") / 8, F.col("gib") * 1073741824, 1073741824
    verdict = F.when(weights + 0.5 * gib > vram, "does_not_fit").when(weights * 1.05 + gib > 0.9 * vram, "tight").otherwise("fits")
    best = lambda v: F.min_by("name", F.when(F.col("verdict") == v, F.col("ord")))
    return rows.withColumn("verdict", verdict).groupBy("params", "gib").agg(F.coalesce(best("fits"), best("tight")).alias("best"), F.count_if(F.col("verdict") == "fits").alias("n_fits"))


@query("SELECT p_brand, " + ", ".join(f"count(*) FILTER (WHERE p_size = {i}) AS size_{i}" for i in range(1, 11)) + " FROM part GROUP BY p_brand")
def pivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by sizes."""
    cells = table(spark, sf_dir, "part").groupBy("p_brand").pivot("p_size", list(range(1, 11))).count()
    return cells.select("p_brand", *[F.coalesce(str(i), F.lit(0)).alias(f"size_{i}") for i in range(1, 11)])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 51")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page before a cursor, with one row more to tell whether there is another."""
    return table(spark, sf_dir, "orders").filter("o_orderkey < 9000").orderBy(F.desc("o_orderkey")).limit(51).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 40")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty rows, and one more."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(21).select("o_orderkey", "o_totalprice")


@query(
    "SELECT o_orderkey, o_orderpriority, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(["
    + ", ".join(f"'{p}'" for p in PRIORITIES) + "], o_orderpriority), o_orderkey) AS place FROM orders) WHERE place <= 2"
)
def ordered_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's two orders that come first by an ordered enumeration."""
    top = relational.top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [scalar.rank_in(F.col("o_orderpriority"), PRIORITIES), F.col("o_orderkey")], 2, "place")
    return top.select("o_orderkey", "o_orderpriority", "place")


@query(
    """SELECT p_partkey, v, row_number() OVER (ORDER BY a, b, c, p_partkey) AS place FROM (SELECT p_partkey, a || '.' || b || '.' || c AS v, a, b, c
        FROM (SELECT p_partkey, p_partkey % 3 AS a, p_partkey % 17 AS b, p_partkey % 101 AS c FROM part))"""
)
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's place in the order of their versions' numbers."""
    v = F.concat_ws(".", F.col("p_partkey") % 3, F.col("p_partkey") % 17, F.col("p_partkey") % 101)
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).withColumn("key", scalar.version_sort_key(F.col("v")))
    return relational.places(rows, ["key", "p_partkey"]).select("p_partkey", "v", "place")


@query("SELECT o_orderkey, round((3 * up + 2 * comments + views / 50.0) / (age + 2), 9) AS hot FROM (SELECT o_orderkey, o_orderkey % 37 AS up, o_orderkey % 11 AS comments, o_custkey AS views, o_orderkey % 500 AS age FROM orders) ORDER BY (3 * up + 2 * comments + views / 50.0) / (age + 2) DESC, o_orderkey LIMIT 40")
def hot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty hottest posts."""
    key = F.col("o_orderkey")
    hot = (3 * (key % 37) + 2 * (key % 11) + F.col("o_custkey") / 50.0) / (key % 500 + 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", hot.alias("h")).orderBy(F.desc("h"), "o_orderkey").limit(40).select("o_orderkey", F.round("h", 9).alias("hot"))
