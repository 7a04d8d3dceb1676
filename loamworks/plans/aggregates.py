"""Counts, tiles, breakdowns, quantiles and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import relational
from loamworks.plans.registry import query
from loamworks.session import table

TYPES = ("view", "click", "purchase", "signup", "error")


@query(
    """SELECT CASE WHEN grouping(event_type) = 0 THEN 'type' WHEN grouping(weekday) = 0 THEN 'weekday' ELSE 'hour' END AS dim,
        coalesce(event_type, CAST(weekday AS VARCHAR), CAST(hour AS VARCHAR)) AS item, count(*) AS n
    FROM (SELECT event_type, isodow(ts) AS weekday, hour(ts) AS hour FROM events) GROUP BY GROUPING SETS ((event_type), (weekday), (hour))"""
)
def traffic_breakdown_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of counts by each of three dimensions."""
    ev = table(spark, sf_dir, "events").select("event_type", (F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour"))
    cells = ev.groupingSets([["event_type"], ["weekday"], ["hour"]], "event_type", "weekday", "hour").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    dim = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "weekday").otherwise("hour")
    return cells.select(dim.alias("dim"), F.coalesce("event_type", F.col("weekday").cast("string"), F.col("hour").cast("string")).alias("item"), "n")


@query(
    """SELECT event_type, user_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place
        FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3)) WHERE place <= 10"""
)
def top_users_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users with most events of each type, of those with three or more."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).filter("n >= 3")
    return relational.top_per_key(counts, ["event_type"], [F.desc("n"), F.col("user_id")], 10, "place")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), '#' || event_id)) AS people FROM events GROUP BY ALL")
def distinct_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact number of people a type and day; an event without a user is one of its own."""
    who = F.coalesce(F.col("user_id").cast("string"), F.concat(F.lit("#"), "event_id"))
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct(who).alias("people"))


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
        count(*) FILTER (WHERE o_totalprice >= 200000) AS n_large, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_value FROM orders"""
)
def conditional_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several counts in one pass and one row."""
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"),
        F.count_if(F.col("o_totalprice") >= 200000).alias("n_large"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0)), 2).alias("open_value"),
    )


@query("SELECT type_count.event_type, count(*) AS n FROM events type_count GROUP BY ALL")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT c_nationkey, CAST(sum(is_order) AS BIGINT) AS orders, CAST(sum(is_line) AS BIGINT) AS lines FROM (
        SELECT c_nationkey, 1 AS is_order, 0 AS is_line FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT c_nationkey, 0, 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) GROUP BY c_nationkey"""
)
def activity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of activity as indicator columns of one union."""
    owner = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(owner, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    both = orders.select("c_nationkey", F.lit(1).alias("o"), F.lit(0).alias("l")).unionByName(lines.select("c_nationkey", F.lit(0).alias("o"), F.lit(1).alias("l")))
    return both.groupBy("c_nationkey").agg(F.sum("o").alias("orders"), F.sum("l").alias("lines"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def listagg_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered list of what each user did."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1"""
)
def latest_row_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and price of each customer's latest order, from the extremal row."""
    return relational.extremal(table(spark, sf_dir, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_totalprice"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def month_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_brand, count(*) AS n, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.25), 6) AS q1,
        round(quantile_cont(p_retailprice, 0.75), 6) AS q3, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand"""
)
def quantiles_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated median and quartiles, with extremes."""
    q = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")
    )
    return q.select("p_brand", "n", *[F.round(F.col("q")[i], 6).alias(k) for i, k in ((1, "median"), (0, "q1"), (2, "q3"))], "low", "high")


@query(
    """SELECT event_type, CASE WHEN count(*) < 20 THEN 10.0 ELSE greatest(5.0, least(100.0, list_sort(list(value))[CAST(floor(count(*) * 0.9) AS INT) + 1])) END AS threshold
    FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def p90_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90th percentile by floored index, clamped to 5..100; found by rank, first among whole values and then within one, so that no key's values meet in one row or task."""
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_type", "value")
    counted = rows.groupBy("event_type", "value").agg(F.count("*").alias("c")).withColumn("whole", F.floor("value"))
    ordered = lambda by, keys: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    wholes = counted.groupBy("event_type", "whole").agg(F.sum("c").alias("n")).withColumn("upto", F.sum("n").over(ordered("whole", ["event_type"])))
    total = wholes.groupBy("event_type").agg(F.sum("n").alias("all")).withColumn("rank", F.floor(F.col("all") * F.lit(0.9)))
    held = wholes.join(total, "event_type").filter("upto > rank AND upto - n <= rank").select("event_type", "whole", (F.col("upto") - F.col("n")).alias("before"), "rank", "all")
    near = counted.join(held, ["event_type", "whole"]).withColumn("upto", F.col("before") + F.sum("c").over(ordered("value", ["event_type"])))
    found = near.filter("upto > rank").groupBy("event_type").agg(F.min("value").alias("v"), F.first("all").alias("n"))
    return found.select("event_type", F.when(F.col("n") < 20, F.lit(10.0)).otherwise(F.greatest(F.lit(5.0), F.least(F.lit(100.0), "v"))).alias("threshold"))


@query(
    """SELECT p_brand, l_returnflag, count(*) AS n, round(median(l_extendedprice), 3) AS median FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_extendedprice, l_returnflag) AS k FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE k = 1
        GROUP BY ALL HAVING count(*) >= 3"""
)
def median_min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of groups with three samples or more, the first of each id counted."""
    first = relational.extremal(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], F.struct("l_linenumber", "l_extendedprice", "l_returnflag"), ["l_returnflag", "l_extendedprice"], greatest=False)
    rows = first.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.median("l_extendedprice"), 3).alias("median")).filter("n >= 3")


@query(
    """WITH v AS (SELECT event_id % 40 AS target, user_id, epoch_us(ts) // 1000 AS moment, CASE event_type WHEN 'error' THEN 'broken' WHEN 'click' THEN 'works_with_issues' ELSE 'works' END AS result,
        CASE user_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 3.0 END AS w0 FROM events),
    l AS (SELECT *, w0 * pow(0.5, greatest(0.0, 1706745600000 - moment) / 5184000000.0) AS w FROM (SELECT *, row_number() OVER (PARTITION BY target, user_id ORDER BY moment DESC, result) AS k FROM v) WHERE k = 1),
    s AS (SELECT target, count(*) AS users, sum(CASE WHEN result <> 'broken' THEN w ELSE 0 END) AS pos, sum(CASE WHEN result = 'works_with_issues' THEN w ELSE 0 END) AS iss,
        sum(CASE WHEN result = 'broken' THEN w ELSE 0 END) AS neg, count(*) FILTER (WHERE result <> 'broken') AS np, count(*) FILTER (WHERE result = 'broken') AS nn FROM l GROUP BY target),
    m AS (SELECT *, least(pos / (pos + neg), 1 - pos / (pos + neg)) AS minority FROM s)
    SELECT target, users, round(pos, 6) AS positive, round(neg, 6) AS negative, CASE WHEN pos >= neg THEN CASE WHEN iss >= 0.4 * pos THEN 'works_with_issues' ELSE 'works' END ELSE 'broken' END AS verdict,
        CASE WHEN np > 0 AND nn > 0 AND minority >= 0.3 THEN 'DISPUTED' WHEN (CASE WHEN pos >= neg THEN np ELSE nn END) >= 3 AND greatest(pos, neg) >= 1.5 AND minority < 0.2
            THEN 'COMMUNITY_VERIFIED' ELSE 'COMMUNITY' END AS trust FROM m"""
)
def vote_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life weighted verdicts, the latest report of a user counting."""
    result = F.when(F.col("event_type") == "error", "broken").when(F.col("event_type") == "click", "works_with_issues").otherwise("works")
    votes = table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("target"), "user_id", scalar.millis(F.col("ts")).alias("at"), result.alias("result"))
    tier = F.element_at(F.array(*map(F.lit, (0.5, 1.0, 2.0, 3.0))), (F.col("user_id") % 4 + 1).cast("int"))
    out = relational.vote_verdict(votes, "target", "user_id", "at", "result", tier, 1_706_745_600_000, 60.0 * scalar.DAY_MS)
    return out.withColumns({c: F.round(c, 6) for c in ("positive", "negative")})


@query(
    """SELECT coalesce(event_type, '*') AS event_type, coalesce(band, '*') AS band, n, CASE WHEN n >= 5 THEN floor(100.0 * yes / n + 0.5) END AS pct, CAST(level AS BIGINT) AS level FROM (
        SELECT event_type, band, count(*) AS n, count(*) FILTER (WHERE has) AS yes, grouping(event_type, band) AS level
        FROM (SELECT event_type, CAST(hour(ts) // 6 AS VARCHAR) AS band, value >= 50 AS has FROM events) GROUP BY GROUPING SETS ((), (event_type), (band), (event_type, band)))"""
)
def rollout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in all cells of two dimensions, small cells suppressed."""
    votes = table(spark, sf_dir, "events").select("event_type", F.floor(F.hour("ts") / 6).cast("string").alias("band"), (F.col("value") >= 50).alias("has"))
    cells = relational.suppressed_share(votes, ["event_type", "band"], F.col("has"))
    return cells.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("event_type", "band")}).withColumn("pct", F.col("pct").cast("double"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, k LIMIT 12")
def list_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve commonest values inside a JSON column."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(12)


@query(
    """SELECT s_nationkey, round(sum(s_acctbal), 2) AS total, count(*) AS n, CASE WHEN bool_or(s_acctbal < 0) THEN NULL ELSE round(quantile_cont(s_acctbal, 0.5), 6) END AS median
    FROM supplier GROUP BY s_nationkey"""
)
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary that any bad value voids."""
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.round(F.sum("s_acctbal"), 2).alias("total"), F.count("*").alias("n"), F.when(~F.bool_or(F.col("s_acctbal") < 0), F.round(F.median("s_acctbal"), 6)).alias("median")
    )


@query(
    """SELECT l_suppkey, period, round(q, 2) AS used, round(sum(q) OVER (PARTITION BY l_suppkey ORDER BY period), 2) AS to_date FROM (
        SELECT l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 30 AS period, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)"""
)
def usage_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use a period, and up to it."""
    period = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) / 30)
    used = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", period.alias("period")).agg(F.sum("l_quantity").alias("q"))
    run = F.sum("q").over(Window.partitionBy("l_suppkey").orderBy("period").rowsBetween(Window.unboundedPreceding, 0))
    return used.select("l_suppkey", "period", F.round("q", 2).alias("used"), F.round(run, 2).alias("to_date"))


@query(
    """SELECT bucket_r, bucket_g, bucket_b, count(*) AS n, round(sum(w), 6) AS weight FROM (SELECT CAST(floor((embedding[1] + 1) * 16) AS INTEGER) AS bucket_r,
        CAST(floor((embedding[2] + 1) * 16) AS INTEGER) AS bucket_g, CAST(floor((embedding[3] + 1) * 16) AS INTEGER) AS bucket_b, abs(CAST(embedding[4] AS DOUBLE)) AS w FROM embeddings) GROUP BY ALL"""
)
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted counts of three quantised components."""
    at = lambda i: F.floor((F.col("embedding")[i] + 1) * 16).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(at(0).alias("bucket_r"), at(1).alias("bucket_g"), at(2).alias("bucket_b"), F.abs(F.col("embedding")[3].cast("double")).alias("w"))
    return rows.groupBy("bucket_r", "bucket_g", "bucket_b").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))
