"""Window functions: latest rows, numbering, history, runs, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import relational, sequences
from loamworks.plans.registry import query
from loamworks.session import table

NOW_MS = 1_706_745_600_000


@query(
    """SELECT event_type, count(*) AS users FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY event_type"""
)
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the type of their latest event."""
    last = relational.top_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("event_type").agg(F.count("*").alias("users"))


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS no FROM customer")
def dense_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without gaps in the order of creation."""
    no = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", no.alias("no"))


@query(
    f"""SELECT event_id FROM (SELECT event_id, epoch_us(ts) // 1000 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    WHERE k <= 5 OR (k <= 40 AND {NOW_MS} - moment <= {10 * scalar.DAY_MS})"""
)
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that retention keeps: some newest always, others by number and age."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", scalar.millis(F.col("ts")).alias("at"))
    return sequences.retain(ev, ["user_id"], "at", "event_id", NOW_MS, 5, 40, 10 * scalar.DAY_MS).select("event_id")


@query(
    """SELECT l_partkey, l_suppkey, l_shipdate, old_price, price FROM (SELECT l_partkey, l_suppkey, l_shipdate, l_extendedprice AS price,
        lag(l_extendedprice) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS old_price FROM lineitem) WHERE old_price <> price"""
)
def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of price, old to new."""
    rows = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice"))
    old = sequences.before("price", ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return rows.withColumn("old_price", old).filter("old_price <> price").select("l_partkey", "l_suppkey", "l_shipdate", "old_price", "price")


@query(
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_type, (ts, event_id)) AS oldest, arg_max(event_type, (ts, event_id)) AS newest, count(*) AS n FROM events GROUP BY ALL"""
)
def collapse_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for what a user did in a day: first, last, how often."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.min_by("event_type", at).alias("oldest"), F.max_by("event_type", at).alias("newest"), F.count("*").alias("n")
    )


@query(
    """WITH r AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w IS DISTINCT FROM event_type AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island HAVING count(*) >= 2"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more events of one type in a row."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    starts = ~sequences.before("event_type", ["user_id"], ["ts", "event_id"]).eqNullSafe(F.col("event_type"))
    runs = sequences.islands(ev, ["user_id"], ["ts", "event_id"], starts)
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n")).filter("n >= 2")


_DAILY = "SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, sum(value) AS y FROM events GROUP BY ALL"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").groupBy("event_type", d.alias("d")).agg(F.sum("value").alias("y"))


@query(f"SELECT event_type, CAST(d AS INTEGER) AS d, round(avg(y) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ({_DAILY})")
def smooth_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centered moving mean of daily sums, the window shrinking at the ends."""
    return _daily(spark, sf_dir).select("event_type", "d", F.round(sequences.moving_mean("y", ["event_type"], "d", 2), 6).alias("smooth"))


@query(
    f"""WITH y AS ({_DAILY}), k AS (SELECT event_type, d, CAST(row_number() OVER (PARTITION BY event_type ORDER BY d) AS DOUBLE) AS p, y FROM y),
    s AS (SELECT a.event_type, a.d, count(*) AS n, sum(b.p - a.p) AS m1, sum(pow(b.p - a.p, 2)) AS m2, sum(pow(b.p - a.p, 3)) AS m3, sum(pow(b.p - a.p, 4)) AS m4,
        sum(b.y) AS b0, sum(b.y * (b.p - a.p)) AS b1, sum(b.y * pow(b.p - a.p, 2)) AS b2 FROM k a JOIN k b ON a.event_type = b.event_type AND abs(a.p - b.p) <= 3 GROUP BY a.event_type, a.d, a.p)
    SELECT event_type, CAST(d AS INTEGER) AS d, round(CASE WHEN n >= 3 THEN (b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2))
        / (n * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)) ELSE b0 / n END, 1) AS smooth FROM s"""
)
def smooth_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local parabola through seven days."""
    rows = _daily(spark, sf_dir).withColumn("p", F.row_number().over(Window.partitionBy("event_type").orderBy("d")))
    return rows.select("event_type", "d", F.round(sequences.moving_quadratic("y", "p", ["event_type"], 3), 1).alias("smooth"))


@query(
    f"""WITH y AS ({_DAILY}), c AS (SELECT event_type, d, y - avg(y) OVER (PARTITION BY event_type) AS z FROM y)
    SELECT a.event_type, lag, round(sum(a.z * b.z) / (SELECT sum(z * z) FROM c WHERE c.event_type = a.event_type), 6) AS r
    FROM c a JOIN c b ON a.event_type = b.event_type JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS lag) ON b.d = a.d + lag GROUP BY a.event_type, lag"""
)
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of daily sums at lags of one to seven days, by leads over a gapless series."""
    z = _daily(spark, sf_dir).withColumn("z", F.col("y") - F.avg("y").over(Window.partitionBy("event_type")))
    w = Window.partitionBy("event_type").orderBy("d")
    by_day = lambda k: F.sum("z").over(w.rangeBetween(k, k))  # noqa: E731  the row k days on, if there is one
    rows = z.select("event_type", "z", *[by_day(k).alias(f"l{k}") for k in range(1, 8)])
    sums = rows.groupBy("event_type").agg(F.sum(F.col("z") * F.col("z")).alias("all"), *[F.sum(F.col("z") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, 8)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.round(F.col(f"s{k}") / F.col("all"), 6).alias("r")) for k in range(1, 8)])
    return sums.select("event_type", F.inline(pairs)).filter("r IS NOT NULL")


@query(
    """SELECT event_type, round(max(abs(v - p)), 6) AS max_abs, round(sqrt(avg((v - p) * (v - p))), 6) AS rms, round(avg(abs(v - p)), 6) AS mean_abs FROM (
        SELECT event_type, value AS v, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY event_type"""
)
def frame_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest, root mean square and mean change from row to row."""
    rows = sequences.before_in_blocks(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), "value", ["event_type"], F.to_date("ts"), ["ts", "event_id"])
    return rows.select("event_type", (F.col("value") - F.col("before")).alias("x")).filter("x IS NOT NULL").groupBy("event_type").agg(
        F.round(F.max(F.abs("x")), 6).alias("max_abs"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.round(F.avg(F.abs("x")), 6).alias("mean_abs")
    )


@query(
    """SELECT user_id, first, last, round(last - first, 6) AS seam FROM (SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY user_id)"""
)
def loop_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last."""
    at = F.struct("ts", "event_id")
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"))
    return ends.select("user_id", "first", "last", F.round(F.col("last") - F.col("first"), 6).alias("seam"))


@query(
    """SELECT adapter, CAST(max(streak) AS BIGINT) AS worst FROM (SELECT adapter, ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY adapter, grp ORDER BY ts, event_id) AS streak FROM (
        SELECT user_id % 10 AS adapter, event_type <> 'error' AS ok, ts, event_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS grp
        FROM events)) GROUP BY adapter"""
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures since a success."""
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("adapter"), (F.col("event_type") == "error").alias("bad"), "ts", "event_id")
    runs = sequences.islands_in_blocks(ev, ["adapter"], F.to_date("ts"), ["ts", "event_id"], ~F.col("bad"))
    return runs.groupBy("adapter", "island").agg(F.count_if("bad").alias("n")).groupBy("adapter").agg(F.max("n").alias("worst"))
