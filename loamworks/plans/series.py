"""Time series: zero-filled counts, rolling hours, spikes, episodes, hopping windows, limiters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import relational, sequences
from loamworks.plans.registry import query
from loamworks.session import table

TYPES = ("view", "click", "purchase", "signup", "error")
HOUR_MS = 3_600_000


def spine(ends: DataFrame, low: str, high: str, step: int, name: str) -> DataFrame:
    """Every step from low to high of each row."""
    rest = [c for c in ends.columns if c not in (low, high)]
    return ends.select(*rest, F.explode(F.sequence(F.col(low), F.col(high), F.lit(step).cast("bigint"))).alias(name))


@query(
    """WITH days AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, event_type FROM events),
    spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM days)::TIMESTAMP, (SELECT max(day) FROM days)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(s.day, '%Y-%m-%d') AS day, """
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in TYPES)
    + ", count(event_type) AS n_all FROM spine s LEFT JOIN days d ON s.day = d.day GROUP BY s.day"
)
def traffic_series_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type for every day of a +9 hour calendar; days without events count 0."""
    days = table(spark, sf_dir, "events").select(F.to_date(F.expr("ts + INTERVAL 9 HOURS")).alias("day"), "event_type")
    counts = days.groupBy("day").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES], F.count("event_type").alias("n_all"))
    all_days = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return all_days.join(counts, "day", "left").na.fill(0).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """WITH e AS (SELECT epoch_us(ts) // 1000 // 3600000 AS hour, event_type FROM events), m AS (SELECT max(hour) AS top FROM e),
    spine AS (SELECT unnest(generate_series(top - 23, top)) AS hour FROM m)
    SELECT s.hour, count(event_type) AS n_all, count(*) FILTER (WHERE event_type = 'error') AS n_error FROM spine s LEFT JOIN e ON e.hour = s.hour GROUP BY s.hour"""
)
def traffic_series_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 hours of data, zero-filled."""
    e = table(spark, sf_dir, "events").groupBy(F.floor(scalar.millis(F.col("ts")) / HOUR_MS).alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    hours = spine(e.agg((F.max("hour") - 23).alias("a"), F.max("hour").alias("b")), "a", "b", 1, "hour")
    return hours.join(e, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n_all"), F.coalesce("e", F.lit(0)).alias("n_error"))


_HOURS = """h AS (SELECT epoch_us(ts) // 1000 // 3600000 AS hour, user_id FROM events WHERE event_type = 'error'),
    ends AS (SELECT min(hour) AS a, max(hour) AS b FROM h), spine AS (SELECT unnest(generate_series(a, b)) AS hour FROM ends),
    c AS (SELECT s.hour, count(user_id) AS n, count(DISTINCT user_id) AS people FROM spine s LEFT JOIN h ON h.hour = s.hour GROUP BY s.hour),
    w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 0) / 168.0 AS base FROM c)"""


def error_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, n, people, base) for every hour: errors, people with errors, and the mean of the 168 hours before.

    One row an hour of all the data's time: that many rows and no more stand in the window without keys.
    """
    h = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.floor(scalar.millis(F.col("ts")) / HOUR_MS).alias("hour"), "user_id")
    counts = h.groupBy("hour").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"))
    hours = spine(counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")), "a", "b", 1, "hour").join(counts, "hour", "left").na.fill(0)
    week = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(-168, -1))
    return hours.withColumn("base", F.coalesce(week, F.lit(0)) / F.lit(168.0))


@query(f"WITH {_HOURS} SELECT hour, n, round(n + 0.75 * coalesce(lag(n) OVER (ORDER BY hour), 0), 6) AS rolling, round(base, 6) AS base FROM w")
def rolling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of an hour that began a quarter ago, blended with the hour before, and the trailing week's mean."""
    prev = F.coalesce(F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("hour")), F.lit(0))
    return error_hours(spark, sf_dir).select("hour", "n", F.round(F.col("n") + 0.75 * prev, 6).alias("rolling"), F.round("base", 6).alias("base"))


@query(
    f"""WITH {_HOURS}, hit AS (SELECT * FROM w WHERE n >= 5 AND people >= 3 AND n >= 1.5 * greatest(base, 0.34)),
    i AS (SELECT *, hour - row_number() OVER (ORDER BY hour) AS g FROM hit)
    SELECT min(hour) AS started, max(hour) + 1 AS ended, max(n) AS peak, max(people) AS people, max(hour) = (SELECT max(hour) FROM w) AS is_open FROM i GROUP BY g"""
)
def spike_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with many reports of several people, well over the trailing week; the last is open if it reaches the end."""
    hours = error_hours(spark, sf_dir).withColumn("end", F.max("hour").over(Window.partitionBy(F.lit(0))))
    hit = hours.filter((F.col("n") >= 5) & (F.col("people") >= 3) & (F.col("n") >= 1.5 * F.greatest("base", F.lit(0.34)))).withColumn("all", F.lit(0))
    runs = sequences.islands(hit, ["all"], ["hour"], F.col("hour") - sequences.before("hour", ["all"], ["hour"]) > 1)
    return runs.groupBy("island").agg(
        F.min("hour").alias("started"), (F.max("hour") + 1).alias("ended"), F.max("n").alias("peak"), F.max("people").alias("people"), (F.max("hour") == F.max("end")).alias("is_open")
    ).drop("island")


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS moment, event_id FROM events), g AS (SELECT *, coalesce(moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) > 7200000, true) AS s FROM e),
    i AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(k AS BIGINT) AS episode, min(moment) AS claimed, max(moment) AS refreshed, count(*) AS n FROM i GROUP BY user_id, k"""
)
def episode_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode is claimed once, refreshed while it goes on, and a new one starts after two quiet hours."""
    e = table(spark, sf_dir, "events").select("user_id", scalar.millis(F.col("ts")).alias("at"), "event_id")
    runs = sequences.islands(e, ["user_id"], ["at", "event_id"], F.col("at") - sequences.before("at", ["user_id"], ["at", "event_id"]) > 2 * HOUR_MS, "episode")
    return runs.groupBy("user_id", "episode").agg(F.min("at").alias("claimed"), F.max("at").alias("refreshed"), F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT epoch_us(ts) // 1000 AS moment, value FROM events WHERE value > 0),
    b AS (SELECT block, avg(value * value) AS power FROM (SELECT value, unnest(generate_series((moment - 3600000) // 900000 + 1, moment // 900000)) AS block FROM e) GROUP BY block),
    l AS (SELECT block, power, 10 * log10(power) AS loud FROM b WHERE 10 * log10(power) > 20), r AS (SELECT 10 * log10(avg(power)) - 3 AS gate FROM l)
    SELECT count(*) AS blocks, round(10 * log10(avg(power)), 6) AS loudness FROM l, r WHERE loud > gate"""
)
def loudness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness of one-hour blocks every quarter of an hour, after an absolute and a relative gate."""
    e = table(spark, sf_dir, "events").filter("value > 0").select(scalar.millis(F.col("ts")).alias("at"), "value")
    block = F.sequence(F.floor((F.col("at") - HOUR_MS) / 900_000) + 1, F.floor(F.col("at") / 900_000))
    power = e.select("value", F.explode(block).alias("block")).groupBy("block").agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    loud = power.withColumn("loud", 10 * F.log10("power")).filter("loud > 20")
    gate = loud.agg((10 * F.log10(F.avg("power")) - 3).alias("gate"))  # one row
    return loud.crossJoin(F.broadcast(gate)).filter("loud > gate").agg(F.count("*").alias("blocks"), F.round(10 * F.log10(F.avg("power")), 6).alias("loudness"))


@query(
    """SELECT user_id, epoch_us(ts) // 1000 // 60000 AS minute, count(*) AS n, least(count(*), 1) AS allowed FROM events GROUP BY ALL"""
)
def minute_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls a user and minute, and how many a limit of one lets through."""
    minute = F.floor(scalar.millis(F.col("ts")) / 60_000)
    return table(spark, sf_dir, "events").groupBy("user_id", minute.alias("minute")).agg(F.count("*").alias("n"), F.least(F.count("*"), F.lit(1)).alias("allowed"))


@query(
    """WITH o AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 400 AS operation, min((ts, event_id)) AS moment, count(*) - 1 AS replays FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY moment) AS place FROM o)
    SELECT user_id, day, operation, place, place <= 2 AS allowed, replays FROM k"""
)
def quota_authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first operations of a user and day are allowed; a replay gets the stored answer and counts nothing."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 400).alias("operation")).agg(
        F.min(F.struct("ts", "event_id")).alias("at"), (F.count("*") - 1).alias("replays")
    )
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("at")).cast("bigint")
    return rows.withColumn("place", place).select("user_id", "day", "operation", "place", (F.col("place") <= 2).alias("allowed"), "replays")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def webhook_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-order deliveries: the last by event time wins."""
    return relational.extremal(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), ["value"])


@query(
    """WITH a AS (SELECT user_id AS subject, count(*) AS used FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id + 40 AS subject, count(*) AS used FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(a.subject, b.subject) AS subject, greatest(coalesce(a.used, 0), coalesce(b.used, 0)) AS used FROM a FULL JOIN b ON a.subject = b.subject"""
)
def counter_carry_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters of one subject become the greater."""
    half = lambda k, shift: table(spark, sf_dir, "events").filter(F.col("event_id") % 2 == k).groupBy((F.col("user_id") + shift).alias("subject")).agg(F.count("*").alias(f"n{k}"))
    return half(0, 0).join(half(1, 40), "subject", "full").select("subject", F.greatest(F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))).alias("used"))


@query(
    """SELECT user_id, level, min(moment) AS first_at FROM (SELECT user_id, epoch_us(ts) // 1000 AS moment, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) t
    JOIN (VALUES (500), (1000), (2000)) v(level) ON total >= level GROUP BY ALL"""
)
def alert_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's total first reached each mark, exactly: values are added as they are written, so that a total of just the mark reaches it."""
    running = sequences.running_total("value", ["user_id"], ["ts", "event_id"])
    rows = table(spark, sf_dir, "events").select("user_id", scalar.millis(F.col("ts")).alias("at"), running.alias("total"))
    reached = lambda k: F.coalesce(F.col("total.exact") >= k, F.col("total.near") >= k)
    firsts = rows.groupBy("user_id").agg(*[F.min(F.when(reached(k), F.col("at"))).alias(f"m{k}") for k in (500, 1000, 2000)])
    marks = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"m{k}").alias("first_at")) for k in (500, 1000, 2000)])
    return firsts.select("user_id", F.inline(marks)).filter("first_at IS NOT NULL")
