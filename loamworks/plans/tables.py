"""Versioned tables: history, ingest, conflicts, states, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import graph, temporal
from loamworks.plans.registry import query
from loamworks.session import table
from loamworks.streaming import late

T0, T1 = 1_700_000_000_000, 1_700_200_000_000


@query(
    """WITH o AS (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag AS value, lag(l_returnflag) OVER w AS b, row_number() OVER w AS k FROM lineitem
        WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber)), c AS (SELECT * FROM o WHERE k = 1 OR value IS DISTINCT FROM b)
    SELECT l_partkey, value, l_shipdate AS valid_from, lead(l_shipdate) OVER w AS valid_until, lead(l_shipdate) OVER w IS NULL AS is_current FROM c
        WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber)"""
)
def scd2_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a part's flag as current and closed rows."""
    return temporal.versions_of(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber"], F.col("l_returnflag"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A current fact for three of four parts, under labels of all kinds."""
    label = F.element_at(F.array(*map(F.lit, scalar.TRUST)), (F.col("p_partkey") % 7 + 1).cast("int"))
    prop = F.when(F.col("p_partkey") % 2 == 0, "version").otherwise("size")
    star = {c: F.lit("*") for c in ("region", "language", "platform", "plan", "app_version")}
    return table(spark, sf_dir, "part").filter("p_partkey % 4 <> 3").select(F.col("p_partkey").cast("string").alias("entity_id"), prop.alias("property"), *[v.alias(k) for k, v in star.items()],
        F.concat((F.col("p_partkey") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 11).cast("string")).alias("value"), F.lit(None).cast("string").alias("unit"), label.alias("verification"),
        F.lit("a").alias("source_id"), F.lit("auto").alias("created_by"), F.lit(T0).alias("valid_from"), F.lit(None).cast("bigint").alias("valid_until"), F.lit(T0).alias("observed_at"), F.lit(True).alias("is_current"))


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incoming fact for every part; every tenth twice, so that the last counts."""
    label = F.element_at(F.array(*map(F.lit, scalar.TRUST)), (F.col("p_size") % 7 + 1).cast("int"))
    prop = F.when(F.col("p_partkey") % 2 == 0, "version").otherwise("size")
    part = table(spark, sf_dir, "part")
    rows = part.withColumn("position", F.lit(1)).unionByName(part.filter("p_partkey % 10 = 0").withColumn("position", F.lit(0)).withColumn("p_size", F.col("p_size") + 1))
    value = F.concat((F.col("p_partkey") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 11 + F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size") % 3 - F.col("position") * 2 + 1)).cast("string"))
    return rows.select(F.col("p_partkey").cast("string").alias("entity_id"), prop.alias("property"), *[F.lit(None).cast("string").alias(c) for c in ("region", "language", "platform", "plan", "app_version")],
        value.alias("value"), F.lit(None).cast("string").alias("unit"), label.alias("verification"), F.lit("b").alias("source_id"), F.lit(None).cast("bigint").alias("valid_from"),
        (F.col("p_partkey") % 8 == 0).alias("only_if_newer"), "position")


_TRUST_SQL = "['" + "', '".join(scalar.TRUST) + "']"
_DECIDED = f"""old AS (SELECT CAST(p_partkey AS VARCHAR) AS e, {_TRUST_SQL}[CAST(p_partkey % 7 + 1 AS INT)] AS cv, p_partkey % 7 AS cr, p_partkey % 5 AS cm, p_partkey % 11 AS cn FROM part WHERE p_partkey % 4 <> 3),
    new AS (SELECT CAST(p_partkey AS VARCHAR) AS e, p_partkey % 2 = 0 AS is_version, {_TRUST_SQL}[CAST(p_size % 7 + 1 AS INT)] AS nv, p_size % 7 AS nr, p_partkey % 5 AS nm,
        p_partkey % 11 + CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % 3 - 1 END AS nn, p_partkey % 8 = 0 AS newer FROM part),
    decided AS (SELECT new.*, cv, CASE WHEN cv IS NULL THEN 'add' WHEN nn = cn AND nr <= cr AND nr <> cr THEN 'upgrade' WHEN nn = cn THEN 'confirm'
        WHEN newer AND is_version AND nn <= cn THEN 'keep' WHEN NOT (nr <= cr OR (is_version AND nr = 1 AND cr = 0 AND nn > cn)) THEN 'conflict' ELSE 'replace' END AS action FROM new LEFT JOIN old USING (e))"""


@query(f"WITH {_DECIDED} SELECT e AS entity_id, nm || '.' || nn AS value, nv AS verification, cv AS cur_verification, action FROM decided")
def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trust ladder makes of each incoming fact."""
    decided = temporal.decide(_state(spark, sf_dir), _document(spark, sf_dir), "auto", T1)
    return decided.select("entity_id", "value", "verification", "cur_verification", "action")


@query(f"WITH {_DECIDED} SELECT e AS entity_id, nm || '.' || nn AS value, nv AS verification FROM decided WHERE action = 'conflict' AND NOT (CAST(e AS BIGINT) % 3 = 0)")
def conflict_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts to open, without those rejected before."""
    decided = temporal.decide(_state(spark, sf_dir), _document(spark, sf_dir), "auto", T1)
    rejected = decided.filter("action = 'conflict' AND CAST(entity_id AS BIGINT) % 3 = 0").withColumn("status", F.lit("rejected"))
    return temporal.conflicts(decided, rejected).select("entity_id", "value", "verification")


@query("SELECT 0 AS replaced, 0 AS added, count(*) AS current_facts FROM part")
def idempotent_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the same document again adds and replaces nothing."""
    doc = _document(spark, sf_dir)
    once = temporal.apply(_state(spark, sf_dir), temporal.decide(_state(spark, sf_dir), doc, "auto", T1), "auto")
    again = temporal.decide(once, doc, "auto", T1)
    counts = again.agg(F.count_if(F.col("action") == "replace").cast("int").alias("replaced"), F.count_if(F.col("action") == "add").cast("int").alias("added"))
    return counts.crossJoin(once.filter("is_current").agg(F.count("*").alias("current_facts")))  # one row each


@query(
    """WITH s AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS moment FROM lineitem GROUP BY ALL), v AS (SELECT l_partkey, max(moment) AS newest FROM s GROUP BY l_partkey)
    SELECT s.l_partkey, s.l_suppkey, CASE WHEN moment < newest THEN 'unverified_after_update' ELSE 'works' END AS status FROM s JOIN v USING (l_partkey)"""
)
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was verified against an older version is unverified after a newer one."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("at"))
    newest = F.max("at").over(Window.partitionBy("l_partkey"))
    return s.withColumn("newest", newest).select("l_partkey", "l_suppkey", F.when(F.col("at") < F.col("newest"), "unverified_after_update").otherwise("works").alias("status"))


@query(
    """SELECT user_id, event_id, sha256(event_type) AS checksum FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type"""
)
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is stored if its checksum differs from the newest one's, so A, B, A gives three."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("checksum", F.sha2(F.col("event_type").cast("binary"), 256))
    return rows.withColumn("b", F.lag("checksum").over(order)).filter(~F.col("b").eqNullSafe(F.col("checksum"))).select("user_id", "event_id", "checksum")


@query(
    """SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND max(ts) = max(ts) FILTER (WHERE event_type = 'error') THEN 'failing' WHEN max(ts) < TIMESTAMP '2024-01-29' THEN 'stale' ELSE 'ok' END AS state
    FROM events GROUP BY user_id"""
)
def freshness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """failing before stale before ok."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("at"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("bad"))
    stale = F.col("at") < F.lit("2024-01-29").cast("timestamp_ntz")
    return last.select("user_id", F.when(F.col("at") == F.col("bad"), "failing").when(stale, "stale").otherwise("ok").alias("state"))


@query(
    """WITH o AS (SELECT l_partkey AS part, l_returnflag AS value, epoch_ms(l_shipdate) AS t, epoch_ms(l_shipdate) + l_orderkey % 50 * 86400000 AS seen FROM lineitem),
    s AS (SELECT part, t, arg_max(value, (seen, value)) AS value, max(seen) AS last, min(seen) AS first FROM o GROUP BY part, t),
    b AS (SELECT *, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS starts FROM s WINDOW w AS (PARTITION BY part ORDER BY t)),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY part ORDER BY t) AS run FROM b)
    SELECT part, max(value) AS value, min(t) AS valid_from, lead(min(t)) OVER (PARTITION BY part ORDER BY min(t)) AS valid_until, max(last) AS observed_at, min(first) AS first_seen FROM g GROUP BY part, run"""
)
def late_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of facts whose observations come in three batches, out of order, one of them twice."""
    day, at = 86_400_000, scalar.millis(F.col("l_shipdate"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("value"), at.alias("valid_from"), (at + F.col("l_orderkey") % 50 * day).alias("observed_at"), (F.col("l_orderkey") % 3).alias("k"))
    folder = graph.shared_folder(spark)
    for k in (2, 0, 1, 0):
        late.merge(seen.filter(F.col("k") == k).drop("k"), k, folder, ["part"], buckets=16)
    return late.histories(spark, folder)
