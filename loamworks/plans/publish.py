"""After the ingest: conflicts, changes, search rows, verdicts, votes, webhooks, retention, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import publish
from loamworks.plans.registry import query
from loamworks.session import table

NOW = 1_706_745_600_000


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'rejected' WHEN l_partkey % 4 = 0 THEN CASE WHEN l_returnflag = CASE WHEN l_partkey % 8 = 0 THEN 'A' ELSE 'N' END THEN 'accepted' ELSE 'rejected' END ELSE 'open' END AS status,
        CASE WHEN l_linenumber % 3 > 0 AND l_partkey % 4 = 0 THEN 'system:ingest' END AS resolved_by, CASE WHEN l_linenumber % 3 > 0 AND l_partkey % 4 = 0 THEN {NOW} END AS resolved_at FROM lineitem"""
)
def conflict_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open conflicts of facts that changed are accepted or rejected by the new value."""
    queue = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("fact_id"), F.col("l_returnflag").alias("value"), F.when(F.col("l_linenumber") % 3 == 0, "rejected").otherwise("open").alias("status"),
        F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("bigint").alias("resolved_at"),
    )
    replaced = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("fact_id"), F.when(F.col("p_partkey") % 8 == 0, "A").otherwise("N").alias("value"))
    return publish.settle_conflicts(queue, replaced, NOW).drop("fact_id", "value")


@query(
    """SELECT entity_id, kind, old_value, new_value, first, CASE WHEN source % 3 = 0 THEN 'collector' ELSE 'seed' END AS origin FROM (SELECT l_partkey AS entity_id, l_linestatus AS kind, l_returnflag AS old_value, l_linenumber % 2 AS new_value,
        min(l_orderkey * 10 + l_linenumber) AS first, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS source FROM lineitem GROUP BY ALL)"""
)
def change_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct changes, and whether a collector's source backs them."""
    none = F.lit(None).cast("string")
    changes = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_linestatus").alias("kind"), none.alias("property"), F.when(F.col("l_orderkey") % 2 == 0, "{}").alias("scope"), F.col("l_returnflag").alias("old_value"),
        (F.col("l_linenumber") % 2).alias("new_value"), none.alias("ref_id"), F.col("l_suppkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 3 == 0, "feed").alias("adapter"))
    return publish.change_rows(changes, sources, "seed").select("entity_id", "kind", "old_value", "new_value", F.col("position").alias("first"), "origin")


@query(
    """WITH l AS (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['en'] WHEN 1 THEN ['en', 'ko'] WHEN 2 THEN ['ko'] ELSE [] END) AS locale FROM part UNION ALL SELECT p_partkey, 'en' FROM part WHERE p_partkey % 4 = 3),
    a AS (SELECT l_partkey, string_agg(alias, ' · ' ORDER BY first, alias) AS aliases FROM (SELECT l_partkey, l_returnflag || l_linestatus AS alias, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY l_partkey)
    SELECT 'entity:' || p_partkey AS doc_key, p_type AS kind, locale, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN locale = 'ko' THEN 'K' || p_name ELSE p_name END AS title, coalesce(aliases, '') || ' ' || p_brand AS body
    FROM part JOIN l USING (p_partkey) LEFT JOIN a ON l_partkey = p_partkey WHERE p_size <> 1"""
)
def reindex_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search row for each locale that an entity has a name in."""
    k, none = F.col("p_partkey") % 4, F.create_map().cast("map<string,string>")
    en, ko = F.create_map(F.lit("en"), F.col("p_name")), F.create_map(F.lit("ko"), F.concat(F.lit("K"), "p_name"))
    names = F.when(k == 0, en).when(k == 1, F.map_concat(en, ko)).when(k == 2, ko).otherwise(none)
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("type"), F.when(F.col("p_size") != 1, "active").otherwise("hidden").alias("status"), names.alias("names"), F.create_map(F.lit("en"), F.col("p_brand")).alias("descriptions"))
    aliases = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("entity_id"), F.concat("l_returnflag", "l_linestatus").alias("alias"), F.col("l_linenumber").alias("position"))
    return publish.search_rows(entities, aliases)


@query(
    """WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'works' WHEN 1 THEN 'broken' ELSE 'unknown' END AS s, CASE WHEN p_size > 25 THEN 'COMMUNITY_VERIFIED' ELSE 'COMMUNITY' END AS v FROM part WHERE p_partkey % 5 <> 0),
    c AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'works' ELSE 'broken' END AS cs, ['OFFICIAL', 'AUTOMATED', 'COMMUNITY', 'COMMUNITY_VERIFIED'][CAST(p_size % 4 + 1 AS INT)] AS cv, p_size % 3 AS n FROM part WHERE p_partkey % 6 <> 0),
    j AS (SELECT k, s, v, cs, cv, CASE WHEN cv = 'OFFICIAL' THEN 'keep' WHEN coalesce(s, 'unknown') = 'unknown' THEN CASE WHEN cv IS NOT NULL AND cv <> 'AUTOMATED' AND n > 0 THEN 'close' ELSE 'keep' END
        WHEN s = cs AND v = cv THEN 'refresh' WHEN cv IS NULL THEN 'open' ELSE 'replace' END AS action FROM v FULL JOIN c USING (k))
    SELECT k AS target, action, CASE WHEN action IN ('open', 'replace', 'refresh') THEN s ELSE cs END AS status, CASE WHEN action IN ('open', 'replace', 'refresh') THEN v ELSE cv END AS verification FROM j"""
)
def verdict_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of stored verdicts when reports are counted anew; official ones are never touched."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    verdicts = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("target"), F.when(k == 0, "works").when(k == 1, "broken").otherwise("unknown").alias("status"), F.when(F.col("p_size") > 25, "COMMUNITY_VERIFIED").otherwise("COMMUNITY").alias("verification"))
    label = F.element_at(F.array(*map(F.lit, ("OFFICIAL", "AUTOMATED", "COMMUNITY", "COMMUNITY_VERIFIED"))), (F.col("p_size") % 4 + 1).cast("int"))
    current = part.filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("target"), F.when(F.col("p_size") % 2 == 0, "works").otherwise("broken").alias("status"), label.alias("verification"), (F.col("p_size") % 3).alias("votes"))
    return publish.recompute(verdicts, current, ["target"])


@query(
    """WITH v AS (SELECT event_id % 60 AS target, user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS e FROM events GROUP BY ALL), l AS (SELECT v.target, epoch_us(ts) // 1000 AS t, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN -1 ELSE 1 END AS value FROM v JOIN events ON event_id = e),
    u AS (SELECT target, t, row_number() OVER (PARTITION BY target ORDER BY t) AS n FROM l WHERE value = 1)
    SELECT l.target, count(*) FILTER (WHERE value = 1) AS up, count(*) FILTER (WHERE value = -1) AS down, (SELECT t FROM u WHERE u.target = l.target AND n = 3) AS best_at FROM l GROUP BY l.target"""
)
def votes_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing votes after casts and undone ones, and when the third up-vote came."""
    value = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "error", -1).otherwise(1)
    log = table(spark, sf_dir, "events").select((F.col("event_id") % 60).alias("target"), F.col("user_id").alias("voter"), scalar.millis(F.col("ts")).alias("at"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id").alias("tie"), value.alias("value"))
    return publish.vote_counts(log, 3)


@query(
    """WITH e AS (SELECT event_id AS tie, event_id - event_id % 3 % 2 AS id, user_id AS subject, epoch_us(ts) // 1000 - (event_id % 5) * 86400000 AS t, event_type AS kind FROM events),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tie) AS k FROM e) WHERE k = 1),
    w AS (SELECT *, max(CASE WHEN kind <> 'view' THEN t END) OVER (PARTITION BY subject ORDER BY tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM f)
    SELECT id, CASE WHEN kind = 'view' THEN 'ignored' WHEN newest > t THEN 'stale' ELSE 'processed' END AS state FROM w"""
)
def webhook_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered events once each: processed, ignored, or stale behind a newer one."""
    i = F.col("event_id")
    events = table(spark, sf_dir, "events").select(i.alias("tie"), (i - i % 3 % 2).alias("id"), F.col("user_id").alias("subject"), (scalar.millis(F.col("ts")) - (i % 5) * scalar.DAY_MS).alias("at"), F.col("event_type").alias("kind"))
    return publish.webhook_states(events, F.col("kind") != "view").select("id", "state")


@query(
    f"""SELECT event_id, CASE WHEN {NOW} - epoch_us(ts) // 1000 <= 864000000 THEN user_id END AS user_id FROM events
    WHERE CASE event_type WHEN 'view' THEN {NOW} - epoch_us(ts) // 1000 <= 604800000 WHEN 'click' THEN {NOW} - epoch_us(ts) // 1000 <= 1728000000 ELSE true END"""
)
def retention_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within their kind's horizon, without people after ten days."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", scalar.millis(F.col("ts")).alias("at"))
    kept = publish.retained(rows, "at", F.lit(NOW), {"view": 7 * scalar.DAY_MS, "click": 20 * scalar.DAY_MS}, "event_type", ["user_id"], 10 * scalar.DAY_MS)
    return kept.select("event_id", "user_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events),
    c AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT c.user_id, min(e.t) AS t FROM c JOIN e ON e.user_id = c.user_id AND e.t >= c.t + 172800000 GROUP BY c.user_id, c.t)),
    f AS (SELECT c.user_id, min(event_id) AS event_id FROM c JOIN e ON e.user_id = c.user_id AND e.t = c.t GROUP BY c.user_id, c.t)
    SELECT e.event_id, f.event_id IS NOT NULL AS claimed FROM e LEFT JOIN f ON f.event_id = e.event_id"""
)
def lock_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attempts take a lock that holds for two days."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", scalar.millis(F.col("ts")).alias("at"))
    return publish.claims(rows, "user_id", "at", "event_id", 2 * scalar.DAY_MS).select("event_id", "claimed")


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'question' WHEN 'F' THEN 'guide' ELSE 'talk' END AS flair, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS channel_no,
        'c' || o_custkey AS channel_id, coalesce(nullif(split_part(o_orderpriority, '-', 2), 'NOT SPECIFIED'), 'none') AS tag FROM orders"""
)
def migrated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows in a new table's columns: mapped states, numbers within each channel, derived keys."""
    by = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)").cast("bigint")
    state = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(state == "O", "question").when(state == "F", "guide").otherwise("talk").alias("flair"), by.alias("channel_no"), F.concat(F.lit("c"), "o_custkey").alias("channel_id"),
        F.coalesce(F.nullif(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit("NOT SPECIFIED")), F.lit("none")).alias("tag"),
    )
