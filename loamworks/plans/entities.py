"""Entities, names, listings, glyphs and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import entities, graph
from loamworks.plans.registry import query
from loamworks.session import table

_TRUST = "['" + "', '".join(scalar.TRUST) + "']"


@query(
    f"""WITH f AS (SELECT l_partkey AS entity, CASE l_returnflag WHEN 'A' THEN 'ko' WHEN 'N' THEN '*' ELSE 'en' END AS language, CASE l_linestatus WHEN 'O' THEN 'KR' ELSE '*' END AS region,
        {_TRUST}[CAST(l_linenumber % 7 + 1 AS INT)] AS trust, l_linenumber % 7 AS rank, l_orderkey * 10 + l_linenumber AS position FROM lineitem)
    SELECT entity, language, region, trust, position FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN region = 'KR' THEN 0 ELSE 1 END,
        CASE language WHEN 'ko' THEN 0 WHEN '*' THEN 1 ELSE 2 END, CASE WHEN region = 'KR' THEN 0 ELSE rank END, position) AS k FROM f) WHERE k = 1"""
)
def fact_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact that answers for each entity in a region and language."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity"), F.when(flag == "A", "ko").when(flag == "N", "*").otherwise("en").alias("language"), F.when(status == "O", "KR").otherwise("*").alias("region"),
        F.element_at(F.array(*map(F.lit, scalar.TRUST)), (F.col("l_linenumber") % 7 + 1).cast("int")).alias("trust"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    return entities.pick_fact(facts, "entity", "language", "region", "trust", "position", "ko", "KR")


@query(
    """WITH a AS (SELECT n_nationkey AS entity_id, lower(replace(n_name, ' ', '')) AS norm, 'nation' AS type FROM nation UNION ALL SELECT 1000 + r_regionkey, lower(replace(r_name, ' ', '')), 'region' FROM region),
    t(term, t, w) AS (VALUES (0, 'nationin', 1.0), (1, 'nation', 0.6), (2, 'in', 0.6), (0, 'a', 0.0)),
    h AS (SELECT entity_id, type, term, CASE WHEN norm = t THEN 100.0 ELSE 60.0 - least(40, length(norm) - length(t)) END * w AS s FROM a JOIN t ON starts_with(norm, t) WHERE t <> 'a')
    SELECT entity_id, round(max(s) + 15 * greatest(count(DISTINCT CASE WHEN term > 0 THEN term END) - 1, 0) + CASE type WHEN 'region' THEN 8 ELSE 0 END, 6) AS score FROM h GROUP BY entity_id, type"""
)
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by prefix scores of a query of two words."""
    norm = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"), norm("n_name").alias("norm"), F.lit("nation").alias("type"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("entity_id"), norm("r_name").alias("norm"), F.lit("region").alias("type"))
    found = entities.search_names(nations.unionByName(regions), "nation in", {"region": 8})
    return found.withColumn("score", F.round("score", 6))


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_custkey AS url, o_orderpriority AS kind, o_orderstatus AS title, o_orderkey % 50 AS starts FROM orders WHERE o_orderkey % 3 <> 0),
    i AS (SELECT o_orderkey AS id, o_custkey AS url, o_orderpriority AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS title, (o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 50 AS starts FROM orders),
    e AS (SELECT i.id, min(s.id) AS m FROM i JOIN s USING (url, kind, title, starts) GROUP BY i.id),
    r1 AS (SELECT * FROM i WHERE id NOT IN (SELECT id FROM e)), f1 AS (SELECT * FROM s WHERE id NOT IN (SELECT m FROM e)),
    t AS (SELECT a.id, b.id AS m FROM (SELECT url, kind, title, min(id) AS id FROM r1 GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT url, kind, title, min(id) AS id FROM f1 GROUP BY ALL HAVING count(*) = 1) b USING (url, kind, title)),
    r2 AS (SELECT * FROM r1 WHERE id NOT IN (SELECT id FROM t) AND (url, kind, title) NOT IN (SELECT (url, kind, title) FROM s)), f2 AS (SELECT * FROM f1 WHERE id NOT IN (SELECT m FROM t)),
    u AS (SELECT a.id, b.id AS m FROM (SELECT url, kind, min(id) AS id FROM r2 GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT url, kind, min(id) AS id FROM f2 GROUP BY ALL HAVING count(*) = 1) b USING (url, kind))
    SELECT i.id AS incoming_id, coalesce(x.m, -1) AS stored_id FROM i LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM u) x ON i.id = x.id"""
)
def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored event each incoming one is, in three steps of falling certainty."""
    key = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_custkey").alias("url"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("title"))
    stored = base.filter("id % 3 <> 0").withColumn("starts", F.col("id") % 50)
    new = base.withColumn("title", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("title"))).withColumn("starts", (F.col("id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)) % 50)
    return entities.match_events(stored, new).withColumn("stored_id", F.coalesce("stored_id", F.lit(-1)))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN o_custkey // 9 ELSE o_custkey END AS o_custkey FROM orders")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of merged customers replaced by what they were merged into."""
    merged = table(spark, sf_dir, "customer").filter("c_custkey % 9 = 0").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 9).alias("merged_into"))
    missing = table(spark, sf_dir, "orders").filter("o_custkey % 9 = 0").select(F.col("o_custkey").alias("id"), F.floor(F.col("o_custkey") / 9).alias("merged_into")).distinct()
    return entities.resolve(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), merged.unionByName(missing).distinct(), "o_custkey")


@query(
    """SELECT event_id, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 259200000) >= 259200000 AND count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 604800000 PRECEDING AND 1 PRECEDING) < 2 AS allowed
    FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'purchase')"""
)
def ledger_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two in seven days, three days apart."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id", scalar.millis(F.col("ts")).alias("t"))
    return entities.cadence(rows, "user_id", "t", "event_id", 3 * scalar.DAY_MS, 7 * scalar.DAY_MS, 2).select("event_id", "allowed")


@query(
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown segment' END,
        CASE WHEN c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) THEN 'unknown nation' END) AS errors FROM customer"""
)
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a row breaks, references included."""
    known = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("known"))
    rows = table(spark, sf_dir, "customer").join(known, F.col("c_nationkey") == F.col("known"), "left")
    rules = [(F.col("c_acctbal") < 0, "negative balance"), (~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "unknown segment"), (F.col("known").isNull(), "unknown nation")]
    return rows.select("c_custkey", F.array_join(entities.validate(rows, rules), ";").alias("errors"))


@query(
    """WITH k AS (SELECT p_partkey AS id, p_partkey // 6 AS k FROM part), s AS (SELECT id, xor(xor((k * 2654435761 % 2147483648) * 4294967296 + (k * 40503 + 12345) % 2147483648, 1::BIGINT << CAST(id % 6 * 7 AS INT)), 1::BIGINT << CAST(id * 11 % 61 AS INT)) AS s FROM k),
    o AS (SELECT s, min(id) AS id FROM s GROUP BY s)
    SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON x.id < y.id AND bit_count(xor(x.s, y.s)) <= 3"""
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of 62-bit signatures that differ in three bits or fewer; groups of six parts have nearly the same."""
    k = F.floor(F.col("p_partkey") / 6)
    base = (k * 2654435761 % 2147483648) * 4294967296 + (k * 40503 + 12345) % 2147483648
    flip = lambda n: F.expr(f"shiftleft(1L, CAST({n} AS INT))")
    signature = base.bitwiseXOR(flip("p_partkey % 6 * 7")).bitwiseXOR(flip("p_partkey * 11 % 61"))
    return entities.near_signatures(table(spark, sf_dir, "part").select("p_partkey", signature.alias("s")), "p_partkey", "s", 3, 64)


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[`*_>#|]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 140 THEN rtrim(substr(t, 1, 139)) || '…' ELSE t END AS excerpt FROM t"""
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.excerpt(F.col("text"), 140).alias("excerpt"))


@query(
    """SELECT network, count(*) AS n FROM (SELECT (user_id % 200) || '.' || (event_id % 7) || '.' || (event_id % 3) || '.0/24' AS network FROM events) GROUP BY network"""
)
def network_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat_ws(".", F.col("user_id") % 200, F.col("event_id") % 7, F.col("event_id") % 3, F.col("event_id") % 250)
    return table(spark, sf_dir, "events").groupBy(scalar.network(ip).alias("network")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CAST(c // 588 AS INTEGER) AS initial, CAST((c % 588) // 28 AS INTEGER) AS medial, CAST(c % 28 AS INTEGER) AS final FROM (SELECT doc_id, (doc_id * 7) % 11172 AS c FROM documents)"""
)
def hangul_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = scalar.hangul_parts(F.col("doc_id") * 7 % 11172 + 0xAC00)
    return table(spark, sf_dir, "documents").select("doc_id", parts.alias("p")).select("doc_id", "p.*")


@query(
    """SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND unicode(ch) > 126 GROUP BY ch"""
)
def missing_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in use that a font of the printable ASCII characters lacks."""
    used = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    font = spark.range(0, 127).select(F.chr("id").alias("ch"))
    return used.join(font, "ch", "left_anti")


@query(
    """WITH c AS (SELECT DISTINCT user_id % 40 AS x, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS y FROM events WHERE event_type = 'signup'),
    m AS (SELECT a.x, a.y, CAST(sum(CASE WHEN b.x IS NOT NULL THEN w ELSE 0 END) AS BIGINT) AS m FROM c a, (VALUES (0, -1, 1), (1, -1, 2), (1, 0, 4), (1, 1, 8), (0, 1, 16), (-1, 1, 32), (-1, 0, 64), (-1, -1, 128)) d(dx, dy, w)
        LEFT JOIN c b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.x, a.y)
    SELECT x, CAST(y AS INTEGER) AS y, m & 85 AS edges, (m & 85) + CASE WHEN m & 7 = 7 THEN 2 ELSE 0 END + CASE WHEN m & 28 = 28 THEN 8 ELSE 0 END + CASE WHEN m & 112 = 112 THEN 32 ELSE 0 END + CASE WHEN m & 193 = 193 THEN 128 ELSE 0 END AS blob FROM m"""
)
def autotile_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of its eight neighbours each filled tile has, as bits: tiles tell their neighbours, and bits are summed."""
    y = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    cells = table(spark, sf_dir, "events").filter("event_type = 'signup'").select((F.col("user_id") % 40).alias("x"), y.alias("y")).distinct()
    return entities.tile_masks(cells)


@query(
    """WITH RECURSIVE d AS (SELECT p_partkey AS id, p_partkey // 2 AS needs FROM part WHERE p_partkey // 2 > 0), w AS (SELECT p_partkey AS id, p_partkey AS up, 0 AS level FROM part
        UNION ALL SELECT w.id, d.needs, level + 1 FROM w JOIN d ON w.up = d.id) SELECT id, max(level) AS level FROM w GROUP BY id"""
)
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which round each part can be done: after all that it needs."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    needs = parts.select("id", F.floor(F.col("id") / 2).alias("needs")).filter("needs > 0").join(parts.withColumnRenamed("id", "needs"), "needs", "left_semi")
    return graph.levels(parts, needs)


@query(
    """SELECT target, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down FROM (SELECT event_id % 90 AS target, (event_type = 'click')::INT AS up, (event_type = 'error')::INT AS down FROM events
        UNION ALL SELECT o_orderkey % 90, (o_orderstatus = 'F')::INT, (o_orderstatus = 'P')::INT FROM orders) GROUP BY target"""
)
def votes_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of two tables, counted together."""
    is_ = lambda c, v: (F.col(c) == v).cast("int")
    a = table(spark, sf_dir, "events").select((F.col("event_id") % 90).alias("target"), is_("event_type", "click").alias("up"), is_("event_type", "error").alias("down"))
    b = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 90).alias("target"), is_("o_orderstatus", "F").alias("up"), is_("o_orderstatus", "P").alias("down"))
    return a.unionByName(b).groupBy("target").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


@query(
    """WITH r AS (SELECT user_id, event_id, t, event_type AS f, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events)),
    c AS (SELECT user_id, event_id, t, f FROM r WHERE b IS DISTINCT FROM f), l AS (SELECT user_id, max(t) AS last_seen FROM r GROUP BY user_id)
    SELECT c.user_id, event_id, f AS fingerprint, last_seen, last_seen >= 1706500000000 AS active FROM c JOIN l USING (user_id)"""
)
def listing_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision for each change of fingerprint, with when the listing was last seen and whether it is active."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", scalar.millis(F.col("ts")).alias("t"), F.col("event_type").alias("fingerprint"))
    w = Window.partitionBy("user_id")
    rows = rows.withColumn("b", F.lag("fingerprint").over(w.orderBy("t", "event_id"))).withColumn("last_seen", F.max("t").over(w))
    return rows.filter(~F.col("b").eqNullSafe(F.col("fingerprint"))).select("user_id", "event_id", "fingerprint", "last_seen", (F.col("last_seen") >= 1_706_500_000_000).alias("active"))
