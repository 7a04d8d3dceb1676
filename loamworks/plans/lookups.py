"""Names in texts, blocklists, four ways to compare versions, weighted search, latest rows joined back, and what else looks things up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import scalar, values, versions
from loamworks.plans.registry import query
from loamworks.plans.values import _dealt, _told
from loamworks.session import table

#: Names by entity, a text, and the entities that it names.
NAMES = {"e1": ["Orion 5", "orion-5"], "e2": ["Orion 5.5"], "e3": ["Lyra"], "e4": ["abc"]}
NAMED = [
    ("Orion 5 is out", "e1"), ("Orion 5.5 is out", "e2"), ("Orion 5 Pro is out", ""), ("use orion-5, or Lyra.", "e1,e3"), ("orion-5-mini", ""), ("LYRA", "e3"), ("Lyrae", ""), ("abc", ""), ("", ""), ("Orion 5 and Orion 5.5", "e1,e2"), ("xLyra", ""), ("Lyra Flash", ""),
]


@query(f"WITH {_told(NAMED, 'text, ids')} SELECT event_id, ids FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(NAMED)}")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entities texts name."""
    return _dealt(spark, sf_dir, NAMED, ["text", "told"]).select("event_id", F.array_join(values.named_entities(F.col("text"), NAMES), ",").alias("ids"))


#: Two versions, and how each of four rules compares them: with rests, as texts, as dotted numbers, by stage.
VERSIONS = [
    ("1.4.10", "1.4.9", 1, 1, 1, 1), ("v1.4", "1.4.0", 0, 0, None, 0), ("7.80", "7.80a", None, -1, 1, None), ("5.0-beta1", "5.0", None, 1, 0, -1), ("5.0-beta1", "5.0-rc1", None, -1, 0, -1), ("5.0-rc2", "5.0-rc1", None, 1, 0, 1), ("2", "10", -1, -1, -1, -1), ("1.0 LTS", "1.0", None, 1, 0, 0),
    ("latest", "1.0", None, 1, None, None), ("1.2.3", "1.2.3", 0, 0, 0, 0),
]


@query(f"WITH {_told(VERSIONS, 'a, b, rested, texts, dots, staged')} SELECT event_id, rested, texts, CASE WHEN k IN (1, 8) THEN NULL ELSE dots END AS dots, staged FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(VERSIONS)}")
def version_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of versions under each of the four rules."""
    a, b = F.col("a"), F.col("b")
    dots = F.when(a.rlike(r"^\d") & b.rlike(r"^\d"), values.dotted_compare(a, b))
    rows = _dealt(spark, sf_dir, VERSIONS, ["a", "b", *"1234"])
    return rows.select("event_id", scalar.version_compare(a, b).alias("rested"), values.version_text_compare(a, b).alias("texts"), dots.alias("dots"), versions.staged_compare(a, b).alias("staged"))


BLOCKED = [("keyword", "The  Of", "hide"), ("keyword", "###", "reject"), ("domain", "www.bad.test", "reject"), ("domain", "meh.test", "hide"), ("keyword", " ", "reject")]


@query(
    """WITH t AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' https://bad.test/x' WHEN 1 THEN ' http://WWW.Sub.Bad.test?q' WHEN 2 THEN ' https://notbad.test' WHEN 3 THEN ' https://a.meh.test' ELSE '' END AS text FROM documents)
    SELECT doc_id, CASE WHEN contains(text, '###') OR doc_id % 6 < 2 THEN 'reject' WHEN contains(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), 'the of') OR doc_id % 6 = 3 THEN 'hide' END AS verdict FROM t"""
)
def blocklist_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severest rule that a text meets, by phrases or by domains that it links to."""
    k = F.col("doc_id") % 6
    link = F.when(k == 0, " https://bad.test/x").when(k == 1, " http://WWW.Sub.Bad.test?q").when(k == 2, " https://notbad.test").when(k == 3, " https://a.meh.test").otherwise("")
    text = F.concat("text", link)
    return table(spark, sf_dir, "documents").select("doc_id", values.blocked(text, values.linked_hosts(text), BLOCKED).alias("verdict"))


@query(
    """WITH d AS (SELECT doc_id, lower(regexp_extract(text, '^([^\\n]*)', 1)) AS title, lower(regexp_replace(text, '^[^\\n]*\\n?', '')) AS body FROM documents), s AS (SELECT count(*) AS n, avg(greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0)) AS mean FROM d),
    f AS (SELECT doc_id, title, body, greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0) AS size, gram, len(list_filter(range(1, length(title) - 1), lambda i: substr(title, i, 3) = gram)) AS a, len(list_filter(range(1, length(body) - 1), lambda i: substr(body, i, 3) = gram)) AS b
        FROM d, (SELECT unnest(['han', 'anh', 'nha']) AS gram) WHERE contains(title, gram) OR contains(body, gram)),
    df AS (SELECT gram, count(*) AS df FROM f GROUP BY gram)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (10 * a + b) * 2.2 / ((10 * a + b) + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM f JOIN df USING (gram), s WHERE contains(title, 'hanha') OR contains(body, 'hanha') GROUP BY doc_id"""
)
def weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase in first line or rest, ranked by trigrams of which those of the first line weigh ten times."""
    from loamworks.operators import search

    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.regexp_replace("text", r"\A[^\n]*\n?", "").alias("body"))
    return search.weighted_bm25(docs, "hanha", "doc_id", {"title": 10.0, "body": 1.0}).withColumn("score", F.round("score", 6))


@query(
    """SELECT p_partkey, l_orderkey, l_linenumber, l_returnflag FROM part LEFT JOIN lineitem l ON l_partkey = p_partkey AND l_orderkey * 10 + l_linenumber = (SELECT max(l_orderkey * 10 + l_linenumber) FROM lineitem m WHERE m.l_partkey = p_partkey)"""
)
def latest_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its latest line, if it has any: one aggregation instead of a look-up a row."""
    newest = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_orderkey", "l_linenumber", "l_returnflag")).alias("l"))
    return table(spark, sf_dir, "part").select("p_partkey").join(newest, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l.l_orderkey", "l.l_linenumber", "l.l_returnflag")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL (o_orderkey % 9) DAY END, o_orderdate) >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-09-01'")
def ongoing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not over at a moment and starts before another; without an end, the start counts."""
    ends = F.when(F.col("o_orderkey") % 3 > 0, F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 9 AS INT))"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").filter((F.coalesce(ends, F.col("o_orderdate")) >= at("1997-06-01")) & (F.col("o_orderdate") < at("1997-09-01"))).select("o_orderkey")


@query(
    """SELECT p_brand, median, n, place FROM (SELECT *, row_number() OVER (PARTITION BY p_size % 5 ORDER BY n DESC, p_brand, p_size) AS place FROM (SELECT p_brand, p_size, round(median(l_extendedprice), 3) AS median, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE place <= 6"""
)
def best_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six groups with the most samples, with their medians."""
    from loamworks.operators import relational

    m = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_size").agg(F.round(F.median("l_extendedprice"), 3).alias("median"), F.count("*").alias("n"))
    return relational.top_per_key(m.withColumn("k", F.col("p_size") % 5), ["k"], [F.desc("n"), F.col("p_brand"), F.col("p_size")], 6, "place").select("p_brand", "median", "n", "place")


@query("SELECT c_custkey, 'os=' || c_mktsegment || ';ver=' || c_nationkey AS env, '/' || (c_custkey % 10) || ':' || 'a' AS pair FROM customer")
def env_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments as texts that are equal where the environments are."""
    env = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("ver"), F.col("c_nationkey").cast("string"), F.lit("os"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("os"), F.col("c_mktsegment"), F.lit("ver"), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.env_key(env).alias("env"), F.concat(F.lit("/"), F.col("c_custkey") % 10, F.lit(":a")).alias("pair"))


@query(
    """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+(\\s|$)'), lambda x: trim(x) <> '')) AS sentences, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '\\s', '', 'g')) AS solid, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents"""
)
def text_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, and letters, digits and characters without white space."""
    size = lambda p: F.char_length(F.regexp_replace("text", p, "")).cast("bigint")
    sentences = F.size(F.filter(F.split("text", r"[.!?]+(\s|$)", -1), lambda x: F.trim(x) != "")).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", sentences.alias("sentences"), size("[^A-Za-z]").alias("latin"), size(r"[ \t\n\r\f]").alias("solid"), size("[^0-9]").alias("digits"))


def _steps(n: int) -> str:
    """Lloyd steps in SQL: means by component, then the nearest of them."""
    out = ["x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)", "a0 AS (SELECT vec_id, label AS c FROM embeddings)"]
    for k in range(n):
        out.append(f"m{k} AS (SELECT c, i, avg(v) AS m FROM x JOIN a{k} USING (vec_id) GROUP BY c, i), a{k + 1} AS (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT vec_id, m.c, round(sum((v - m) * (v - m)), 9) AS d FROM x JOIN m{k} m USING (i) GROUP BY vec_id, m.c) GROUP BY vec_id)")
    return ", ".join(out)


@query(f"WITH {_steps(4)} SELECT c AS cluster, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM a4 GROUP BY c")
def palette_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four Lloyd steps from the labels' means: the centers, few and checked, go to the driver between steps."""
    from loamworks.plans.kernels import _centers, assign

    v = table(spark, sf_dir, "embeddings")
    now, by, dims = v.withColumn("assigned", F.col("label")), "assigned", 64
    for _ in range(4):
        centers = spark.createDataFrame(_centers(now, by, dims).limit(1001).collect(), "center_label int, center array<double>")
        now = assign(v, centers, dims)
    return now.groupBy(F.col("assigned").alias("cluster")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query(
    """SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), lambda x: x))) AS targets, len(regexp_extract_all(html, '<a\\s')) AS links FROM pages"""
)
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, and distinct targets."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(targets).cast("bigint").alias("targets"), F.regexp_count("html", F.lit(r"<a\s")).cast("bigint").alias("links"))
