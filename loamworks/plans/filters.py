"""Filters put together at run time, views, lists, prefixes, JSON with fallbacks, look-ups of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import pandas_udfs, scalar
from loamworks.operators import filters
from loamworks.plans.registry import query
from loamworks.session import table


def board(docs: DataFrame, lang: str | None = None, source: str | None = None, least: int | None = None, term: str | None = None, before: int | None = None) -> DataFrame:
    """Documents by whichever conditions are given."""
    tests = [
        filters.given(lang, lambda v: F.col("lang") == v), filters.given(source, lambda v: F.col("source") == v), filters.given(least, lambda v: F.col("n_chars") >= v),
        filters.given(term, lambda v: filters.contains_term(F.col("text"), v)), filters.given(before, lambda v: F.col("doc_id") < v),
    ]
    return docs.filter(filters.all_of(*tests))


@query("SELECT 1 AS board, doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND contains(lower(text), 'ing') UNION ALL SELECT 2, doc_id FROM documents WHERE source = 'src3' UNION ALL SELECT 3, doc_id FROM documents")
def board_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boards, by three, one and no conditions."""
    docs = table(spark, sf_dir, "documents")
    boards = [board(docs, lang="en", least=500, term="ING"), board(docs, source="src3", lang=""), board(docs)]
    out = [b.select(F.lit(i + 1).alias("board"), "doc_id") for i, b in enumerate(boards)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderkey % 4 <> 1 AND o_custkey % 3 > 0"""
)
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is active, public, current and open, by four views on top of each other."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "active").otherwise("hidden").alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", "public").otherwise("private").alias("visibility"),
        (key % 4 != 1).alias("is_current"), F.when(F.col("o_custkey") % 3 == 0, key).alias("valid_until"),
    )
    return filters.still_open(filters.current(filters.public(filters.active(rows)))).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT unnest(range(0, 3000, 7))) UNION ALL SELECT -o_orderkey, o_custkey FROM orders WHERE o_custkey IN (5, 9, 14)")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed customers: a long list as a join, a short one as a predicate; repeats and nulls in a list don't matter."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    long, short = filters.in_list(orders, "o_custkey", [*range(0, 3000, 7), 7, 14, None], most=100), filters.in_list(orders, "o_custkey", [5, 9, 5, None, 14])
    return long.unionByName(short.withColumn("o_orderkey", -F.col("o_orderkey")))


@query(r"SELECT doc_id, contains(text, '%%%') AS percent, contains(text, '_') AS line, contains(lower(text), '*** ') AS stars FROM documents")
def literal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with wildcards in them, taken literally."""
    has = lambda t: filters.contains_term(F.col("text"), t)
    return table(spark, sf_dir, "documents").select("doc_id", has("%%%").alias("percent"), has("_").alias("line"), has("*** ").alias("stars"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#0000001' AND c_name < 'Customer#0000002'")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by a prefix, which the scan can use."""
    return table(spark, sf_dir, "customer").filter(F.col("c_name").startswith("Customer#0000001")).select("c_custkey", "c_name")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 7 = 0 THEN -2 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of JSON texts of which some are broken and some lack it."""
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).when(F.col("event_id") % 7 == 0, '{"j": 1}').otherwise(F.col("props"))
    got = filters.json_or(raw, "k bigint", F.named_struct(F.lit("k"), F.lit(-1).cast("bigint")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(got["k"], F.lit(-2)).alias("k"))


@query(
    """SELECT o_orderkey, '{"a":[1,{"x":"' || o_orderstatus || '","y":null}],"b":{"k":' || o_custkey || ',"z":true},"c":"' || o_orderpriority || '"}' AS canonical, count(*) OVER (PARTITION BY o_orderstatus, o_custkey, o_orderpriority) AS same FROM orders"""
)
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written with their keys in different orders, and how many are equal."""
    a = F.format_string('{ "b": {"z": true, "k": %d}, "a": [1, {"y": null, "x": "%s"}], "c": "%s" }', "o_custkey", "o_orderstatus", "o_orderpriority")
    b = F.format_string('{"c":"%s","a":[1,{"x":"%s","y":null}],"b":{"k":%d,"z":true}}', "o_orderpriority", "o_orderstatus", "o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", filters.canonical_json(F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b)).alias("canonical"))
    return rows.join(rows.groupBy("canonical").agg(F.count("*").alias("same")), "canonical").select("o_orderkey", "canonical", "same")


@query("SELECT source, count(*) AS posts, count(DISTINCT lang) AS followers, max(doc_id) AS updated, row_number() OVER (ORDER BY count(*) DESC, count(DISTINCT lang) DESC, max(doc_id) DESC) AS place FROM documents GROUP BY source")
def hub_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs by posts, followers and last update; one row a hub is left to number."""
    hubs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("posts"), F.count_distinct("lang").alias("followers"), F.max("doc_id").alias("updated"))
    order = F.expr("row_number() OVER (ORDER BY posts DESC, followers DESC, updated DESC)")
    return hubs.withColumn("place", order.cast("bigint"))


@query(
    """SELECT conv_id, turn, array_to_string(list_distinct_in_order[1:6], ' ') AS words FROM (SELECT conv_id, turn, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]) AS list_distinct_in_order
        FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM conversations))"""
)
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a search would look for: folded, distinct, at most six."""
    words = filters.search_words(F.lower(pandas_udfs.nfkc("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


#: Words and the tool that they stand for, as a table that is looked up; deployments have their own.
SYNONYMS = [("the", "articles"), ("of", "prepositions"), ("and", "joins"), ("or", "joins"), ("with", "prepositions"), ("la", "articles"), ("le", "articles"), ("der", "articles"), ("die", "articles")]


@query(
    f"""WITH s(word, tool) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in SYNONYMS)}), w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM conversations)
    SELECT tool, count(*) AS hits, count(DISTINCT (conv_id, turn)) AS turns FROM w JOIN s USING (word) GROUP BY tool"""
)
def synonym_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns each tool's synonyms lead to."""
    names = spark.createDataFrame(SYNONYMS, "word string, tool string")
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word"))
    return words.join(names, "word").groupBy("tool").agg(F.count("*").alias("hits"), F.count_distinct("conv_id", "turn").alias("turns"))


@query("SELECT c_custkey, '/' || lower(c_mktsegment) || '/' || c_custkey AS url, lower(replace(c_mktsegment || c_name, '#', '')) AS norm FROM customer")
def name_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are compared: folded, lower-cased, without spaces, punctuation and symbols; wide letters count as plain ones."""
    wide = F.translate(F.concat_ws(" · ", "c_mktsegment", F.replace("c_name", F.lit("#"), F.lit(" + "))), "ABC", "ＡＢＣ")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", F.lit(""), F.lower("c_mktsegment"), "c_custkey").alias("url"), scalar.search_norm(pandas_udfs.nfkc(wide)).alias("norm"))
