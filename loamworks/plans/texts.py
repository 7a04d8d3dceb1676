"""Texts, markup, urls, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import pandas_udfs, scalar
from loamworks.operators import search, traffic
from loamworks.plans.registry import query
from loamworks.session import table


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, 'https?://') THEN 'link' WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'mail' WHEN regexp_matches(text, '[{};]') THEN 'code'
        WHEN lang <> 'en' THEN 'foreign' ELSE 'plain' END AS kind FROM documents"""
)
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching rule of an ordered list."""
    from loamworks.operators.graph import first_match

    text = F.col("text")
    rules = [(text.rlike("https?://"), "link"), (text.rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "mail"), (text.rlike("[{};]"), "code"), (F.col("lang") != "en", "foreign")]
    return table(spark, sf_dir, "documents").select("doc_id", first_match(text, rules, "plain").alias("kind"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.html$|/+$', '', 'g'), '/\\d+', '/:n', 'g') AS path, url FROM pages)
    SELECT page_id, (CASE WHEN path = '' THEN '/' ELSE path END) || CASE WHEN regexp_matches(url, '[?&]page=[^&#]+') THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]+)', 1) ELSE '' END AS path FROM p"""
)
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the allowed query parameters only."""
    return table(spark, sf_dir, "pages").select("page_id", traffic.normal_path(F.col("url"), ("page",)).alias("path"))


@query(
    r"""WITH a AS (SELECT page_id, html, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a)
    SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS n_chars,
        regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a\s')) AS links FROM b"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the text, title and number of links of every page."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length(scalar.strip_html(html)).cast("bigint").alias("n_chars"), F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(html, F.lit(r"<a\s")).cast("bigint").alias("links")
    )


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY ALL")
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and distinct urls of each host."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


_PHRASES = ("the of", "de la", "###")


@query(
    "SELECT doc_id, CASE WHEN contains(text, '###') THEN 'reject' WHEN contains(lower(text), 'the of') OR contains(lower(text), 'de la') THEN 'hide' ELSE 'pass' END AS verdict FROM documents"
)
def blocklist_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severest verdict of a list of phrases; reject before hide."""
    low = F.lower("text")
    hide = F.contains(low, F.lit(_PHRASES[0])) | F.contains(low, F.lit(_PHRASES[1]))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains("text", F.lit(_PHRASES[2])), "reject").when(hide, "hide").otherwise("pass").alias("verdict"))


@query(
    """WITH k AS (SELECT doc_id, left(sha256('text:' || lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))), 32) AS key FROM documents),
    g AS (SELECT key, min(doc_id) AS first, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1) SELECT doc_id, first, n FROM k JOIN g USING (key)"""
)
def flood_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts posted more than once, white space and case aside."""
    return search.duplicates(table(spark, sf_dir, "documents"), "doc_id", scalar.text_hash(F.col("text")))


@query(
    """SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '')) AS paragraphs,
        len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS words FROM documents"""
)
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points, bytes, lines, paragraphs, words."""
    size = lambda c: F.size(c).cast("bigint")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.char_length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), size(F.split("text", "\n", -1)).alias("lines"),
        size(F.filter(F.split("text", "\n\n", -1), lambda x: F.trim(x) != "")).alias("paragraphs"), size(F.filter(F.split("text", r"[ \t\r\n]+", -1), lambda x: x != "")).alias("words"),
    )


@query()
def grapheme_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grapheme clusters, and code points after compatibility composition."""
    return table(spark, sf_dir, "documents").select("doc_id", pandas_udfs.graphemes("text").alias("graphemes"), F.char_length(pandas_udfs.nfkc("text")).cast("bigint").alias("nfkc_chars"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^\\d+$')) AS w FROM conversations),
    t AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w)
    SELECT term, count(*) AS n, round(count(*) * CASE WHEN contains(term, ' ') THEN 1.3 ELSE 1.0 END, 6) AS weight FROM t GROUP BY term HAVING count(*) >= 2
    ORDER BY count(*) * CASE WHEN contains(term, ' ') THEN 1.3 ELSE 1.0 END DESC, term LIMIT 100"""
)
def trending_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred words and pairs of words that most turns hold."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    terms = search.trending(turns, "id", "text").orderBy(F.desc("weight"), "term").limit(100)
    return terms.withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND contains(lower(text), 'ofth')")
def search_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all terms."""
    return table(spark, sf_dir, "documents").filter(search.all_terms(F.col("text"), ["the", "ing", "ofth"])).select("doc_id")



@query(
    """WITH d AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS size FROM documents), s AS (SELECT count(*) AS n, avg(size) AS mean FROM d),
    g AS (SELECT doc_id, size, t, unnest(['han', 'anh', 'nha', 'haa']) AS gram FROM d), f AS (SELECT doc_id, size, t, gram,
        len(list_filter(range(1, size + 1), lambda i: substr(t, i, 3) = gram)) AS tf FROM g WHERE contains(t, gram)),
    df AS (SELECT gram, count(*) AS df FROM f GROUP BY gram)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
    FROM f JOIN df USING (gram), s WHERE contains(t, 'hanhaa') GROUP BY doc_id"""
)
def trigram_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a phrase, ranked by its trigrams."""
    return search.trigram_bm25(table(spark, sf_dir, "documents"), "hanhaa", "doc_id", "text").withColumn("score", F.round("score", 6))


@query(
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role <> prev) AS switches, arg_min(text, turn) AS opening FROM (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id"""
)
def thread_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and changes of speaker of each thread, and how it opens."""
    rows = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") != F.col("prev")).alias("switches"), F.min_by("text", "turn").alias("opening"))


@query(
    """SELECT d.doc_id, length(text) >= 200 AND coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AS indexable FROM documents d LEFT JOIN (
        SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"""
)
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document may be indexed: long enough, and neither bad nor toxic where it is labelled."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ok = (F.char_length("text") >= 200) & (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", ok.alias("indexable"))
