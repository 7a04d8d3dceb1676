"""Documents of sources, made of the tables, read back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.plans.registry import query
from loamworks.sources import feeds, market_posts, sinks
from loamworks.session import table


def _json_list(rows: DataFrame, key: str, **fields: Column) -> DataFrame:
    """(key, body): a JSON list of a key's rows."""
    return rows.groupBy(key).agg(F.to_json(F.collect_list(F.struct(*[c.alias(k) for k, c in fields.items()]))).alias("body"))


@query(
    """WITH r AS (SELECT o_custkey, 'v' || o_orderkey AS tag, o_orderdate AS d, o_orderstatus <> 'F' AS stable, o_orderkey FROM orders WHERE o_orderkey % 5 > 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC, tag DESC) AS p, row_number() OVER (PARTITION BY o_custkey, stable ORDER BY d DESC, tag DESC) AS s FROM r)
    SELECT o_custkey, tag, strftime(d, '%Y-%m-%d') AS published, stable AS is_stable FROM p WHERE p <= 5 OR (stable AND s = 1)"""
)
def release_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest releases of each list, and the newest stable one."""
    o = table(spark, sf_dir, "orders")
    docs = _json_list(o, "o_custkey", tag_name=F.concat(F.lit("v"), "o_orderkey"), draft=F.col("o_orderkey") % 5 == 0, prerelease=F.col("o_orderstatus") == "F", published_at=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return feeds.releases(docs, "o_custkey").withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("SELECT p_brand AS branch, p_partkey || '.' || p_size AS version, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS released FROM part WHERE p_partkey % 3 > 0")
def branch_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases by branch; odd versions and dates are left out."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    version = F.when(k % 6 == 0, "latest").otherwise(F.concat(k.cast("string"), F.lit("."), "p_size"))
    day = F.when(k % 6 == 3, "soon").otherwise(F.format_string("2024-01-%02d", k % 28 + 1))
    inner = part.groupBy("p_brand").agg(F.struct(F.lit("x").alias("type"), F.collect_list(F.struct(version.alias("release_version"), day.alias("release_date"))).alias("driver_info")).alias("v"))
    body = inner.select(F.to_json(F.create_map("p_brand", "v")).alias("body"))
    return feeds.keyed_releases(body).withColumn("released", F.col("released").cast("string"))


def _tag(name: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


@query("SELECT o_custkey, 'id' || o_orderkey AS id, o_orderpriority || ' & <more>' AS title, 'https://x.test/' || o_orderkey || '?a=1&b=2' AS url, strftime(o_orderdate, '%Y-%m-%d') AS published, '<p>' || o_orderstatus || '</p>' AS content FROM orders")
def atom_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of feeds."""
    o = table(spark, sf_dir, "orders")
    entry = F.concat(F.lit("<entry>"), _tag("id", F.concat(F.lit("id"), "o_orderkey")), _tag("title", F.concat("o_orderpriority", F.lit(" &amp; &lt;more&gt;"))), F.lit('<link rel="alternate" href="https://x.test/'), "o_orderkey", F.lit('?a=1&amp;b=2"/>'),
        _tag("updated", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit('<content type="html">&lt;p&gt;'), "o_orderstatus", F.lit("&lt;/p&gt;</content></entry>"))
    docs = o.groupBy("o_custkey").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("body"))
    return feeds.atom_entries(docs).withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("SELECT o_custkey, 'T' || o_orderkey AS title, 'https://y.test/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS published, strftime(o_orderdate + INTERVAL 33 HOUR, '%Y-%m-%d') AS local_day, o_orderpriority || ' now' AS text FROM orders")
def rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds, with the day in the +9 hour calendar of a post late on its day."""
    stamp = F.concat(F.lit("Tue, "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 23:59:59 +0000"))
    item = F.concat(F.lit("<item>"), _tag("title", F.concat(F.lit("<![CDATA[T"), "o_orderkey", F.lit("]]>"))), _tag("link", F.concat(F.lit("https://y.test/"), "o_orderkey")), _tag("pubDate", stamp), _tag("description", F.concat(F.lit("&lt;b&gt;"), "o_orderpriority", F.lit("&lt;/b&gt; now"))), F.lit("</item>"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    local = F.date_format(F.timestamp_seconds(F.unix_seconds("published") + 9 * 3600), "yyyy-MM-dd")
    return feeds.rss_items(docs).withColumn("local_day", local).withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("SELECT o_custkey, strftime(d, '%Y-%m-%d') AS released, n AS lines FROM (SELECT o_custkey, o_orderdate AS d, count(*) AS n FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL)")
def changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated sections of changelogs and how many lines they have."""
    lines = table(spark, sf_dir, "orders").filter("o_orderkey % 4 > 0").groupBy("o_custkey", "o_orderdate").agg(F.array_join(F.transform(F.collect_list("o_orderpriority"), lambda x: F.concat(F.lit("- "), x)), "\n").alias("lines"))
    head = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" (beta)")))
    docs = lines.groupBy("o_custkey").agg(F.concat(F.lit("# All\n### Unsorted\n- x\n"), F.array_join(F.collect_list(F.concat(F.lit("### "), head, F.lit("\n\ntext\n"), "lines")), "\n")).alias("body"))
    return feeds.changelog_sections(docs).select("o_custkey", F.col("released").cast("string").alias("released"), F.size("lines").cast("bigint").alias("lines"))


@query("SELECT c_nationkey, c_custkey || '.' || c_nationkey AS version, '2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS released FROM customer")
def heading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in the headings of plain texts."""
    k = F.col("c_custkey")
    head = F.concat(F.lit("v"), k, F.lit("."), "c_nationkey", F.lit(" - March "), k % 28 + 1, F.lit(" 2024\n   - v1.2 - not a heading"))
    docs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(head), "\n").alias("body"))
    return feeds.heading_versions(docs).withColumn("released", F.col("released").cast("string"))


@query("SELECT n_nationkey, round((1300 + n_nationkey * 2.5) / (1 + n_nationkey / 100.0), 9) AS rate FROM nation WHERE n_nationkey % 6 > 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 6 = 0")
def cross_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One currency in another, by way of a third."""
    k = F.col("n_nationkey")
    cube = F.concat(F.lit("<Cube><Cube currency='USD' rate='"), (1 + k / 100).cast("string"), F.lit("'/>"), F.when(k % 6 > 0, F.concat(F.lit("<Cube currency='KRW' rate='"), (1300 + k * 2.5).cast("string"), F.lit("'/>"))).otherwise(""), F.lit("</Cube>"))
    return feeds.cross_rate(table(spark, sf_dir, "nation").select("n_nationkey", cube.alias("body")), "USD", "KRW").withColumn("rate", F.round("rate", 9))


@query(
    """SELECT name, 'CUDA' AS backend, count(*) AS samples, round(median(score), 3) AS median FROM (SELECT p_partkey // 2 AS id, arg_min('D' || p_size, p_partkey) AS name, arg_min(3 * p_retailprice, p_partkey) AS score FROM part WHERE p_partkey % 5 > 0 GROUP BY ALL) GROUP BY name HAVING count(*) >= 3"""
)
def benchmark_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median scores of devices with three submissions or more; a fifth ran the wrong version."""
    run = lambda scene: F.struct(F.when(F.col("p_partkey") % 5 > 0, "4.0").otherwise("3.9").alias("version"), F.lit(scene).alias("scene"), F.col("p_retailprice").alias("score"), F.concat(F.lit("D"), "p_size").alias("device"), F.lit("CUDA").alias("backend"), F.lit(1).alias("sockets"))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2).alias("id"), F.col("p_partkey").alias("position"), F.array(run("a"), run("b"), run("c")).alias("data"))
    return feeds.benchmark_scores(rows, ("a", "b", "c"), "4.0")


@query(
    """SELECT 'i' || o_orderkey AS incident, CASE WHEN o_orderkey % 9 = 0 THEN 'Incident' WHEN o_orderkey % 4 = 0 THEN 'API errors' ELSE o_orderpriority END AS title, strftime(o_orderdate, '%Y-%m-%d') AS starts, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS ends,
        CASE WHEN o_orderstatus = 'F' THEN 'ended' ELSE 'confirmed' END AS status, CASE WHEN o_orderkey % 2 > 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'service:api' WHEN 1 THEN 'service:chat' ELSE 'provider:x' END WHEN o_orderkey % 4 = 0 AND o_orderkey % 9 > 0 THEN 'service:api' ELSE 'provider:x' END AS entities FROM orders"""
)
def incident_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of three documents: a list, a feed with components, and the groups of components."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    inc = F.struct(F.concat(F.lit("i"), k).alias("id"), F.when(k % 9 == 0, " ").when(k % 4 == 0, "API errors").otherwise(F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("investigating").alias("status"),
        iso("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", iso(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))).alias("resolved_at"))
    by = F.col("o_custkey") % 50
    incidents = o.groupBy(by).agg(F.to_json(F.struct(F.collect_list(inc).alias("incidents"))).alias("body"))
    entry = F.concat(F.lit("<entry><id>x</id><link href=\"https://s.test/incidents/i"), k, F.lit("\"/><content>Affected components&lt;ul&gt;&lt;li&gt;C"), F.col("o_custkey") % 3, F.lit(" (Degraded)&lt;/li&gt;&lt;/ul&gt;</content></entry>"))
    feed = o.filter("o_orderkey % 2 > 0").groupBy(by).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    groups = spark.createDataFrame([('{"summary":{"structure":{"items":[{"group":{"name":"APIs","components":[{"name":"C0"}]}},{"group":{"name":"Chat","components":[{"name":"C1"}]}},{"component":{"name":"C2"}}]}}}',)], "body string")
    got = feeds.incident_events(incidents, feeds.feed_components(feed), feeds.component_groups(groups), {"APIs": "service:api", "Chat": "service:chat"}, [(r"\bAPIs?\b", "service:api")], "provider:x")
    return got.select("incident", "title", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("starts", "ends")], "status", F.array_join("entities", ",").alias("entities"))


@query(
    """SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS starts, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS ends, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 1 END AS updates FROM events"""
)
def status_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When incidents started and ended, by the lines of their updates, whose year is left out; those around the turn of a year too."""
    ts = F.col("ts").cast("timestamp")
    line = lambda t, s: F.concat(F.lit("<p><small>"), F.date_format(t, "MMM"), F.lit(" <var data-var='date'> "), F.date_format(t, "d"), F.lit("</var>, <var data-var='time'>"), F.date_format(t, "HH:mm"), F.lit(f"</var> UTC</small><br><strong>{s}</strong> - text</p>"))
    content = F.concat(F.when(F.col("event_id") % 3 > 0, line(ts, "Resolved")).otherwise(""), line(ts - F.expr("INTERVAL 2 HOURS"), "Investigating"))
    out = feeds.status_updates(table(spark, sf_dir, "events").select("event_id", content.alias("content"), ts.alias("published")))
    return out.select("event_id", *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("starts", "ends")], F.size("updates").alias("updates"))


@query(
    """WITH l AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part), s AS (SELECT *, pos <= 50 AND p_partkey % 3 = 0 AND p_partkey % 7 > 0 AS ok, p_partkey // 2 AS id FROM l WHERE pos <= 50),
    f AS (SELECT *, ok AND row_number() OVER (PARTITION BY p_brand, ok, id ORDER BY pos) = 1 AS good FROM s)
    SELECT p_brand, count(*) FILTER (WHERE good) AS accepted, count(*) FILTER (WHERE NOT good) AS excluded, coalesce(sum(CASE WHEN good THEN p_partkey % 100 + 0.5 END), 0) AS total, count(*) FILTER (WHERE good AND p_partkey % 2 = 0) AS free FROM f GROUP BY p_brand"""
)
def market_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings taken from a marketplace's answers, and how many were not."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "RTX 4060 Ti 16GB dual fan").when(k % 3 == 1, "RTX 4060 16GB").otherwise("RTX 4060 Ti 16GB bundle")
    ship = F.struct(F.struct(F.when(k % 2 == 0, "0.00").otherwise("9.90").alias("value"), F.lit("USD").alias("currency")).alias("shippingCost"))
    item = F.struct(F.floor(k / 2).cast("string").alias("itemId"), title.alias("title"), F.concat(F.when(k % 7 > 0, "https://www.m.test/itm/").otherwise("http://www.m.test/itm/"), k).alias("itemWebUrl"), F.struct(F.concat((k % 100).cast("string"), F.lit(".50")).alias("value"), F.lit("USD").alias("currency")).alias("price"),
        F.struct(F.lit("US").alias("country")).alias("itemLocation"), F.lit("3000").alias("conditionId"), F.array(F.lit("FIXED_PRICE")).alias("buyingOptions"), F.array(ship).alias("shippingOptions"))
    docs = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("i")))), lambda x: x["i"]).alias("itemSummaries"))).alias("body"))
    items, counts = feeds.market_listings(docs, "p_brand", "US", "USD", "RTX 4060 Ti 16GB", ("www.m.test",))
    sums = items.groupBy("p_brand").agg(F.sum("price").alias("total"), F.count_if(F.col("shipping") == 0).alias("free"))
    return counts.join(sums, "p_brand", "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "free": F.coalesce("free", F.lit(0))})


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'airing' WHEN 1 THEN 'finished' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'hiatus' END AS status, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey % 13 AS INTEGER) END AS episodes,
        CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate + INTERVAL 32 HOUR, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS release,
        CASE WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y') END AS ended, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate + INTERVAL 32 HOUR, '%Y-%m-%dT%H:%M+09:00') END AS airs_at FROM orders"""
)
def airing_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of broadcasts: states, dates of all precisions, and times in the +9 hour calendar."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = lambda m, x: F.struct(F.year(d).alias("year"), F.when(m, F.month(d)).alias("month"), F.when(x, F.dayofmonth(d)).alias("day"))
    status = F.element_at(F.array(*map(F.lit, ("RELEASING", "FINISHED", "NOT_YET_RELEASED", "HIATUS", "OTHER"))), (k % 5 + 1).cast("int"))
    media = F.struct(k.alias("id"), F.lit("TV").alias("format"), status.alias("status"), (k % 13).alias("episodes"), date(k % 3 > 0, k % 3 > 1).alias("startDate"), date(F.lit(False), F.lit(False)).alias("endDate"),
        F.when(k % 4 > 0, F.struct((k % 4).alias("episode"), (F.unix_seconds(d.cast("timestamp")) + 23 * 3600).alias("airingAt"))).alias("nextAiringEpisode"))
    docs = table(spark, sf_dir, "orders").groupBy(F.floor(k / 50)).agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(media).alias("media")).alias("Page")).alias("data"))).alias("body"))
    return feeds.airing_schedule(docs).drop("airs_day")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS app, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'K ' || p_name END AS local_name, p_partkey % 4 = 0 AS upcoming, CASE WHEN p_partkey % 4 > 0 THEN '2020-02-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS released,
        CASE p_partkey % 3 WHEN 0 THEN 'full_audio' WHEN 1 THEN 'none' ELSE 'interface_subtitles' END AS korean, CASE p_partkey % 3 WHEN 1 THEN 1 ELSE 2 END AS languages, CASE WHEN p_size % 2 = 0 THEN 'windows,linux' ELSE 'windows' END AS platforms FROM part WHERE p_partkey % 10 <> 7"""
)
def store_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of a store's answers in two languages."""
    k = F.col("p_partkey")
    languages = F.when(k % 3 == 0, "English, Korean<strong>*</strong><br>with full audio").when(k % 3 == 1, "English").otherwise("Korean, English")
    game = lambda name: F.struct(name.alias("name"), k.alias("steam_appid"), languages.alias("supported_languages"), F.array("p_brand").alias("developers"), F.struct((k % 4 == 0).alias("coming_soon"), F.when(k % 4 > 0, F.concat(F.lit("Feb "), k % 28 + 1, F.lit(", 2020"))).otherwise("Q3 2027").alias("date")).alias("release_date"),
        F.struct(F.lit(True).alias("windows"), F.lit(False).alias("mac"), (F.col("p_size") % 2 == 0).alias("linux")).alias("platforms"))
    body = lambda name: F.to_json(F.create_map(k.cast("string"), F.struct((k % 10 != 7).alias("success"), game(name).alias("data"))))
    part = table(spark, sf_dir, "part")
    got = feeds.store_games(part.select(body(F.concat(F.col("p_name"), F.lit(" "))).alias("body")), part.select(body(F.when(k % 3 == 0, F.concat(F.lit("K "), "p_name")).otherwise(F.upper("p_name"))).alias("body")))
    return got.withColumn("platforms", F.array_join("platforms", ",")).drop("developers")


@query("SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 OR o_custkey % 7 = 0 THEN 0 ELSE count(*) END AS rows, CASE WHEN o_custkey % 4 = 0 THEN 'empty' WHEN o_custkey % 7 = 0 THEN 'not JSON' END AS error FROM orders GROUP BY o_custkey")
def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's run went: rows, or what was wrong; a bad one stops no other."""
    docs = _json_list(table(spark, sf_dir, "orders"), "o_custkey", tag_name=F.col("o_orderkey").cast("string"), published_at=F.lit("2024-01-01T00:00:00Z"))
    docs = docs.withColumn("body", F.when(F.col("o_custkey") % 4 == 0, None).when(F.col("o_custkey") % 7 == 0, "<html>").otherwise(F.col("body")))
    return feeds.run_outcomes(docs, lambda d: feeds.releases(d, "o_custkey", keep=1_000_000), "o_custkey")


@query("SELECT '/' || c_nationkey || '/' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'en,ko' ELSE 'en' END AS locales FROM customer WHERE c_acctbal > 0 ORDER BY path LIMIT 20000")
def sitemap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may be indexed, with the languages that they are in; a sitemap holds 20000."""
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("/"), "c_nationkey", F.lit("/"), "c_custkey").alias("path"), F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("ko"), F.lit("en"))).otherwise(F.array(F.lit("en")))).alias("locale"), (F.col("c_acctbal") > 0).alias("ok"))
    return sinks.sitemap(pages, "path", "locale", "ok").select("path", F.array_join(F.map_keys("alternates"), ",").alias("locales"))


@query(
    r"""WITH h AS (SELECT page_id, lower(regexp_extract(html, '(?i)<(article|main|div|nav)\b[^>]*>', 1)) AS tag, regexp_extract(html, '(?i)<(?:article|main|div|nav)\b[^>]*>') AS opening, html FROM pages),
    r AS (SELECT page_id, tag, substr(html, position(opening IN html) + length(opening)) AS rest FROM h WHERE tag <> ''),
    t AS (SELECT page_id, rest, unnest(regexp_extract_all(rest, '(?i)</?' || tag || '(?:\s[^>]*)?>')) AS t, generate_subscripts(regexp_extract_all(rest, '(?i)</?' || tag || '(?:\s[^>]*)?>'), 1) AS n FROM r),
    d AS (SELECT *, 1 + sum(CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') THEN 0 ELSE 1 END) OVER w AS depth, sum(length(t)) OVER w AS tags FROM t WINDOW w AS (PARTITION BY page_id ORDER BY n)),
    e AS (SELECT page_id, min(n) AS n FROM d WHERE depth = 0 GROUP BY page_id),
    l AS (SELECT r.page_id, r.tag, list_reduce(string_split_regex(r.rest, '(?i)</?' || r.tag || '(?:\s[^>]*)?>')[1:e.n], lambda a, x: a || x) AS bare, d.tags - length(d.t) AS tags FROM r JOIN e USING (page_id) JOIN d ON d.page_id = r.page_id AND d.n = e.n)
    SELECT page_id, tag, CAST(length(bare) + tags AS BIGINT) AS n_chars, md5(bare) AS bare_md5 FROM l"""
)
def balanced_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's first article, main, division or menu holds, up to its own end tag: its length, and a digest of it without the tags of its name."""
    opening = r"(?i)<(article|main|div|nav)\b[^>]*>"
    tag = F.lower(F.regexp_extract("html", opening, 1))
    rows = table(spark, sf_dir, "pages").select("page_id", tag.alias("tag"), feeds.balanced(F.col("html"), opening, tag).alias("e")).filter("e IS NOT NULL")
    own = F.concat(F.lit("(?i)</?"), "tag", F.lit(r"(?:\s[^>]*)?>"))
    return rows.select("page_id", "tag", F.char_length("e").cast("bigint").alias("n_chars"), F.md5(F.regexp_replace("e", own, F.lit(""))).alias("bare_md5"))


#: (title, body, items as (place, model, capacity, price, basis, excluded)) of posts, in dollars.
POSTS = [
    ("[WTS] cards", "<p>RTX 3080 10GB - $350 shipped</p><p>good card</p><p>RX 6600 XT $150</p>", [(1, "RTX 3080", "10", 350.0, "asking", False), (2, "RX 6600 XT", "", 150.0, "asking", False)]), ("RTX 3060 12GB", "<div>RTX 3060<div>$200</div></div>", [(1, "RTX 3060", "12", 200.0, "asking", False)]),
    ("WTB RTX 3060", "RTX 3060 $200", [(1, None, None, None, None, True)]), ("cards", "RTX 3060 $200<br>RX 580 $90<br>RTX 3060 $210", [(1, "RTX 3060", "", 200.0, "asking", False), (2, "RX 580", "", 90.0, "asking", False), (3, "RTX 3060", "", 210.0, "asking", True)]),
    ("cards", "nothing here", []), ("cards", "RTX 3060 $200<br>-----<br>$999<br>RTX 3060 12GB $250 SOLD", [(1, "RTX 3060", "", 200.0, "asking", False), (2, "RTX 3060", "12", 250.0, "sold", False)]),
]


def _posts_sql() -> str:
    text = lambda v: "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v)
    rows = ", ".join(f"({k}, {', '.join(map(text, item))})" for k, (_, _, found) in enumerate(POSTS) for item in found)
    return f"SELECT event_id, CAST(place AS BIGINT) AS place, model, capacity, CAST(price AS DOUBLE) AS price, basis, excluded FROM events JOIN (VALUES {rows}) i(k, place, model, capacity, price, basis, excluded) ON k = event_id % {len(POSTS)}"


@query(_posts_sql())
def market_post_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of posts on boards, dealt out to the events: many of one post, one, or none."""
    post = F.element_at(F.array(*[F.struct(F.lit(t).alias("title"), F.lit(b).alias("body")) for t, b, _ in POSTS]), (F.col("event_id") % len(POSTS) + 1).cast("int"))
    posts = table(spark, sf_dir, "events").select("event_id", post.alias("p")).select("event_id", "p.*")
    return market_posts.items(posts, "event_id", "USD").drop("shipping")


@query(
    """WITH r AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) + o_orderkey % 1000 AS created, o_custkey % 3 AS os, o_custkey AS c, o_orderkey % 7 AS q FROM orders WHERE o_orderkey % 5 > 0 AND o_orderstatus <> 'P' AND o_custkey % 4 > 0 AND o_orderkey % 17 > 0),
    m AS (SELECT *, strftime(make_timestamp(created * 1000), '%Y-%m') AS month FROM r)
    SELECT month, 'app:' || c AS subject, CASE os WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' END AS os, CASE WHEN q > 0 THEN 'Q' || q END AS quant, strftime(make_timestamp(created * 1000), '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY created, id) AS n FROM m) WHERE n <= 50000"""
)
def open_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as they are given away: public ones whose post still stands, without names and free text."""
    key, system = F.col("o_orderkey"), F.col("o_custkey") % 3
    env = F.to_json(F.struct(F.when(system == 0, "Windows 11 of mine").when(system == 1, "Ubuntu").otherwise("something").alias("os"), F.when(key % 7 > 0, F.concat(F.lit("Q"), key % 7)).otherwise("free text; of any kind").alias("quant"), F.lit("x").alias("note")))
    rows = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 5 > 0, "compat").otherwise("issue").alias("kind"), F.when(F.col("o_orderstatus") == "P", "hidden").otherwise("published").alias("status"), F.when(F.col("o_custkey") % 4 > 0, "public").otherwise("private").alias("visibility"),
        F.concat(F.lit("app:"), "o_custkey").alias("subject"), F.lit("1").alias("subject_version"), F.lit("app:x").alias("target"), F.lit("2").alias("target_version"), env.alias("env"), F.lit("works").alias("result"), (scalar.millis(F.col("o_orderdate")) + key % 1000).alias("created_at"),
    )
    posts = rows.filter("id % 17 = 0").select(F.col("id").alias("report"), F.lit("removed").alias("status"))
    given, _ = sinks.open_reports(rows, posts)
    return given.select("month", "subject", F.try_element_at("env", F.lit("os")).alias("os"), F.try_element_at("env", F.lit("quant")).alias("quant"), "day")
