"""Dates, money, shown values, hashes, ids, store fields and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import scalar, values
from loamworks.plans.registry import query
from loamworks.session import table

NOW = 1_706_745_600_000


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def _told(rows: list[tuple], names: str) -> str:
    """Rows with what is expected of them, as SQL."""
    return f"told({names}) AS (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)})"


def _dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], names: list[str]) -> DataFrame:
    """event_id and one of the rows' fields each, dealt out in turn."""
    dealt = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]), (F.col("event_id") % len(rows) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", dealt.alias("r")).select("event_id", "r.*")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y') END AS released FROM orders"""
)
def release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as stores write them: day, month or year, or none."""
    form = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, form("MMM d, yyyy")).when(k == 1, F.concat(F.lit(" "), form("d MMM,  yyyy"))).when(k == 2, form("MMMM yyyy")).when(k == 3, form("MMM, yyyy")).when(k == 4, form("yyyy")).when(k == 5, "Feb 30, 2017").otherwise("Coming soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.release_date(text).alias("released"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(date_trunc('year', o_orderdate)) WHEN 1 THEN epoch_ms(date_trunc('month', o_orderdate)) WHEN 2 THEN epoch_ms(date_trunc('day', o_orderdate)) END AS ms,
        CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' END AS precision, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS fuzzy FROM orders"""
)
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial ISO dates as moments with their precision, and dates put together from parts that may be missing."""
    k, j, d = F.col("o_orderkey") % 4, F.col("o_orderkey") % 5, F.col("o_orderdate")
    iso = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    fuzzy = values.fuzzy_date(F.year(d), F.when(j != 0, F.month(d)), F.when(j > 1, F.day(d)))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.date_ms(iso).alias("ms"), values.date_precision(iso).alias("precision"), fuzzy.alias("fuzzy"))


#: What is written, where, and the price that it means.
PRICES = [
    ("$1,234.50", "US", 1234.5), ("1234.5 USD", "US", 1234.5), ("1.234,50 €", "DE", 1234.5), ("€ 99", "DE", 99.0), ("1 234,50 EUR", "FR", 1234.5), ("1 234", "FR", 1234.0), ("₩1,234,000", "KR", 1234000.0), ("25,000원", "KR", 25000.0), ("¥980", "JP", 980.0),
    ("CA$12.99", "CA", 12.99), ("A$ 5", "AU", 5.0), ("£10", "GB", 10.0), ("1,23", "US", None), ("-5", "US", None), ("10-20", "US", None), ("1.234", "US", None), ("1,234.567", "US", None), ("1234,50", "US", None), ("₩12.5", "KR", None), ("free", "US", None), ("$0", "US", None),
    ("", "DE", None), ("1.23.456", "DE", None), ("5", "XX", None),
]


@query(f"WITH {_told(PRICES, 'text, country, price')} SELECT event_id, CAST(price AS DOUBLE) AS price FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(PRICES)}")
def local_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as eight markets write them."""
    return _dealt(spark, sf_dir, PRICES, ["text", "country", "told"]).select("event_id", values.market_price(F.col("text"), F.col("country")).alias("price"))


@query(
    f"""SELECT event_id, CASE WHEN value - 10 > 0 AND {NOW} - epoch_us(ts) // 1000 <= 864000000 THEN CAST(floor((value - 10) * 1342.5 / 100 + 0.5) * 100 AS BIGINT) END AS amount FROM events"""
)
def approx_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in another currency, where the rate is not stale."""
    amount = values.approx_amount(F.col("value") - 10, F.lit(1342.5), scalar.millis(F.col("ts")), NOW)
    return table(spark, sf_dir, "events").select("event_id", amount.alias("amount"))


#: Value, kind, unit, and how it is shown.
SHOWN = [
    ("true", "bool", None, "Yes"), ("false", "bool", None, "No"), ('["Web","iOS"]', "list", None, "Web · iOS"), ("2026-09-28", "date", None, "2026.09.28"), ("2026-09", "date", None, "2026.09"), ("soon", "date", None, "soon"), ("1050000", "tokens", None, "1.05M"),
    ("2000000", "tokens", None, "2M"), ("128000", "tokens", None, "128K"), ("8192", "tokens", None, "8.2K"), ("512", "tokens", None, "512"), ("1234.5", "money", "USD", "$1,234.5"), ("20", "money", "USD", "$20"), ("29400", "money", "KRW", "₩29,400"), ("7", "money", "CHF", "7 CHF"),
    ("16384", "number", "MB", "16,384 MB"), ("3.25", "number", None, "3.25"), ("4096", "number", "tokens", "4,096"), ("plain", "text", None, "plain"), (None, "number", "GB", "—"),
]


@query(f"WITH {_told(SHOWN, 'value, kind, unit, shown')} SELECT event_id, shown FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(SHOWN)}")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all kinds for readers."""
    return _dealt(spark, sf_dir, SHOWN, ["value", "kind", "unit", "told"]).select("event_id", values.shown_value(F.col("value"), F.col("kind"), F.col("unit")).alias("shown"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ': ' || p_brand || ' changed' WHEN 1 THEN p_name || ': ' || p_brand || ' added' WHEN 2 THEN p_name || ' ' || p_size || '.0 released' WHEN 3 THEN p_name || ' incident' ELSE p_name END AS title FROM part"""
)
def change_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line about each change."""
    kind = F.element_at(F.array(*map(F.lit, ("fact_changed", "fact_added", "version_released", "incident", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", values.change_title(kind, F.col("p_name"), F.col("p_brand"), F.concat("p_size", F.lit(".0"))).alias("title"))


@query(
    """SELECT p_partkey, format('{:016x}', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name || ' ' || p_brand, ''), lambda c: unicode(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)) AS hash FROM part"""
)
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit FNV-1a of names."""
    return table(spark, sf_dir, "part").select("p_partkey", values.fnv64(F.concat_ws(" ", "p_name", "p_brand")).alias("hash"))


SECRET = "a secret of tests, of thirty-two characters and more"
_PADS = [bytes(b ^ pad for b in SECRET.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(
    f"""WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, 'v4:10.' || (user_id % 256) || '.' || (event_id % 3) AS net FROM events),
    m AS (SELECT day, net, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || ('anon-day/v1' || chr(10) || day || chr(10) || net)::BLOB))) AS mac FROM d),
    n AS (SELECT day, net, mac, CAST('0x' || left(mac, 8) AS BIGINT) % 14776336 AS n FROM m), b AS (SELECT '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' AS s)
    SELECT day, net, s[n // 238328 + 1] || s[n // 3844 % 62 + 1] || s[n // 62 % 62 + 1] || s[n % 62 + 1] AS id FROM n, b"""
)
def daily_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of networks that hold for a day."""
    net = F.concat(F.lit("v4:10."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 3)
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), net.alias("net")).distinct()
    return rows.select("day", "net", values.daily_id(SECRET, F.col("day"), F.col("net")).alias("id"))


#: A store's list of languages, how many there are, and what is said of Korean.
LANGUAGES = [
    ("English<strong>*</strong>, Korean, Japanese<strong>*</strong><br><strong>*</strong>languages with full audio support", 3, "interface_subtitles"), ("Korean<strong>*</strong>", 1, "full_audio"), ("English, French,\nGerman", 3, "none"), ("", 0, None), (None, 0, None),
    ("English[b]*[/b], KOREAN , English", 2, "interface_subtitles"), ("Simplified Chinese &amp; more, <b>Korean</b> *, languages with full audio support", 2, "full_audio"),
]


@query(f"WITH {_told(LANGUAGES, 'html, n, korean')} SELECT event_id, CAST(n AS INTEGER) AS n, korean FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(LANGUAGES)}")
def language_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of store pages, and the support of one."""
    found = values.store_languages(F.col("html"))
    return _dealt(spark, sf_dir, LANGUAGES, ["html", "told_n", "told"]).select("event_id", F.size(found).alias("n"), values.language_support(found, "korean").alias("korean"))


#: Title, whether tagged; whether an update, its version and channel.
TITLES = [
    ("Patch 1.2.3", False, True, "1.2.3", "stable"), ("Terraria 1.4.5.7 - Out Now", False, True, "1.4.5.7", "stable"), ("Kenshi 1.0.65 + FCS 2.14.2 Hotfix", False, True, "1.0.65", "stable"), ("Update notes for v1.5.78", False, True, "1.5.78", "stable"),
    ("12.4a Hotfix", False, True, "12.4a", "stable"), ("Patch 8", False, True, "Patch 8", "stable"), ("hotfix #36", False, True, "Hotfix #36", "stable"), ("Version 20260924 Patch Notes", False, True, "20260924", "stable"), ("Roadmap for 1.5.0", False, False, None, "stable"),
    ("Upcoming patch 2.0.1", True, False, None, "stable"), ("Weekend Sale: 50% off", False, False, None, "stable"), ("Community spotlight", False, False, None, "stable"), ("A tagged post", True, True, None, "stable"), ("Beta build 0.9.1", False, True, "0.9.1", "beta"),
    ("패치 1.2.4 노트", False, True, "1.2.4", "stable"), ("Update 2026.09.28", False, False, None, "stable"), ("Our game 1.0.2 has new hats", False, False, None, "stable"), ("v2.1 is live", False, True, "2.1", "stable"),
]


@query(f"WITH {_told(TITLES, 'title, tagged, upd, version, channel')} SELECT event_id, upd AS is_update, version, channel FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(TITLES)}")
def post_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What posts are by their titles."""
    rows = _dealt(spark, sf_dir, TITLES, ["title", "tagged", "a", "b", "c"]).select("event_id", values.post_kind(F.col("title"), F.col("tagged")).alias("k"))
    return rows.select("event_id", F.col("k.update").alias("is_update"), "k.version", "k.channel")


@query(
    f"""WITH {_told(TITLES, 'title, tagged, upd, version, channel')}, p AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, event_id, version FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(TITLES)} WHERE upd AND channel = 'stable'),
    v AS (SELECT user_id, version, min(sec) AS first FROM p WHERE version IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first // 86400 DESC, version) AS place FROM v)
    SELECT user_id, version, strftime(to_timestamp(first) AT TIME ZONE 'UTC', '%Y-%m-%d') AS released, place FROM k WHERE place <= 8"""
)
def news_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed's eight newest versions, with the day of the first post about each."""
    from loamworks.sources import feeds

    posts = _dealt(spark, sf_dir, TITLES, ["title", "tagged", "a", "b", "c"]).join(table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("date")), "event_id")
    body = F.to_json(F.struct(F.struct(F.collect_list(F.struct("title", "date", F.when(F.col("tagged"), F.array(F.lit("patchnotes"))).alias("tags"))).alias("newsitems")).alias("appnews")))
    return feeds.news_versions(posts.groupBy("user_id").agg(body.alias("body")), "user_id", keep=8)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'release' ELSE 'update' END AS kind FROM documents")
def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text tells of a launch."""
    text = F.when(F.col("doc_id") % 6 == 0, "Now available: the thing").when(F.col("doc_id") % 3 == 0, "It is now GA").when(F.col("doc_id") % 3 == 1, "Fixed a prereleasedness bug").otherwise("Faster")
    return table(spark, sf_dir, "documents").select("doc_id", values.change_kind(text).alias("kind"))


#: Listing title, and whether it is exactly an RTX 4060 Ti with 16 GB.
LISTINGS = [
    ("MSI RTX 4060 Ti 16GB Gaming X", "RTX 4060 Ti 16GB", True), ("RTX 4060Ti 16 GB", "RTX 4060 Ti 16GB", True), ("RTX 4060 16GB", "RTX 4060 Ti 16GB", False), ("RTX 4060 Ti 8GB", "RTX 4060 Ti 16GB", False), ("RTX 4060 Ti Super 16GB", "RTX 4060 Ti 16GB", False),
    ("RTX 4060 Ti 16GB laptop", "RTX 4060 Ti 16GB", False), ("Wanted: RTX 4060 Ti 16GB", "RTX 4060 Ti 16GB", False), ("GTX 4060 Ti 16GB", "RTX 4060 Ti 16GB", False), ("RTX 40600 Ti 16GB", "RTX 4060 Ti 16GB", False), ("RTX 4060 Ti 16GB 부품용", "RTX 4060 Ti 16GB", False),
    ("geforce rtx 4060 ti 16gb", "RTX 4060 Ti 16GB", True), ("", "RTX 4060 Ti 16GB", False), ("Intel Core i5-12400F processor", "i5-12400F", True), ("Intel i5-12400F CPU", "i5-12400", False), ("Core i7 13700K boxed", "Core i7-13700K", True), ("i7-13700", "Core i7-13700K", False),
    ("Intel Core Ultra 7 265K", "Core Ultra 7 265K", True), ("Intel Core Ultra 7 265KF", "Core Ultra 7 265K", False), ("AMD Ryzen 5 5600 CPU", "Ryzen 5600", True), ("Ryzen 5 5600X CPU", "Ryzen 5 5600", False), ("Ryzen 7 7800X3D", "AMD Ryzen 7 7800X3D", True),
    ("Sapphire Pulse RX 6600 XT", "Radeon RX 6600 XT Pulse", True), ("AMD Radeon RX 6600 XT GPU", "RX 6600 XT Pulse", False), ("Intel Arc B580 12GB", "Arc B580", True), ("Intel Arc A580", "Arc B580", False), ("RTX 4060", "graphics card", False), ("ASUS Dual RTX 3060 12GB OC", "RTX 3060 dual-OC 12GB", False),
    ("ASUS Dual OC RTX 3060 12GB", "RTX 3060 dual-OC 12GB", True),
]


@query(f"WITH {_told(LISTINGS, 'title, wanted, ok')} SELECT event_id, ok FROM events JOIN (SELECT *, row_number() OVER () - 1 AS k FROM told) ON k = event_id % {len(LISTINGS)}")
def comparable_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listings are exactly the part that is wanted."""
    dealt = _dealt(spark, sf_dir, LISTINGS, ["title", "wanted", "told"])
    ok = F.lit(None).cast("boolean")
    for wanted in sorted({w for _, w, _ in LISTINGS}):
        ok = F.when(F.col("wanted") == wanted, values.comparable_title(F.col("title"), wanted)).otherwise(ok)
    return dealt.select("event_id", ok.alias("ok"))
