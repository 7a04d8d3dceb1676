"""Requests: who sent them, from what device, and what of an event may be logged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import agents
from loamworks.operators import traffic
from loamworks.plans.registry import query
from loamworks.session import table

_CHROME = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36"
_PHONE = "Mozilla/5.0 (Linux; Android 14; SM-S921N) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Mobile Safari/537.36"
#: Agent texts of all kinds, dealt out to the events.
SAMPLES = [
    _CHROME, _PHONE, "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.5 Mobile/15E148 Safari/604.1", "Mozilla/5.0 (iPad; CPU OS 17_5 like Mac OS X) AppleWebKit/605.1.15 Version/17.5 Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:127.0) Gecko/20100101 Firefox/127.0", "Mozilla/5.0 (Windows NT 6.1; rv:60.0) Gecko/20100101 Firefox/60.0", _CHROME + " Edg/126.0", _CHROME + " OPR/110.0", _CHROME + " Whale/3.26", _PHONE + " SamsungBrowser/25.0",
    _PHONE + " KAKAOTALK 10.8.0", _PHONE + " NAVER(inapp; search)", _PHONE + " Instagram 300.0", "Mozilla/5.0 (Linux; Android 13; CUBOT X70) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36", "Mozilla/5.0 (Linux; Android 12; SM-X200) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "Googlebot-Image/1.0", "Mozilla/5.0 (compatible; bingbot/2.0)", "Mozilla/5.0 (compatible; GPTBot/1.2)", "CCBot/2.0", "ccbot/2.0", "Mozilla/5.0 (compatible; Yeti/1.1)", "YandexMobile/1.0", "yandexmobile/1.0",
    "facebookexternalhit/1.1", "facebookexternalhit/1.1; kakaotalk-scrap/1.0", "TelegramBot (like TwitterBot)", "Slackbot-LinkExpanding 1.0", "UptimeRobot/2.0", "Mozilla/5.0 (X11) HeadlessChrome/126.0", "curl/8.5.0", "Wget/1.21", "python-requests/2.32", "Go-http-client/2.0", "node",
    "Dalvik/2.1.0 (Linux; U; Android 13)", "MyApp/1 CFNetwork/1490 Darwin/23", "axios/1.7", "SomeNewCrawler/1.0", "tiny-spider", "A preview of things/2", "Opera/9.80 (Windows NT 6.1)", "Some Client 3", "  ", "", None,
]
_NETWORKS = (0, 15169, 8075, 16509, 4766, 13238, 24940)


def _sql_text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event."""
    i = F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", pick(SAMPLES, i).alias("ua"), F.when(i % 11 != 0, "en").alias("accept_language"), F.when(i % 13 != 0, "navigate").alias("sec_fetch_mode"), pick(_NETWORKS, F.floor(i / 7)).alias("network"),
        F.when(i % 3 == 0, "A hosting company with a name of more than forty characters").alias("organization"), (i % 97 == 0).alias("verified"), F.when(i % 89 == 0, "AI Crawler").when(i % 83 == 0, "Webhooks").alias("platform_category"),
        F.when(i % 5 == 0, "beacon").otherwise("page").alias("kind"), (i % 17 == 0).alias("webdriver"),
    )


def _rules_sql(rules: list[tuple]) -> str:
    return ", ".join(f"({k}, {_sql_text(n)}, {_sql_text(p)}, {_sql_text(c)}, [{', '.join(map(str, w))}]::BIGINT[])" for k, (n, p, c, w) in enumerate(rules))


_OURS = "CASE platform_category " + " ".join(f"WHEN {_sql_text(k)} THEN '{v}'" for k, v in agents.PLATFORM_CATEGORIES.items()) + " ELSE 'other' END"
_BROWSER = "CASE " + " ".join(f"WHEN regexp_matches(ua, {_sql_text(p)}) THEN '{n}'" for n, p in agents.BROWSERS) + " ELSE 'other' END"
_DEVICE = """CASE WHEN regexp_matches(ua, '(?i)iPad|Tablet|PlayBook|Silk/|Kindle') OR (regexp_matches(ua, '(?i)Android') AND NOT regexp_matches(ua, '(?i)Android.*Mobile')) THEN 'tablet'
    WHEN regexp_matches(ua, '(?i)Mobi|iPhone|iPod|Android|Windows Phone') THEN 'mobile' ELSE 'desktop' END"""
_REQUESTS = f"""u AS (SELECT unnest(range({len(SAMPLES)})) AS k, unnest([{', '.join(map(_sql_text, SAMPLES))}]) AS ua),
    agents(k, name, pattern, category, networks) AS (VALUES {_rules_sql(agents.AGENTS)}), libraries(k, name, pattern, category, networks) AS (VALUES {_rules_sql(agents.LIBRARIES)}),
    a AS (SELECT u.k, arg_min(name, r.k) AS a_name, arg_min(category, r.k) AS a_category, arg_min(networks, r.k) AS a_networks FROM u JOIN agents r ON regexp_matches(ua, pattern) GROUP BY u.k),
    l AS (SELECT u.k, arg_min(name, r.k) AS l_name, arg_min(category, r.k) AS l_category FROM u JOIN libraries r ON regexp_matches(ua, pattern) GROUP BY u.k),
    r AS (SELECT event_id, ts, coalesce(ua, '') AS ua, event_id % 11 = 0 AS mute, event_id % 13 = 0 AS scripted, [{', '.join(map(str, _NETWORKS))}][CAST(event_id // 7 % {len(_NETWORKS)} + 1 AS INT)] AS network, event_id % 3 = 0 AS has_org,
        event_id % 97 = 0 AS verified, CASE WHEN event_id % 89 = 0 THEN 'AI Crawler' WHEN event_id % 83 = 0 THEN 'Webhooks' ELSE '' END AS platform_category, event_id % 5 > 0 AS page, event_id % 17 = 0 AS webdriver,
        a.* EXCLUDE (k), l.* EXCLUDE (k) FROM events JOIN u ON u.k = event_id % {len(SAMPLES)} LEFT JOIN a ON a.k = u.k LEFT JOIN l ON l.k = u.k),
    t AS (SELECT *, CASE WHEN verified OR platform_category <> '' THEN 'verified' WHEN a_name IS NOT NULL THEN CASE WHEN network <> 0 AND list_contains(a_networks, network) THEN 'verified-network' ELSE 'declared' END
        WHEN trim(ua) = '' THEN 'empty-agent' WHEN l_name IS NOT NULL THEN l_category WHEN regexp_matches(regexp_replace(ua, '(?i)cubot', '', 'g'), '{agents.GENERIC}') THEN 'agent' WHEN webdriver THEN 'webdriver'
        WHEN NOT starts_with(ua, 'Mozilla/5.0 (') THEN 'no-browser' WHEN page AND mute THEN 'no-accept-language'
        WHEN page AND scripted AND (coalesce(TRY_CAST(regexp_extract(ua, 'Chrome/(\\d+)', 1) AS INT), 0) >= 80 OR coalesce(TRY_CAST(regexp_extract(ua, 'Firefox/(\\d+)', 1) AS INT), 0) >= 90) THEN 'no-fetch-metadata'
        WHEN network IN ({', '.join(map(str, agents.HOSTING))}) THEN 'datacenter' ELSE 'candidate' END AS step FROM r),
    told AS (SELECT event_id, ts, page, CASE WHEN step LIKE 'verified%' THEN 'verified' WHEN step IN ('declared', 'agent') THEN 'declared' WHEN step = 'candidate' THEN step ELSE 'suspected' END AS cls,
        CASE step WHEN 'verified' THEN coalesce(a_name, CASE WHEN platform_category = '' THEN 'Verified bot' ELSE platform_category END) WHEN 'verified-network' THEN a_name WHEN 'declared' THEN a_name WHEN 'empty-agent' THEN 'No user agent'
            WHEN 'headless' THEN l_name WHEN 'library' THEN l_name WHEN 'agent' THEN coalesce(nullif(regexp_extract(ua, '(?i)([A-Za-z][\\w.-]{{1,40}}?(?:bot|crawler|spider))\\b', 1), ''), nullif(regexp_extract(ua, '([A-Za-z][\\w.-]{{1,40}})/', 1), ''), 'Unknown bot')
            WHEN 'webdriver' THEN 'WebDriver' WHEN 'no-browser' THEN coalesce(nullif(trim(regexp_extract(ua, '^([A-Za-z][\\w .-]{{0,39}}?)(?:/|\\s|$)', 1)), ''), 'Non-browser client')
            WHEN 'no-accept-language' THEN 'Browser without Accept-Language' WHEN 'no-fetch-metadata' THEN 'Browser without Fetch Metadata'
            WHEN 'datacenter' THEN 'Datacenter · ' || CASE WHEN has_org THEN left('A hosting company with a name of more than forty characters', 40) ELSE 'AS' || network END ELSE '' END AS name,
        CASE step WHEN 'verified' THEN coalesce(a_category, {_OURS}) WHEN 'verified-network' THEN a_category WHEN 'declared' THEN a_category WHEN 'candidate' THEN ''
            WHEN 'agent' THEN 'other' WHEN 'no-accept-language' THEN 'other' WHEN 'no-fetch-metadata' THEN 'other' WHEN 'datacenter' THEN 'other' ELSE 'library' END AS category,
        CASE step WHEN 'verified' THEN 'platform' WHEN 'verified-network' THEN 'network' WHEN 'declared' THEN 'agent' WHEN 'candidate' THEN '' ELSE step END AS reason,
        CASE WHEN step = 'candidate' THEN {_DEVICE} ELSE 'bot' END AS device, CASE WHEN step = 'candidate' THEN {_BROWSER} ELSE 'bot' END AS browser FROM t)"""


@query(f"WITH {_REQUESTS} SELECT event_id, cls, name, category, reason FROM told")
def request_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who sent each request, by the ordered rules."""
    return traffic.classify(_requests(spark, sf_dir)).select("event_id", "cls", "name", "category", "reason")


@query(f"WITH {_REQUESTS} SELECT device, browser, count(*) AS n FROM told GROUP BY ALL")
def device_browsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by device and browser family."""
    return traffic.classify(_requests(spark, sf_dir)).groupBy("device", "browser").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_REQUESTS} SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN page THEN 'page' ELSE 'beacon' END AS kind, cls, category, left(name, 96) AS name, count(*) AS n, CAST(count(*) AS DOUBLE) AS weight FROM told GROUP BY ALL"""
)
def logged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the traffic log, counted by day and class."""
    rows = traffic.points(traffic.classify(_requests(spark, sf_dir)))
    return rows.groupBy(F.col("day").cast("string").alias("day"), "kind", "cls", "category", "name").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(
    """SELECT event_id, event_type AS event, CASE WHEN event_id % 4 < 2 THEN ['mobile', 'desktop'][CAST(event_id % 4 + 1 AS INT)] END AS device_class, CASE WHEN event_id % 3 = 0 THEN 'image' END AS file_kind,
        CAST(greatest(0, least(100, CAST(value AS INT) * 3 - 20)) AS VARCHAR) AS count, CAST(2 + (event_id % 4 < 2)::INT + (event_id % 3 = 0)::INT AS INTEGER) AS kept FROM events WHERE event_type IN ('view', 'click', 'purchase')"""
)
def event_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be logged of each event: listed names, dimensions and values; counts are clamped."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    count = (F.rint("value").cast("int") * 3 - 20).cast("string")
    sent = F.create_map(F.lit("device_class"), pick(("mobile", "desktop", "fridge", "mob"), 4), F.lit("file_kind"), pick(("image", "exe", "/home/me/secret.png"), 3), F.lit("path"), F.lit("/private"), F.lit("count"), count)
    ok = traffic.allowed_event(F.col("event_type"), sent, ("view", "click", "purchase"), {"device_class": ("mobile", "desktop"), "file_kind": ("image", "pdf", "media", "mixed"), "plan": ("free", "pro")})
    rows = table(spark, sf_dir, "events").select("event_id", ok.alias("m")).filter("m IS NOT NULL")
    return rows.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("event", "device_class", "file_kind", "count")], F.size("m").alias("kept"))
