"""Classification of requests by ordered rules, device and browser families, normalised paths, and the rows of the traffic log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions import agents
from loamworks.operators.graph import first_match

_STRUCT = "struct<cls:string,name:string,category:string,reason:string,device:string,browser:string>"
#: Columns of a logged point, in their order: dimensions, then the weight.
POINT = ("kind", "cls", "name", "category", "path", "ref", "device", "browser", "locale", "country", "reason", "route", "env", "entry")


def _cases(tests: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*tests[0])
    for test, value in tests[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def _any(rules: list[tuple]) -> str:
    """One pattern for a list of them, so that an agent on no list costs one test instead of one a rule."""
    return "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for _, p, *_ in rules)


def _known(ua: Column, rules: list[tuple]) -> Column:
    """struct(name, category, networks) of the first rule that matches, or null."""
    say = lambda r: F.struct(F.lit(r[0]).alias("name"), F.lit(r[2]).alias("category"), F.array(*map(F.lit, r[3])).cast("array<bigint>").alias("networks"))
    none = F.lit(None).cast("struct<name:string,category:string,networks:array<bigint>>")
    return F.when(ua.rlike(_any(rules)), _cases([(ua.rlike(r[1]), say(r)) for r in rules], none))


def _or_else(c: Column, other: Column) -> Column:
    return F.when(c != "", c).otherwise(other)


def _told_by_agents(texts: DataFrame, known: list[tuple], libraries: list[tuple]) -> DataFrame:
    """(_ua, _of) of agent texts: the listed agent and library, the names of bots and clients, device and browser family, and what sort of text it is."""
    ua = F.col("_ua")
    own_name = F.regexp_extract(ua, r"(?i)([A-Za-z][\w.-]{1,40}?(?:bot|crawler|spider))\b", 1)
    version = lambda b: F.coalesce(F.regexp_extract(ua, rf"{b}/(\d+)", 1).try_cast("int"), F.lit(0))
    found = {
        "agent": _known(ua, known), "library": _known(ua, libraries), "device": device(ua), "browser": browser(ua), "mozilla": ua.rlike(r"^Mozilla/5\.0 \("), "modern": (version("Chrome") >= 80) | (version("Firefox") >= 90),
        "bot": F.regexp_replace(ua, "(?i)cubot", "").rlike(agents.GENERIC),  # a brand of phones, not a bot
        "generic": _or_else(own_name, _or_else(F.regexp_extract(ua, r"([A-Za-z][\w.-]{1,40})/", 1), F.lit("Unknown bot"))),
        "client": _or_else(F.trim(F.regexp_extract(ua, r"^([A-Za-z][\w .-]{0,39}?)(?:/|\s|$)", 1)), F.lit("Non-browser client")),
    }
    return texts.select("_ua", F.struct(*[c.alias(n) for n, c in found.items()]).alias("_of"))


def classify(requests: DataFrame, known: list[tuple] = agents.AGENTS, libraries: list[tuple] = agents.LIBRARIES, hosting: tuple[int, ...] = agents.HOSTING) -> DataFrame:
    """Adds cls, name, category, reason, device and browser to requests with ua, accept_language, sec_fetch_mode, network, organization, verified, platform_category, kind, webdriver.

    verified: a listed agent confirmed by the platform or its operator's own network. declared: a name that nothing confirms. suspected: automation
    without a name, by library, missing or odd agent text, script control, missing headers of a page request, or a hosting network. candidate: the
    rest, who look like people; only they have a device and browser. Null texts are empty, null flags false. Agent texts count up to 512 characters.

    What a text tells is worked out once for each distinct text, as there are far more requests than texts, and joined to the requests.
    """
    rows = requests.withColumn("_ua", F.left(F.coalesce("ua", F.lit("")), F.lit(512)))
    rows = rows.join(_told_by_agents(rows.select("_ua").distinct(), known, libraries), "_ua")
    ua, agent, library, told = F.col("_ua"), F.col("_of.agent"), F.col("_of.library"), F.col("_of")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    network, platform = F.coalesce("network", F.lit(0)).cast("bigint"), F.coalesce("platform_category", F.lit(""))
    text = lambda v: F.lit(v) if isinstance(v, str) else v

    def bot(cls: str | Column, name: str | Column, category: str | Column, reason: str | Column) -> Column:
        return F.struct(text(cls), text(name), text(category), text(reason), F.lit("bot"), F.lit("bot")).cast(_STRUCT)

    confirmed = F.array_contains(agent["networks"], network) & (network != 0)
    ours = reduce(lambda out, kv: F.when(platform == kv[0], kv[1]).otherwise(out), agents.PLATFORM_CATEGORIES.items(), F.lit("other"))
    page = F.coalesce("kind", F.lit("page")) == "page"
    place = F.coalesce(F.left("organization", F.lit(40)), F.concat(F.lit("AS"), network.cast("string")))
    person = F.struct(F.lit("candidate"), F.lit(""), F.lit(""), F.lit(""), told["device"], told["browser"]).cast(_STRUCT)
    tests = [
        (flag("verified") | (platform != ""), bot("verified", F.coalesce(agent["name"], _or_else(platform, F.lit("Verified bot"))), F.coalesce(agent["category"], ours), "platform")),
        (agent.isNotNull(), bot(F.when(confirmed, "verified").otherwise("declared"), agent["name"], agent["category"], F.when(confirmed, "network").otherwise("agent"))),
        (F.trim(ua) == "", bot("suspected", "No user agent", "library", "empty-agent")),
        (library.isNotNull(), bot("suspected", library["name"], "library", library["category"])),
        (told["bot"], bot("declared", told["generic"], "other", "agent")),
        (flag("webdriver"), bot("suspected", "WebDriver", "library", "webdriver")),
        (~told["mozilla"], bot("suspected", told["client"], "library", "no-browser")),
        (page & empty("accept_language"), bot("suspected", "Browser without Accept-Language", "other", "no-accept-language")),
        (page & empty("sec_fetch_mode") & told["modern"], bot("suspected", "Browser without Fetch Metadata", "other", "no-fetch-metadata")),
        (network.isin(*hosting) if hosting else F.lit(False), bot("suspected", F.concat(F.lit("Datacenter · "), place), "other", "datacenter")),
    ]
    return rows.withColumn("_told", _cases(tests, person)).select(*requests.columns, "_told.*")


def device(ua: Column) -> Column:
    return first_match(ua, [(ua.rlike(r"(?i)iPad|Tablet|PlayBook|Silk/|Kindle|Android(?!.*Mobile)"), "tablet"), (ua.rlike("(?i)Mobi|iPhone|iPod|Android|Windows Phone"), "mobile")], "desktop")


def browser(ua: Column) -> Column:
    """The family alone."""
    return first_match(ua, [(ua.rlike(p), name) for name, p in agents.BROWSERS], "other")


def normal_path(url: Column, allowed: tuple[str, ...]) -> Column:
    """Path without a trailing slash or .html, digits as :n, and only the allowed query parameters, in the order given."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"\.html$|/+$", ""), r"/\d+", "/:n")
    found = [F.when(url.rlike(f"[?&]{k}=[^&#]+"), F.concat(F.lit(f"{k}="), F.regexp_extract(url, f"[?&]{k}=([^&#]+)", 1))) for k in allowed]
    query = F.concat_ws("&", *found)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def allowed_event(name: Column, values: Column, names: tuple[str, ...], dimensions: dict[str, tuple[str, ...]], most: int = 100) -> Column:
    """A map of what may be logged of an event: its name, the listed dimensions with a listed value, and a count clamped to 0..most; null for names not listed.

    values: a map of texts. Unknown keys and values are dropped.
    """
    kept = F.map_filter(values, lambda k, v: reduce(lambda a, b: a | b, [(k == d) & v.isin(*ok) for d, ok in dimensions.items()], F.lit(False)))
    count = F.try_element_at(values, F.lit("count")).try_cast("int")
    clamped = F.when(count.isNotNull(), F.create_map(F.lit("count"), F.greatest(F.lit(0), F.least(F.lit(most), count)).cast("string")))
    return F.when(name.isin(*names), F.map_concat(F.create_map(F.lit("event"), name), kept, F.coalesce(clamped, F.create_map().cast("map<string,string>"))))


def points(rows: DataFrame, dimensions: tuple[str, ...] = POINT) -> DataFrame:
    """Rows as logged points: day, ts, every dimension as a text of at most 96 characters (empty where null or missing), weight. Append them partitioned by day."""
    have = set(rows.columns)
    text = lambda c: (F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(96)) if c in have else F.lit("")).alias(c)
    return rows.select(F.to_date("ts").alias("day"), "ts", *map(text, dimensions), (F.coalesce("weight", F.lit(1.0)) if "weight" in have else F.lit(1.0)).alias("weight"))


def append_points(rows: DataFrame, path: str) -> None:
    """Appends points to a Parquet log, a folder a day; also fit for foreachBatch."""
    points(rows).write.mode("append").partitionBy("day").parquet(path)
