"""Documents of many kinds as rows: release lists, feeds, changelogs, rates, benchmark and market listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar, values

RELEASE = "array<struct<tag_name:string,name:string,draft:boolean,prerelease:boolean,published_at:string,html_url:string>>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    """The five references of XML."""
    for ref, char in _ENTITIES:
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def balanced(html: Column, opening: str, tag: Column | str) -> Column:
    """What stands between the first tag that matches ``opening`` and the end tag that closes it; null if there is none.

    Tags of the name count up and down from there, so an element ends at its own end tag, however many of its name it holds; empty ones (``<x/>``) count for nothing. ``opening`` must
    match whole tags of that name. Case doesn't count.
    """
    name = F.lit(tag) if isinstance(tag, str) else tag
    pattern = F.concat(F.lit(r"(?is)</?"), name, F.lit(r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"))
    change = lambda t: F.when(F.startswith(t, F.lit("</")), -1).when(F.endswith(t, F.lit("/>")), 0).otherwise(1)
    walk = lambda s, t: F.when(s["depth"] == 0, s).otherwise(F.named_struct(F.lit("depth"), s["depth"] + change(t), F.lit("n"), s["n"] + 1))

    def inside(cut: Column) -> Column:
        tags, pieces, end = cut["tags"], cut["pieces"], cut["end"]
        whole = F.array_join(F.zip_with(F.slice(pieces, 1, end["n"] - 1), F.slice(tags, 1, end["n"] - 1), lambda p, t: F.concat(p, t)), "")
        return F.when(end["depth"] == 0, F.concat(whole, F.get(pieces, end["n"] - 1)))

    def cut(rest: Column) -> Column:
        tags = F.regexp_extract_all(rest, pattern, 0)
        end = lambda found: F.aggregate(found, F.named_struct(F.lit("depth"), F.lit(1), F.lit("n"), F.lit(0)), walk)
        return _once(tags, lambda found: F.named_struct(F.lit("tags"), found, F.lit("pieces"), F.split(rest, pattern, -1), F.lit("end"), end(found)))

    # a document without the element costs one search
    start = F.regexp_extract(html, opening, 0)
    return F.when(F.length(start) > 0, _once(F.substring(html, F.regexp_instr(html, F.lit(opening)) + F.char_length(start), F.char_length(html)), lambda rest: _once(cut(rest), inside)))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f takes it."""
    return F.get(F.transform(F.array(value), f), 0)


def element(xml: Column, tag: str) -> Column:
    """Text of the first element of a name, up to its own end tag, character data unwrapped and references decoded; null if there is none.

    An element that holds none of its own name is found by one pattern that never goes back; only others' tags are counted.
    """
    name = rf"{tag}(?:\s(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*)?>"
    plain = rf"(?is)^(?:[^<]++|<(?!{name}))*+<{name}((?:[^<]++|<(?!/?{tag}[\s/>]))*+)</{tag}\s*>"
    raw = F.coalesce(F.nullif(F.regexp_extract(xml, plain, 1), F.lit("")), balanced(xml, rf"(?is)<{name}", tag))
    return F.nullif(F.trim(decode_entities(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))), F.lit(""))


def attribute(xml: Column, tag: str, name: str) -> Column:
    text = F.regexp_extract(xml, rf'<{tag}\b[^>]*\b{name}="([^"]*)"', 1)
    return decode_entities(F.nullif(text, F.lit("")))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of text files, each one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def snapshots(fetched: DataFrame, body: str = "body", most: int = 16_384) -> DataFrame:
    """Adds checksum, byte_size and excerpt of fetched bodies."""
    raw = F.col(body).cast("binary")
    return fetched.withColumns({"checksum": F.sha2(raw, 256), "byte_size": F.octet_length(body).cast("bigint"), "excerpt": F.left(F.col(body), F.lit(most))})


def releases(fetched: DataFrame, key: str, body: str = "body", keep: int = 5) -> DataFrame:
    """(key, tag, published, is_stable) of a JSON list of releases: drafts dropped, the newest ``keep``, and the newest stable one in any case."""
    rows = fetched.select(key, F.explode(F.from_json(body, RELEASE)).alias("r")).filter("NOT coalesce(r.draft, false) AND r.published_at IS NOT NULL")
    rows = rows.select(key, F.col("r.tag_name").alias("tag"), F.try_to_timestamp("r.published_at").alias("published"), (~F.coalesce("r.prerelease", F.lit(False))).alias("is_stable"))
    order = [F.desc_nulls_last("published"), F.desc("tag")]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    stable = F.row_number().over(Window.partitionBy(key, "is_stable").orderBy(*order))
    return rows.withColumn("_p", place).withColumn("_s", stable).filter((F.col("_p") <= keep) | (F.col("is_stable") & (F.col("_s") == 1))).drop("_p", "_s")


def keyed_releases(fetched: DataFrame, body: str = "body") -> DataFrame:
    """(branch, version, released) of an object whose keys are branches; rows without a dotted version or an ISO date are left out."""
    kind = "map<string,struct<type:string,driver_info:array<struct<release_version:string,release_date:string>>>>"
    rows = fetched.select(F.explode(F.from_json(body, kind)).alias("branch", "v")).select("branch", F.explode("v.driver_info").alias("d"))
    return rows.select("branch", F.col("d.release_version").alias("version"), F.try_to_date("d.release_date", "yyyy-MM-dd").alias("released")).filter(
        F.col("version").rlike(r"^\d+(\.\d+)+$") & F.col("released").isNotNull()
    )


def atom_entries(fetched: DataFrame, body: str = "body") -> DataFrame:
    """One row an entry: its other columns, id, title, url, published, content."""
    entry = F.explode(F.regexp_extract_all(body, F.lit(r"(?s)(<entry\b.*?</entry>)"), 1))
    rest = [c for c in fetched.columns if c != body]
    e = F.col("_e")
    stamp = F.try_to_timestamp(F.coalesce(element(e, "published"), element(e, "updated")))
    return fetched.select(*rest, entry.alias("_e")).select(*rest, element(e, "id").alias("id"), element(e, "title").alias("title"), attribute(e, "link", "href").alias("url"), stamp.alias("published"), element(e, "content").alias("content"))


def rss_items(fetched: DataFrame, body: str = "body") -> DataFrame:
    """One row an item: its other columns, title, url, published, description as text."""
    item = F.explode(F.regexp_extract_all(body, F.lit(r"(?s)(<item\b.*?</item>)"), 1))
    rest = [c for c in fetched.columns if c != body]
    i = F.col("_i")
    stamp = F.try_to_timestamp(F.regexp_replace(element(i, "pubDate"), r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return fetched.select(*rest, item.alias("_i")).select(*rest, element(i, "title").alias("title"), element(i, "link").alias("url"), stamp.alias("published"), scalar.strip_html(element(i, "description")).alias("text"))


def changelog_sections(fetched: DataFrame, body: str = "body", level: int = 3) -> DataFrame:
    """One row a dated section of a Markdown changelog: its other columns, place, released, lines."""
    rest = [c for c in fetched.columns if c != body]
    parts = fetched.select(*rest, F.posexplode(F.split(body, rf"(?m)^#{{{level}}}\s+", -1)).alias("place", "_part")).filter("place > 0")
    heading, lines = F.trim(F.substring_index("_part", "\n", 1)), F.filter(F.split("_part", "\n"), lambda x: x.rlike(r"^\s*[-*]\s+"))
    released = F.coalesce(F.try_to_date(heading, "MMMM d, yyyy"), F.try_to_date(heading, "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(heading, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))
    return parts.select(*rest, "place", released.alias("released"), F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s+", ""))).alias("lines")).filter("released IS NOT NULL")


def heading_versions(fetched: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, version, released) of lines like ``v7.12 - March 3 2025``."""
    rest = [c for c in fetched.columns if c != body]
    line = F.explode(F.split(body, "\n"))
    rows = fetched.select(*rest, line.alias("_l")).filter(F.col("_l").rlike(r"^v\d+(\.\d+)*\s+-\s+"))
    return rows.select(*rest, F.regexp_extract("_l", r"^v(\d+(?:\.\d+)*)", 1).alias("version"), F.try_to_date(F.trim(F.regexp_extract("_l", r"-\s+(.*)$", 1)), "MMMM d yyyy").alias("released"))


def cross_rate(fetched: DataFrame, base: str, quote: str, body: str = "body") -> DataFrame:
    """quote per base from a list of rates against a third currency; null if either is missing."""
    rate = lambda c: F.regexp_extract(body, rf"currency=['\"]{c}['\"]\s+rate=['\"]([0-9.]+)['\"]", 1).try_cast("double")
    return fetched.select(*[c for c in fetched.columns if c != body], F.try_divide(rate(quote), rate(base)).alias("rate"))


def benchmark_scores(rows: DataFrame, scenes: tuple[str, ...], version: str, least: int = 3) -> DataFrame:
    """(name, backend, samples, median) of submissions: id, position, data array of runs with version, scene, score, device and sockets.

    A submission counts if it ran exactly the scenes, all on the version, one device and one socket, with a finite positive score; the first of an id counts.
    """
    runs = F.col("data")
    ok = (
        (F.size(runs) == len(scenes)) & (F.array_sort(F.transform(runs, lambda r: r["scene"])) == F.array(*map(F.lit, sorted(scenes)))) & F.forall(runs, lambda r: (r["version"] == version) & (r["sockets"] == 1))
        & (F.size(F.array_distinct(F.transform(runs, lambda r: F.struct(r["device"], r["backend"])))) == 1)
    )
    score = F.aggregate(runs, F.lit(0.0), lambda a, r: a + r["score"])
    good = rows.filter(F.coalesce(ok, F.lit(False))).withColumn("score", score).filter("score > 0 AND NOT isnan(score) AND score < double('Infinity')")
    first = good.groupBy("id").agg(F.min_by(F.struct(runs[0]["device"].alias("name"), runs[0]["backend"].alias("backend"), F.col("score").alias("score")), "position").alias("s")).select("s.*")
    return first.groupBy("name", "backend").agg(F.count("*").alias("samples"), F.round(F.median("score"), 3).alias("median")).filter(F.col("samples") >= least)


def seed_documents(spark: SparkSession, path: str) -> DataFrame:
    """All JSON seed documents below a folder, one row each."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)


_NEWS = "struct<appnews:struct<newsitems:array<struct<title:string,url:string,date:bigint,tags:array<string>>>>>"


def news_posts(fetched: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, title, url, posted, update, version, channel) of a JSON list of posts; those without a date are left out."""
    rows = fetched.select(key, F.explode(F.from_json(body, _NEWS)["appnews"]["newsitems"]).alias("n")).filter("n.date IS NOT NULL")
    kind = values.post_kind(F.coalesce("n.title", F.lit("")), F.coalesce(F.array_contains("n.tags", "patchnotes"), F.lit(False)))
    return rows.select(key, "n.title", "n.url", F.timestamp_seconds("n.date").alias("posted"), kind.alias("k")).select(key, "title", "url", "posted", "k.*")


def news_versions(fetched: DataFrame, key: str, body: str = "body", keep: int = 8) -> DataFrame:
    """(key, version, released, place): the ``keep`` newest stable versions of each feed, each with the day of the first post about it."""
    posts = news_posts(fetched, key, body).filter("update AND channel = 'stable' AND version IS NOT NULL")
    first = posts.groupBy(key, "version").agg(F.min("posted").alias("first")).select(key, "version", F.date_format("first", "yyyy-MM-dd").alias("released"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("released"), "version"))
    return first.withColumn("place", place.cast("bigint")).filter(F.col("place") <= keep)


_INCIDENTS = "struct<incidents:array<struct<id:string,name:string,status:string,impact:string,created_at:string,started_at:string,resolved_at:string,components:array<struct<name:string>>>>>"
_GROUPS = "struct<summary:struct<structure:struct<items:array<struct<group:struct<name:string,components:array<struct<name:string>>>,component:struct<name:string>>>>>>"


def component_groups(widgets: DataFrame, body: str = "body") -> DataFrame:
    """(component, name): the group of each component of a status page; a component on its own is its own group."""
    items = widgets.select(F.explode(F.from_json(body, _GROUPS)["summary"]["structure"]["items"]).alias("i"))
    listed = items.select(F.explode("i.group.components.name").alias("component"), F.col("i.group.name").alias("name"))
    alone = items.filter("i.group IS NULL AND i.component IS NOT NULL").select(F.col("i.component.name").alias("component"), F.col("i.component.name").alias("name"))
    return listed.unionByName(alone).distinct()


def feed_components(fetched: DataFrame, body: str = "body") -> DataFrame:
    """(incident, names) of a status feed: the list under "Affected components", without the states in brackets."""
    entry = atom_entries(fetched, body)
    html = F.when(F.instr("content", "Affected components") > 0, F.substring_index("content", "Affected components", -1)).otherwise("")
    names = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<li>(.*?)</li>"), 1), lambda x: F.trim(F.regexp_replace(scalar.strip_html(x), r"\s*\([^()]*\)\s*$", "")))
    return entry.select(F.regexp_extract(F.coalesce("url", "id"), r"/incidents/([A-Za-z0-9]+)", 1).alias("incident"), F.filter(names, lambda n: n != "").alias("names")).filter("incident <> ''")


def incident_events(incidents: DataFrame, components: DataFrame, groups: DataFrame, entities: dict[str, str], titles: list[tuple[str, str]], provider: str, body: str = "body") -> DataFrame:
    """(incident, title, starts, ends, status, entities) of three documents: incidents, components by incident from the feed, groups of components.

    components: (incident, names); groups: (component, name); entities: group to entity. Components come from the feed, else from the incident. An incident without any goes
    by patterns in its title; one that leads to no entity is the provider's. entities is sorted.
    """
    i = incidents.select(F.explode(F.from_json(body, _INCIDENTS)["incidents"]).alias("i")).select("i.*").withColumnRenamed("id", "incident")
    i = i.join(components, "incident", "left").withColumn("names", F.coalesce("names", F.filter("components.name", lambda n: n.isNotNull()), F.array().cast("array<string>")))
    known = F.create_map(*[F.lit(v) for kv in entities.items() for v in kv])
    by_group = i.select("incident", F.explode("names").alias("component")).join(groups, "component").select("incident", F.try_element_at(known, F.col("name")).alias("entity")).filter("entity IS NOT NULL")
    found = by_group.groupBy("incident").agg(F.sort_array(F.collect_set("entity")).alias("_e"))
    by_title = F.array_compact(F.array(*[F.when((F.size("names") == 0) & F.coalesce(F.col("name"), F.lit("")).rlike(p), F.lit(e)) for p, e in titles]))
    ids = F.sort_array(F.array_distinct(F.concat(F.coalesce("_e", F.array().cast("array<string>")), by_title)))
    ended = F.col("status").isin("resolved", "postmortem")
    return i.join(found, "incident", "left").select(
        "incident", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Incident")).alias("title"), F.try_to_timestamp(F.coalesce("started_at", "created_at")).alias("starts"), F.try_to_timestamp("resolved_at").alias("ends"),
        F.when(ended, "ended").otherwise("confirmed").alias("status"), F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(provider))).alias("entities"),
    )


def status_updates(entries: DataFrame, content: str = "content", published: str = "published") -> DataFrame:
    """Entries with ``updates``, an array of (at, status) in order of time, from lines such as ``<small>Sep <var> 3</var>, <var>04:05</var> UTC</small><br><strong>Resolved</strong>``.

    Their year is the entry's; a later month than the entry's is of the year before. Also starts (the first update, else published) and ends (the first that says so).
    """
    line = r"(?s)<small>\s*([A-Za-z]{3,9})\s*<var[^>]*>\s*(\d{1,2})\s*</var>,\s*<var[^>]*>\s*(\d\d):(\d\d)\s*</var>\s*UTC\s*</small>\s*<br\s*/?>\s*<strong>([^<]+)</strong>"
    groups = [F.regexp_extract_all(content, F.lit(line), k) for k in range(1, 6)]

    def update(x: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, values.MONTHS)), F.lower(F.left(x["0"], F.lit(3)))).cast("int")
        year = F.year(published) - F.when(month > F.month(published), 1).otherwise(0)
        text = F.format_string("%04d-%02d-%02d %s:%s:00", year, month, x["1"].cast("int"), x["2"], x["3"])
        return F.struct(F.when(month > 0, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("at"), F.trim(x["4"]).alias("status"))

    found = F.array_sort(F.filter(F.transform(F.arrays_zip(*groups), update), lambda u: u["at"].isNotNull()))
    out = entries.withColumn("updates", found)
    over = F.filter("updates", lambda u: u["status"].rlike("(?i)^(resolved|completed)$"))
    return out.withColumns({"starts": F.coalesce(F.try_element_at("updates", F.lit(1))["at"], F.col(published)), "ends": F.try_element_at(over, F.lit(1))["at"]})


_LISTINGS = "struct<itemSummaries:array<struct<itemId:string,title:string,itemWebUrl:string,price:struct<value:string,currency:string>,itemLocation:struct<country:string>,conditionId:string,buyingOptions:array<string>,shippingOptions:array<struct<shippingCost:struct<value:string,currency:string>>>>>>"


def market_listings(fetched: DataFrame, key: str, country: str, currency: str, wanted: str, hosts: tuple[str, ...], most: int = 50, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Listings of a marketplace's answers that are exactly the wanted part, and counts: (key, id, title, url, price, shipping) and (key, accepted, excluded).

    Of each answer the first ``most`` listings count, and of an id its first. Excluded are those with odd links, other currencies, countries or conditions, without a fixed price, or with titles of
    something else.
    """
    rows = fetched.select(key, F.posexplode(F.slice(F.from_json(body, _LISTINGS)["itemSummaries"], 1, most)).alias("pos", "i"))
    money = lambda c: F.when(c.rlike(r"^\d+(?:\.\d{1,2})?$") & (c.try_cast("double") > 0) & (c.try_cast("double") <= 1e9), c.try_cast("double"))
    i = lambda name: F.col(f"i.{name}")
    host = F.regexp_extract(i("itemWebUrl"), r"^https://([^/?#@:]+)/itm/", 1)
    ok = (
        (F.coalesce(i("title"), F.lit("")) != "") & (F.length(i("title")) <= 500) & i("itemId").isNotNull() & host.isin(*hosts) & (i("price.currency") == currency) & (i("itemLocation.country") == country)
        & (i("conditionId") == "3000") & F.array_contains(i("buyingOptions"), "FIXED_PRICE") & money(i("price.value")).isNotNull() & values.comparable_title(i("title"), wanted)
    )
    marked = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    first = F.row_number().over(Window.partitionBy(key, "ok", i("itemId")).orderBy("pos")) == 1
    marked = marked.withColumn("ok", F.col("ok") & first)
    cost = F.try_element_at(i("shippingOptions"), F.lit(1))["shippingCost"]
    shipping = F.when(cost["currency"] == currency, F.when(cost["value"] == "0.00", 0.0).otherwise(money(cost["value"])))
    listings = marked.filter("ok").select(key, i("itemId").alias("id"), i("title").alias("title"), i("itemWebUrl").alias("url"), money(i("price.value")).alias("price"), shipping.alias("shipping"))
    return listings, marked.groupBy(key).agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("excluded"))


_SCHEDULE = "struct<data:struct<Page:struct<media:array<struct<id:bigint,format:string,status:string,episodes:int,startDate:struct<year:int,month:int,day:int>,endDate:struct<year:int,month:int,day:int>,nextAiringEpisode:struct<episode:int,airingAt:bigint>>>>>>"
#: The calendar's states, as ours.
AIRING = {"RELEASING": "airing", "FINISHED": "finished", "NOT_YET_RELEASED": "upcoming", "HIATUS": "hiatus"}


def airing_schedule(fetched: DataFrame, body: str = "body", hours: int = 9) -> DataFrame:
    """(id, status, episodes, release, ended, airs_day, airs_at) of a calendar: dates of the precision given, broadcasts in the +9 hour calendar.

    A first episode's broadcast day is the release date; an end counts only for what is finished.
    """
    m = fetched.select(F.explode(F.from_json(body, _SCHEDULE)["data"]["Page"]["media"]).alias("m")).select("m.*")
    local = F.timestamp_seconds(F.col("nextAiringEpisode.airingAt") + hours * 3600)
    day = F.date_format(local, "yyyy-MM-dd")
    fuzzy = lambda c: values.fuzzy_date(F.col(f"{c}.year"), F.col(f"{c}.month"), F.col(f"{c}.day"))
    state = F.try_element_at(F.create_map(*[F.lit(v) for kv in AIRING.items() for v in kv]), F.col("status"))
    return m.select(
        "id", state.alias("status"), F.when(F.col("episodes") > 0, F.col("episodes")).alias("episodes"), F.coalesce(F.when(F.col("nextAiringEpisode.episode") == 1, day), fuzzy("startDate")).alias("release"),
        F.when(F.col("status") == "FINISHED", fuzzy("endDate")).alias("ended"), day.alias("airs_day"), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm"), F.lit("+09:00")).alias("airs_at"),
    )


_STORE = "map<string,struct<success:boolean,data:struct<name:string,steam_appid:bigint,supported_languages:string,developers:array<string>,publishers:array<string>,release_date:struct<coming_soon:boolean,date:string>,platforms:struct<windows:boolean,mac:boolean,linux:boolean>,genres:array<struct<description:string>>>>>"


def store_games(english: DataFrame, local: DataFrame, body: str = "body") -> DataFrame:
    """(app, name, local_name, upcoming, released, korean, languages, platforms, developers) of store answers in two languages, joined by app; failed answers are left out.

    The local name is null where the local store shows the English one.
    """
    read = lambda df: df.select(F.explode(F.from_json(body, _STORE)).alias("app", "v")).filter("v.success").select("app", "v.data.*")
    en, ko = read(english), read(local).select("app", F.trim("name").alias("_local"))
    name, languages = F.trim("name"), values.store_languages(F.col("supported_languages"))
    flags = F.array_compact(F.array(*[F.when(F.col(f"platforms.{k}"), F.lit(v)) for k, v in (("windows", "windows"), ("mac", "macos"), ("linux", "linux"))]))
    return en.join(ko, "app", "left").select(
        "app", name.alias("name"), F.when(scalar.search_norm(F.col("_local")) != scalar.search_norm(name), F.col("_local")).alias("local_name"), F.coalesce("release_date.coming_soon", F.lit(False)).alias("upcoming"),
        values.release_date(F.col("release_date.date")).alias("released"), values.language_support(languages, "korean").alias("korean"), F.size(languages).alias("languages"), flags.alias("platforms"), "developers",
    )


def run_outcomes(fetched: DataFrame, read, key: str, body: str = "body") -> DataFrame:
    """(key, rows, error): how many rows a reader gives for each body; a body that is null or not JSON is told as an error and stops nothing."""
    bad = F.when(F.col(body).isNull(), "empty").when(F.try_parse_json(body).isNull(), "not JSON")
    marked = fetched.withColumn("_error", bad)
    good = read(marked.filter("_error IS NULL").drop("_error")).groupBy(key).agg(F.count("*").alias("rows"))
    return marked.select(key, F.col("_error").alias("error")).join(good, key, "left").select(key, F.coalesce("rows", F.lit(0)).alias("rows"), "error")
