"""Sinks: tables, open data, feeds, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators.relational import blocked_places


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet; reading them back gives the same rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


#: Families of systems, the first whose pattern is found; settings that are short codes, and what such a code looks like.
SYSTEMS = (("(?i)windows", "windows"), ("(?i)mac|os x", "macos"), ("(?i)steam ?deck|steamos", "steamos"), ("(?i)linux|ubuntu|fedora|arch", "linux"), ("(?i)android", "android"), ("(?i)ios|iphone|ipad", "ios"))
CODES, CODE = ("runtime", "quant"), r"^[\w.\- ]{1,24}$"


def safe_env(env: Column) -> Column:
    """Of a setup in JSON, what names nobody: short codes of ``CODES`` and the family of its system; free text is left out. What is no JSON object gives an empty map."""
    by = F.try_variant_get(F.try_parse_json(env), "$", "map<string, variant>")
    text = lambda k: F.when(F.schema_of_variant(F.try_element_at(by, F.lit(k))) == "STRING", F.try_element_at(by, F.lit(k)).cast("string"))
    family = F.coalesce(*[F.when(text("os").rlike(p), F.lit(name)) for p, name in SYSTEMS])
    found = [F.struct(F.lit(k).alias("key"), F.when(text(k).rlike(CODE), text(k)).alias("value")) for k in CODES] + [F.struct(F.lit("os").alias("key"), family.alias("value"))]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))


def open_reports(reports: DataFrame, posts: DataFrame, most: int | None = 50_000) -> tuple[DataFrame, DataFrame]:
    """Published public reports that may be given away, and their months: (month, subject, subject_version, target, target_version, env, result, day) and (month, reports, truncated).

    reports: id, kind, status, visibility, subject, subject_version, target, target_version, env (JSON), result, created_at (ms); posts: report, status: a report whose post is neither published nor locked stays
    in. Of a month the first ``most`` by time are given, all for None, and it is told whether there are more. Users and texts never leave.
    """
    hidden = posts.filter("coalesce(status, '') NOT IN ('published', 'locked')").select(F.col("report").alias("id")).distinct()
    at = F.timestamp_millis("created_at")
    rows = reports.filter("kind = 'compat' AND status = 'published' AND visibility = 'public'").join(hidden, "id", "left_anti").withColumns({"month": F.date_format(at, "yyyy-MM"), "day": F.date_format(at, "yyyy-MM-dd")})
    # numbered day by day, so that a busy month is no one task's
    placed = blocked_places(rows, ["month"], F.col("day"), [F.col("created_at"), F.col("id")])
    given = placed if most is None else placed.filter(F.col("place") <= most)
    top = F.lit(most).cast("bigint")
    months = placed.groupBy("month").agg(F.count("*").alias("n")).select("month", F.least("n", top).alias("reports"), F.coalesce(F.col("n") > top, F.lit(False)).alias("truncated"))
    return given.select("month", "subject", "subject_version", "target", "target_version", safe_env(F.col("env")).alias("env"), "result", "day"), months


def open_data(reports: DataFrame, posts: DataFrame, folder: str, most: int | None = 50_000) -> None:
    """``open_reports`` as JSON lines by month below ``folder``/reports, and its months below ``folder``/months."""
    given, months = open_reports(reports, posts, most)
    given.write.mode("overwrite").partitionBy("month").json(f"{folder}/reports")
    months.write.mode("overwrite").json(f"{folder}/months")


def feed(items: DataFrame, at: str, title: str, url: str, most: int = 40) -> DataFrame:
    """(xml) of the newest items, in one row."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), esc(title), F.lit("</title><link>"), esc(url), F.lit("</link></item>"))
    newest = items.orderBy(F.desc(at), url).limit(most).select(F.struct(F.col(at).alias("at"), item.alias("item")).alias("s"))
    ordered = F.reverse(F.array_sort(F.collect_list("s")))
    return newest.agg(F.concat(F.lit("<rss version=\"2.0\"><channel>"), F.array_join(F.transform(ordered, lambda s: s["item"]), ""), F.lit("</channel></rss>")).alias("xml"))


def sitemap(pages: DataFrame, path: str, locale: str, indexable: str, most: int = 20_000) -> DataFrame:
    """(path, alternates map) of the pages that may be indexed, by path."""
    kept = pages.filter(indexable).groupBy(path).agg(F.sort_array(F.collect_list(F.struct(F.col(locale).alias("key"), F.concat(F.lit("/"), locale, path).alias("value")))).alias("a"))
    return kept.select(path, F.map_from_entries("a").alias("alternates")).orderBy(path).limit(most)
