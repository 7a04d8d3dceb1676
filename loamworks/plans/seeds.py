"""Source documents checked by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.operators import seeds
from loamworks.plans.registry import query
from loamworks.session import table

#: Parts in a document.
_SIZE = 400
_TIERS = ["free", "paid"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of so many parts each, with faults in some of them."""
    k = F.col("p_partkey")
    text = lambda *pieces: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])
    id = F.when(k % 37 == 0, text("App:", k)).otherwise(text("app:p", k))
    fact = lambda p, v: text('{"p":"', p, '","v":', v, ',"ver":"', F.when(k % 11 == 0, "SURE").otherwise("OFFICIAL"), '","src":"src:s', k % 5, '"}')
    size = F.when(k % 7 == 0, text('"', F.col("p_size"), '"')).otherwise(F.col("p_size").cast("string"))
    tier = F.element_at(F.array(*map(F.lit, [*_TIERS, "gold"])), (k % 3 + 1).cast("int"))
    entity = text(
        '{"id":"', id, '","type":"', F.when(k % 41 == 0, "plan").otherwise("app"), '","slug":"', F.when(k % 53 == 0, text("P ", k)).otherwise(text("p-", k)), '","names":', F.when(k % 29 == 0, "{}").otherwise('{"en":"x"}'), ',"facts":[',
        fact("size", size), ",", fact("tier", text('"', tier, '"')), '],"relations":[{"p":"', F.when(k % 31 == 0, "likes").otherwise("part_of"), '","o":"app:p', k + 1, '"}]}',
    )
    sources = ",".join(f'{{"id":"src:s{i}","kind":"OFFICIAL","url":"https://x.test/{i}","retrieved":"2026-01-02"}}' for i in range(4))
    listed = table(spark, sf_dir, "part").select(F.floor(k / _SIZE).alias("document"), F.struct(k.alias("k"), entity.alias("e")).alias("s")).groupBy("document").agg(F.sort_array(F.collect_list("s"))["e"].alias("e"))
    return listed.select("document", text('{"schema":"seed/1","vertical":"ai","sources":[', sources, '],"entities":[', F.array_join("e", ","), "]}").alias("body"))


def _sql() -> str:
    fact = lambda name: f"'entity ' || id || ' fact {name}: '"
    rows = [
        (0, 0, 0, "'entity ' || id || ': id invalid'", "k % 37 = 0"), (0, 0, 1, "'entity ' || id || ': type must be the id''s prefix'", "(k % 37 = 0) <> (k % 41 = 0) OR k % 37 = 0"), (0, 0, 2, "'entity ' || id || ': type not defined for the vertical'", "k % 41 = 0"),
        (0, 0, 3, "'entity ' || id || ': slug invalid'", "k % 53 = 0"), (0, 0, 4, "'entity ' || id || ': names.en required'", "k % 29 = 0"), (4, 0, 0, fact("size") + " || 'number expected'", "k % 7 = 0"),
        (4, 1, 0, fact("tier") + " || 'not one of the property''s values'", "k % 3 = 2"), *((4, j, 1, fact(p) + " || 'ver not known'", "k % 11 = 0") for j, p in enumerate(("size", "tier"))),
        *((4, j, 2, fact(p) + " || 'unknown source src:s4'", "k % 5 = 4") for j, p in enumerate(("size", "tier"))), (5, 0, 0, "'entity ' || id || ' relation likes: predicate not known'", "k % 31 = 0"),
        (5, 0, 1, "'entity ' || id || ' relation ' || CASE WHEN k % 31 = 0 THEN 'likes' ELSE 'part_of' END || ': unknown entity app:p' || (k + 1)", "(k + 1) % 37 = 0 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.k + 1)"),
    ]
    union = " UNION ALL ".join(f"SELECT document, k, {s} AS s, {j} AS j, {r} AS r, {error} AS error FROM p WHERE {test}" for s, j, r, error, test in rows)
    return f"""WITH p AS (SELECT p_partkey // {_SIZE} AS document, p_partkey AS k, CASE WHEN p_partkey % 37 = 0 THEN 'App:' || p_partkey ELSE 'app:p' || p_partkey END AS id FROM part), e AS ({union})
    SELECT document, n, error FROM (SELECT document, row_number() OVER (PARTITION BY document ORDER BY k, s, j, r) AS n, error FROM e) WHERE n <= 200"""


@query(_sql())
def seed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each document, in order, up to 200 errors."""
    types = spark.createDataFrame([("ai", "app")], "vertical string, type string")
    properties = spark.createDataFrame([("ai", "size", "number", None, None), ("ai", "tier", "enum", None, _TIERS)], "vertical string, property string, type string, unit string, values array<string>")
    return seeds.errors(_documents(spark, sf_dir), types, properties, "seed/1")
