"""Text search and text statistics: trigram ranking, all-terms search, phrases, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_terms(text: Column, terms: list[str]) -> Column:
    """Whether a text holds every term, letter case aside."""
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t.lower())) for t in terms], F.lit(True))


def trigrams(text: Column) -> Column:
    """All trigrams of a lower-cased text, repeats included."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_bm25(docs: DataFrame, phrase: str, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id_col, score) of the documents that hold the phrase, by BM25 over the phrase's distinct trigrams.

    Only the phrase's trigrams are counted, by comparing, so no index of all trigrams is shuffled; lengths and document counts are one row.
    """
    low = F.lower(F.col(text_col))
    wanted = sorted({phrase.lower()[i : i + 3] for i in range(len(phrase) - 2)})
    size = F.greatest(F.length(low) - 2, F.lit(0))
    # overlapping matches count: a look-ahead at every place
    tf = [F.regexp_count(low, F.lit("(?=" + "".join(f"[{c}]" if c not in "^\\]" else "\\" + c for c in t) + ")")).alias(f"t{i}") for i, t in enumerate(wanted)]
    rows = docs.select(F.col(id_col), size.alias("size"), F.contains(low, F.lit(phrase.lower())).alias("hit"), *tf)
    total = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    both = rows.filter("hit").crossJoin(F.broadcast(total))  # one row
    part = lambda i: (
        F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    )
    return both.select(id_col, reduce(lambda x, y: x + y, map(part, range(len(wanted)))).alias("score"))


def weighted_bm25(docs: DataFrame, phrase: str, id_col: str, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``trigram_bm25`` over several columns: a trigram counts as often as it stands in each, times the column's weight; the phrase may stand in any."""
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in weights}
    wanted = sorted({phrase.lower()[i : i + 3] for i in range(len(phrase) - 2)})
    pattern = lambda t: F.lit("(?=" + "".join(f"[{c}]" if c not in "^\\]" else "\\" + c for c in t) + ")")
    size = sum((F.greatest(F.length(x) - 2, F.lit(0)) for x in low.values()), F.lit(0))
    tf = [sum((F.regexp_count(x, pattern(t)) * w for (c, x), w in zip(low.items(), weights.values())), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(wanted)]
    hit = reduce(lambda x, y: x | y, [F.contains(x, F.lit(phrase.lower())) for x in low.values()])
    rows = docs.select(F.col(id_col), size.alias("size"), hit.alias("hit"), *tf)
    total = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    both = rows.filter("hit").crossJoin(F.broadcast(total))  # one row
    idf = lambda i: F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return both.select(id_col, reduce(lambda x, y: x + y, map(part, range(len(wanted)))).alias("score"))


def trending(titles: DataFrame, id_col: str, text_col: str, pair_weight: float = 1.3, least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """(term, n, weight): words and pairs of words by the number of titles that hold them, each once a title, pairs weighted up."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~w.isin(*stop) if stop else (F.length(w) >= 2) & ~w.rlike(r"^\d+$"))
    rows = titles.select(id_col, words.alias("w"))
    pairs = F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get(F.col("w"), i), F.get(F.col("w"), i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = rows.select(id_col, F.explode(F.array_distinct(F.concat(F.col("w"), pairs))).alias("term"))
    weight = F.when(F.contains("term", F.lit(" ")), pair_weight).otherwise(1.0)
    return terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("weight", F.col("n") * weight)


def drop_nested(top: DataFrame, term: str = "term", weight: str = "weight", keep: int = 6) -> list[tuple[str, float]]:
    """The first terms by weight that neither contain nor are contained in one kept before; ``top`` must be a short list."""
    kept: list[tuple[str, float]] = []
    for t, w in [(r[term], r[weight]) for r in top.orderBy(F.desc(weight), term).limit(200).collect()]:
        if len(kept) < keep and not any(t in k or k in t for k, _ in kept):
            kept.append((t, w))
    return kept


def duplicates(docs: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(id_col, first, n) of rows that share a key with others: the least id and how many there are. Counted before it is joined back."""
    rows = docs.select(F.col(id_col), key.alias("_key"))
    groups = rows.groupBy("_key").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, "_key").select(id_col, "first", "n")


def runs_of(df: DataFrame, keys: list[str], order: list[str], change: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("run", F.sum(change.cast("int")).over(w))
