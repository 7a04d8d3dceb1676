"""What boards and article lists ask: intents, evidence, content to publish, merged lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say what a search is after.
INTENTS = {
    "status": "장애 다운 먹통 접속 안됨 안돼 오류 에러 상태 서버 outage down status".split(),
    "price": "가격 요금 요금제 구독료 구독 비용 price pricing plan plans cost".split(),
    "local": "로컬 로컬llm 로컬ai vram local llm".split(),
}


def search_intent(text: Column, intents: dict[str, list[str]] = INTENTS) -> tuple[Column, Column]:
    """(intent, rest): the intent of the first word that has one, and the other words joined by spaces.

    Without other words there is no intent. A null text has neither.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    known = F.create_map(*[F.lit(v) for name, of in intents.items() for w in of for v in (w, name)])
    marks = F.transform(words, lambda w: F.element_at(known, F.lower(w)))
    first = F.array_position(F.transform(marks, lambda m: m.isNotNull()), F.lit(True))
    rest = F.filter(words, lambda w, i: i + 1 != first)
    some = (first > 0) & (F.size(rest) > 0)
    return F.when(some, F.element_at(marks, F.greatest(first, F.lit(1)).cast("int"))), F.array_join(rest, " ")


def evidence_confidence(evidence: DataFrame, key: str, checked_ms: str, rank: str, now_ms: int, stale_days: int = 180) -> DataFrame:
    """(key, n, age_days, stale, confidence): the oldest check tells the age, the best source the rank.

    Checks after ``now_ms`` and those without a rank don't count. Nothing valid, an old check or a rank below 4 is LOW, a rank of 6 or more HIGH.
    """
    valid = (F.col(checked_ms) <= now_ms) & F.col(rank).isNotNull()
    found = evidence.groupBy(key).agg(
        F.count_if(valid).alias("n"), F.floor((now_ms - F.min(F.when(valid, F.col(checked_ms)))) / 86_400_000).alias("age_days"), F.max(F.when(valid, F.col(rank))).alias("best")
    )
    stale = F.coalesce(F.col("age_days") > stale_days, F.lit(True))
    grade = F.when(stale | (F.coalesce("best", F.lit(0)) < 4), "LOW").when(F.col("best") >= 6, "HIGH").otherwise("MEDIUM")
    return found.select(key, "n", "age_days", stale.alias("stale"), grade.alias("confidence"))


def next_content(pages: DataFrame, cluster: str, priority: str, route: str, recent: DataFrame) -> DataFrame:
    """``pages`` with their place in the order to publish: clusters that are not among ``recent`` first, then by priority and route."""
    used = recent.select(cluster).distinct().withColumn("_used", F.lit(1))
    return pages.join(used, cluster, "left").withColumn("penalty", F.coalesce("_used", F.lit(0))).drop("_used").orderBy("penalty", priority, route)


def merge_ordered(stored: Column, incoming: Column) -> Column:
    """The stored list, then what is new of the incoming one, each in its order; a null list is an empty one."""
    none = F.array().cast("array<string>")
    kept, new = F.coalesce(stored, none), F.coalesce(incoming, none)
    return F.concat(kept, F.array_except(new, kept))
