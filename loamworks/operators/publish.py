"""What follows an ingest: settled conflicts, change rows, search rows, recomputed verdicts, votes, payments, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settle_conflicts(queue: DataFrame, replaced: DataFrame, now_ms: int) -> DataFrame:
    """The queue after facts changed: open conflicts of a replaced fact are accepted if they asked for its new value, else rejected; others stay.

    queue: fact_id, value, status, resolved_by, resolved_at, more; replaced: (fact_id, value), a row a fact.
    """
    new = replaced.select("fact_id", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    rows = queue.join(new, "fact_id", "left")
    due = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "open")
    verdict = F.when(F.col("value").eqNullSafe(F.col("_new")), "accepted").otherwise("rejected")
    told = {"status": verdict, "resolved_by": F.lit("system:ingest"), "resolved_at": F.lit(now_ms).cast("bigint")}
    return rows.select(*[F.when(due, told[c]).otherwise(F.col(c)).alias(c) if c in told else F.col(c) for c in queue.columns])


def change_rows(changes: DataFrame, sources: DataFrame, mode: str, position: str = "position") -> DataFrame:
    """One row a distinct change, its first (of equal positions the least source; rows without one come last), with where it came from: collector if its source has an adapter, else the ingest's mode.

    changes: entity_id, kind, property, scope, old_value, new_value, ref_id, source_id, position, more; sources: (source_id, adapter).
    """
    key = [F.coalesce("scope", F.lit("{}")), *map(F.col, ("entity_id", "kind", "property", "old_value", "new_value", "ref_id"))]
    first = changes.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last(position), "source_id"))).filter("_k = 1").drop("_k")
    backed = sources.filter("adapter IS NOT NULL").select("source_id", F.lit("collector").alias("_origin")).distinct()
    return first.join(backed, "source_id", "left").withColumn("origin", F.coalesce("_origin", F.lit(mode))).drop("_origin")


def search_rows(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_key, kind, locale, title, body): a row for each locale that an active entity has a name in, en without any.

    entities: id, type, status, names and descriptions (maps by locale); aliases: (entity_id, alias, position). The body is the distinct aliases
    in order, joined by " · ", a space, and the description, English where the locale has none.
    """
    order = F.struct(F.col("position"), F.col("alias"))
    known = aliases.groupBy("entity_id", "alias").agg(F.min("position").alias("position")).groupBy("entity_id").agg(F.array_sort(F.collect_list(order)).alias("_a"))
    rows = entities.filter("status = 'active'").join(known, F.col("id") == F.col("entity_id"), "left")
    locales = F.when(F.size("names") > 0, F.map_keys("names")).otherwise(F.array(F.lit("en")))
    rows = rows.withColumn("locale", F.explode(locales))
    of = lambda m: F.coalesce(F.try_element_at(m, F.col("locale")), F.try_element_at(m, F.lit("en")))
    listed = F.coalesce(F.array_join(F.transform("_a", lambda x: x["alias"]), " · "), F.lit(""))
    return rows.select(F.concat(F.lit("entity:"), "id").alias("doc_key"), F.col("type").alias("kind"), "locale", of(F.col("names")).alias("title"), F.concat(listed, F.lit(" "), F.coalesce(of(F.col("descriptions")), F.lit(""))).alias("body"))


def recompute(verdicts: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """What becomes of each key's community verdict: (keys, action, status, verification).

    verdicts: keys, status (unknown without reports), verification; current: keys, status, verification, votes. Official rows are never touched. A key whose reports
    are all gone is closed if reports had built it (votes > 0, not automated). The same verdict refreshes its counts, another opens a new row.
    """
    now = current.select(*keys, F.col("status").alias("_status"), F.col("verification").alias("_ver"), F.col("votes").alias("_votes"))
    rows = verdicts.join(now, keys, "full")
    status = F.coalesce("status", F.lit("unknown"))
    built = F.col("_ver").isNotNull() & (F.col("_ver") != "AUTOMATED") & (F.col("_votes") > 0)
    action = (
        F.when(F.col("_ver") == "OFFICIAL", "keep").when((status == "unknown") & built, "close").when(status == "unknown", "keep")
        .when((F.col("status") == F.col("_status")) & (F.col("verification") == F.col("_ver")), "refresh").when(F.col("_ver").isNull(), "open").otherwise("replace")
    )
    takes = F.col("action").isin("open", "replace", "refresh")
    out = rows.withColumn("action", action)
    return out.select(*keys, "action", F.when(takes, F.col("status")).otherwise(F.col("_status")).alias("status"), F.when(takes, F.col("verification")).otherwise(F.col("_ver")).alias("verification"))


def vote_counts(log: DataFrame, best: int) -> DataFrame:
    """(target, up, down, best_at) from a log of casts and undone votes (target, voter, at, tie, value 1, -1 or 0): the last of each voter counts.

    best_at: when the ``best``-th up-vote that still stands was cast; null with fewer.
    """
    last = log.groupBy("target", "voter").agg(F.max_by(F.struct("at", "value"), F.struct("at", "tie")).alias("v")).select("target", "v.*")
    ups = last.filter("value = 1").withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("at")))
    reached = ups.filter(F.col("_n") == best).select("target", F.col("at").alias("best_at"))
    sums = last.groupBy("target").agg(F.count_if(F.col("value") == 1).alias("up"), F.count_if(F.col("value") == -1).alias("down"))
    return sums.join(reached, "target", "left")


def webhook_states(events: DataFrame, known: Column) -> DataFrame:
    """Each delivered event as processed, ignored or stale: id, subject, at, kind, tie.

    Only the first delivery of an id counts. Events of kinds that nothing handles are ignored; an event older than one of its subject that was
    processed before it is stale and changes nothing.
    """
    first = events.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("tie"))).filter("_k = 1").drop("_k")
    before = Window.partitionBy("subject").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(known, F.col("at"))).over(before)
    return first.withColumn("state", F.when(~known, "ignored").when(F.coalesce(newest > F.col("at"), F.lit(False)), "stale").otherwise("processed"))


def retained(rows: DataFrame, at: str, now: Column, horizons: dict[str, int], kind: str, hide: list[str], hide_after: int) -> DataFrame:
    """Rows no older in milliseconds than their kind's horizon (kinds without one stay), with columns that tell of people emptied after ``hide_after``."""
    age = now - F.col(at)
    limit = F.lit(None).cast("bigint")
    for name, most in horizons.items():
        limit = F.when(F.col(kind) == name, most).otherwise(limit)
    return rows.filter(F.coalesce(age <= limit, F.lit(True))).withColumns({c: F.when(age <= hide_after, F.col(c)) for c in hide})


def claims(attempts: DataFrame, key: str, at: str, tie: str, lock_ms: int) -> DataFrame:
    """Adds ``claimed``: whether an attempt takes the lock of its key, which holds for ``lock_ms`` from the claim on, whoever tries meanwhile.

    A claim's end depends on the claim before, so each key's attempts are folded in order; keys with many attempts are split where a gap of
    ``lock_ms`` or more starts afresh, as nothing before it matters.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    fresh = F.col(at) - F.lag(at).over(order) >= lock_ms
    runs = attempts.withColumn("_run", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(order))
    grouped = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")))).alias("_all"))
    start = F.struct(F.lit(None).cast("bigint").alias("held"), F.array().cast(f"array<struct<tie:{attempts.schema[tie].dataType.simpleString()},claimed:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = acc["held"].isNull() | (x["at"] - acc["held"] >= lock_ms)
        return F.struct(F.when(free, x["at"]).otherwise(acc["held"]).alias("held"), F.concat(acc["out"], F.array(F.struct(x["tie"].alias("tie"), free.alias("claimed")))).alias("out"))

    told = grouped.select(key, F.explode(F.aggregate("_all", start, step)["out"]).alias("_o"))
    return attempts.join(told.select(key, F.col("_o.tie").alias(tie), F.col("_o.claimed").alias("claimed")), [key, tie])
