"""Versioned tables: ingest with a trust ladder, conflicts, history, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar

#: The key of a current fact.
SCOPE = ("entity_id", "property", "region", "language", "platform", "plan", "app_version")
#: Columns of a fact: its key, what it says, and where that comes from.
FACT = (*SCOPE, "value", "unit", "verification", "source_id", "created_by", "valid_from", "valid_until", "observed_at", "is_current")


def winners(rows: DataFrame, keys: list[str], position: str, last: bool = True) -> DataFrame:
    """One row a key of a document: the last by position (facts, availability, compatibility), or the first (relations, versions)."""
    order = F.desc(position) if last else F.asc(position)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_k = 1").drop("_k")


def decide(current: DataFrame, incoming: DataFrame, actor: str, now_ms: int) -> DataFrame:
    """What becomes of each incoming fact: its columns, those of the current fact as cur_*, and ``action``.

    current: FACT columns with is_current; incoming: SCOPE, value, unit, verification, source_id, valid_from (may be null), only_if_newer, position.
    Actions: confirm (same value; the label or the day of observation may move on), upgrade (same value, better label), keep, conflict,
    replace, add. Values must be canonical JSON. Null scope columns count as '*'.
    """
    keys = list(SCOPE)
    new = winners(incoming.withColumns({c: F.coalesce(F.col(c), F.lit("*")) for c in keys}), keys, "position")
    old = current.filter("is_current").select(*keys, *[F.col(c).alias(f"cur_{c}") for c in FACT if c not in SCOPE])
    both = new.join(old, keys, "left")
    has = F.col("cur_verification").isNotNull()
    same = has & F.col("value").eqNullSafe(F.col("cur_value")) & F.col("unit").eqNullSafe(F.col("cur_unit"))
    text = lambda c: F.regexp_replace(F.col(c), '^"|"$', "")  # noqa: E731  a version inside JSON
    order = scalar.version_compare(text("value"), text("cur_value"))
    version = F.col("property").isin(*scalar.VERSION_PROPERTIES)
    stale = F.col("only_if_newer") & version & F.coalesce(order <= 0, F.lit(True))
    beats = scalar.supersedes(F.col("property"), F.col("verification"), F.col("cur_verification"), text("value"), text("cur_value"))
    better = scalar.may_override(F.col("verification"), F.col("cur_verification")) & (F.col("verification") != F.col("cur_verification"))
    seed_keeps = F.lit(actor == "seed") & (F.col("cur_created_by") != "seed") & version & F.coalesce(order < 0, F.lit(False))
    action = (
        F.when(~has, "add").when(same & better, "upgrade").when(same, "confirm").when(stale | seed_keeps, "keep").when(~beats, "conflict").otherwise("replace")
    )
    return both.withColumn("action", action).withColumn("_now", F.lit(now_ms).cast("bigint"))


def apply(current: DataFrame, decided: DataFrame, actor: str) -> DataFrame:
    """The next state of the facts table: confirmed, upgraded and closed rows, and new current ones. Applying a document again changes nothing."""
    keys, seen = list(SCOPE), F.col("_now")
    plan = decided.select(*keys, "action", "_now", *[F.col(c).alias(f"new_{c}") for c in ("value", "unit", "verification", "source_id", "valid_from")])
    rows = current.join(plan.withColumn("is_current", F.lit(True)), [*keys, "is_current"], "left")
    act = F.col("action")
    moves = (act == "upgrade") | ((act == "confirm") & F.lit(actor != "seed") & scalar.new_day(F.col("observed_at"), seen))
    start = F.coalesce("new_valid_from", "_now")
    stays = rows.select(
        *keys, "value", "unit", F.when(act == "upgrade", F.col("new_verification")).otherwise(F.col("verification")).alias("verification"),
        F.when(act == "upgrade", F.col("new_source_id")).otherwise(F.col("source_id")).alias("source_id"), "created_by", "valid_from",
        F.when(act == "replace", F.greatest(start, seen)).otherwise(F.col("valid_until")).alias("valid_until"),
        F.when(moves & F.lit(actor != "seed"), F.greatest("observed_at", "_now")).otherwise(F.col("observed_at")).alias("observed_at"),
        (F.col("is_current") & ~F.coalesce(act == "replace", F.lit(False))).alias("is_current"),
    )
    added = plan.filter("action IN ('add', 'replace')").select(
        *keys, F.col("new_value").alias("value"), F.col("new_unit").alias("unit"), F.col("new_verification").alias("verification"), F.col("new_source_id").alias("source_id"),
        F.lit(actor).alias("created_by"), start.alias("valid_from"), F.lit(None).cast("bigint").alias("valid_until"), seen.alias("observed_at"), F.lit(True).alias("is_current"),
    )
    return stays.unionByName(added)


def conflicts(decided: DataFrame, queue: DataFrame) -> DataFrame:
    """Conflicts to open: not those that are open or were rejected with the same value, label and source."""
    key = [*SCOPE, "value", "verification", "source_id"]
    return decided.filter("action = 'conflict'").select(*key, F.col("_now").alias("observed_at")).join(queue.filter("status IN ('open', 'rejected')").select(*key), key, "left_anti")


def versions_of(rows: DataFrame, keys: list[str], at: str, tie: list[str], value: Column) -> DataFrame:
    """History of observations: one row for each change of value, with valid_from, valid_until (null while current) and is_current.

    A value that comes back after another opens a new row.
    """
    order = Window.partitionBy(*keys).orderBy(at, *tie)
    seen = rows.withColumn("_value", value).withColumn("_before", F.lag("_value").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    changed = seen.filter(F.col("_first") | ~F.col("_value").eqNullSafe(F.col("_before")))
    until = F.lead(at).over(order)
    return changed.select(*keys, F.col("_value").alias("value"), F.col(at).alias("valid_from"), until.alias("valid_until"), until.isNull().alias("is_current"))
