"""Facts that arrive late, out of order or again: a table of histories that is the same whatever the order of the batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.operators.sequences import before_in_blocks

#: Buckets of facts: a batch reads and writes the histories of the buckets that it touches.
BUCKETS = 64
#: Milliseconds of valid time in a block: the history of one fact is worked on block by block.
BLOCK_MS = 30 * 86_400_000
#: Observations of one fact up to which one task takes its history as a whole; of more, it is worked on in blocks.
MOST = 100_000


def history(observed: DataFrame, keys: list[str], block_ms: int = BLOCK_MS, most: int = MOST) -> DataFrame:
    """(keys, value, valid_from, valid_until, observed_at, first_seen): how the values of each fact follow one another in valid time.

    observed: keys, value, valid_from and observed_at in ms; rows may come in any order and more than once. What is said of one time is what was observed last (of equal times the greater value);
    a value that goes on is one row, with when it was last and first observed. valid_until is null for the value that still holds. A null value ends what held before. Rows without valid_from are left out.
    Facts of at most ``most`` observations are shuffled once and worked on as a whole, the others block by block.
    """
    rows = observed.filter("valid_from IS NOT NULL").select(F.struct(*keys).alias("_key"), "value", "valid_from", "observed_at")
    often = rows.groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("_key")  # one in ``most`` rows at the most
    runs = _whole(rows.join(F.broadcast(often), "_key", "left_anti")).unionByName(_in_blocks(rows.join(F.broadcast(often), "_key", "left_semi"), block_ms))
    return runs.filter("value IS NOT NULL").select("_key.*", "value", "valid_from", "valid_until", "observed_at", "first_seen")


def _said(rows: DataFrame) -> DataFrame:
    """What is said of each time: v, a struct that is never null, and when it was observed."""
    said = rows.groupBy("_key", "valid_from").agg(F.max(F.struct("observed_at", "value")).alias("s"), F.min("observed_at").alias("first_seen"))
    return said.select("_key", "valid_from", F.struct(F.lit(True).alias("there"), F.col("s.value").alias("value")).alias("v"), "s.observed_at", "first_seen")


def _whole(rows: DataFrame) -> DataFrame:
    """Runs of facts that each fit one task: rows are shuffled by fact once, and all steps are taken where they are then."""
    order = Window.partitionBy("_key").orderBy("valid_from")
    told = _said(rows.repartition("_key")).withColumn("was", F.lag("v").over(order))
    marks = told.withColumn("start", F.when(F.col("was").isNull() | ~F.col("v.value").eqNullSafe(F.col("was.value")), F.col("valid_from")))
    carried = marks.withColumn("start", F.max("start").over(order))  # starts rise along valid time
    runs = carried.groupBy("_key", "start").agg(F.first("v.value").alias("value"), F.max("observed_at").alias("observed_at"), F.min("first_seen").alias("first_seen"))
    return runs.withColumnRenamed("start", "valid_from").withColumn("valid_until", F.lead("valid_from").over(order))


def _in_blocks(rows: DataFrame, block_ms: int) -> DataFrame:
    """Runs of facts of any number of rows, block by block of valid time."""
    said = _said(rows)
    block = F.floor(F.col("valid_from") / block_ms)
    told = before_in_blocks(said, "v", ["_key"], block, ["valid_from"], "was")
    starts = told.filter(F.col("was").isNull() | ~F.col("v.value").eqNullSafe(F.col("was.value")))
    later = starts.withColumn("_back", -F.col("valid_from"))
    runs = before_in_blocks(later.select("_key", "valid_from", "_back", "v"), "valid_from", ["_key"], -F.floor(F.col("valid_from") / block_ms), ["_back"], "valid_until").select("_key", "valid_from", "valid_until", F.col("v.value").alias("value"))
    # what goes on tells of when it was observed; a row finds its run by the last start, block by block as well
    marks = told.withColumn("start", F.when(F.col("was").isNull() | ~F.col("v.value").eqNullSafe(F.col("was.value")), F.col("valid_from")))
    carried = _last_in_blocks(marks, "start", block)
    seen = carried.groupBy("_key", F.col("start").alias("valid_from")).agg(F.max("observed_at").alias("observed_at"), F.min("first_seen").alias("first_seen"))
    return runs.join(seen, ["_key", "valid_from"])


def _last_in_blocks(rows: DataFrame, value: str, block: Column) -> DataFrame:
    """``rows`` with the last value that isn't null up to each row's valid_from, within its key."""
    marked = rows.withColumn("_block", block)
    ends = marked.groupBy("_key", "_block").agg(F.max(value).alias("_most"))  # starts rise along valid time
    before = ends.withColumn("_before", F.max("_most").over(Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    own = F.max(value).over(Window.partitionBy("_key", "_block").orderBy("valid_from"))
    return marked.withColumn("_own", own).join(before, ["_key", "_block"]).withColumn(value, F.coalesce("_own", "_before")).select(*rows.columns)


def as_known(observed: DataFrame, keys: list[str], at: int, block_ms: int = BLOCK_MS) -> DataFrame:
    """The history as it was known at a time: from what had been observed by then."""
    return history(observed.filter(F.col("observed_at") <= at), keys, block_ms)


def merge(batch: DataFrame, batch_id: int, folder: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Takes a batch of observations into the tables below ``folder``: observations, by bucket and batch, and history, by bucket.

    A batch may come again: it replaces what it wrote. Histories are made anew for the touched buckets, from all that was observed of their facts, so a late row corrects what came
    before it, and any order of batches gives the same tables.
    """
    spark = batch.sparkSession
    rows = batch.select(*keys, "value", "valid_from", "observed_at").withColumns({"bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), "batch": F.lit(batch_id).cast("bigint")})
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{folder}/observations")
    seen = observations(spark, folder)
    touched = [r["bucket"] for r in seen.filter(F.col("batch") == batch_id).select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        whole = history(seen.filter(F.col("bucket").isin(touched)), [*keys, "bucket"])
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/history")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/observations")


def histories(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/history").drop("bucket")


def follow(stream: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS):
    """A stream writer that merges each micro-batch; late rows are never dropped."""
    return stream.writeStream.foreachBatch(lambda df, n: merge(df, n, folder, keys, buckets)).option("checkpointLocation", f"{folder}/progress")
