"""Array kernels: palettes, similarity of blocks, spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.plans.registry import query
from loamworks.session import table


def _centers(vectors: DataFrame, labels: str, dims: int) -> DataFrame:
    """(label, center): means of each label's first components."""
    means = [F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(dims)]
    return vectors.groupBy(labels).agg(*means).select(F.col(labels).alias("center_label"), F.array(*[f"m{i}" for i in range(dims)]).alias("center"))


def assign(vectors: DataFrame, centers: DataFrame, dims: int, most: int = 1000) -> DataFrame:
    """Rows with the label of the nearest center, the least label of equally near ones; distances rounded to nine digits.

    The centers become one broadcast row; more than ``most`` of them raise ValueError.
    """
    n = centers.count()
    if n > most:
        raise ValueError(f"{n} centers; at most {most} are compared with every row")
    one = centers.agg(F.sort_array(F.collect_list(F.struct("center_label", "center"))).alias("centers"))
    square = lambda c: F.aggregate(F.zip_with(F.slice("embedding", 1, dims), c["center"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    ranked = F.array_min(F.transform("centers", lambda c: F.struct(F.round(square(c), 9).alias("d"), c["center_label"].alias("l"))))
    return vectors.crossJoin(F.broadcast(one)).withColumn("nearest", ranked).select("vec_id", "label", "embedding", F.col("nearest.l").alias("assigned"), F.col("nearest.d").alias("distance"))


_ASSIGN = """m AS (SELECT label, """ + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS m{i}" for i in range(64)) + """ FROM embeddings GROUP BY label),
    d AS (SELECT vec_id, m.label AS l, round(""" + " + ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) - m{i}) * (CAST(embedding[{i + 1}] AS DOUBLE) - m{i})" for i in range(64)) + """, 9) AS d FROM embeddings, m),
    a AS (SELECT vec_id, arg_min(l, (d, l)) AS assigned FROM d GROUP BY vec_id)"""  # fmt: skip


@query(f"WITH {_ASSIGN} SELECT vec_id, assigned FROM a")
def palette_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of the labels' means, over all components."""
    v = table(spark, sf_dir, "embeddings")
    return assign(v, _centers(v, "label", 64), 64).select("vec_id", "assigned")


@query(f"WITH {_ASSIGN} SELECT assigned, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS c0, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS c1 FROM a JOIN embeddings USING (vec_id) GROUP BY assigned")
def palette_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Lloyd step: assign, then new means."""
    v = table(spark, sf_dir, "embeddings")
    got = assign(v, _centers(v, "label", 64), 64)
    mean = lambda i: F.round(F.avg(F.col("embedding")[i].cast("double")), 6)
    return got.groupBy("assigned").agg(F.count("*").alias("n"), mean(0).alias("c0"), mean(1).alias("c1"))


@query(
    """WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS block, value AS x, floor(value / 8) * 8 AS y FROM events),
    b AS (SELECT user_id, block, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy FROM s GROUP BY ALL),
    q AS (SELECT user_id, ((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225)) / ((mx * mx + my * my + 6.5025) * ((xx - mx * mx) + (yy - my * my) + 58.5225)) AS ssim FROM b)
    SELECT user_id, round(avg(ssim), 6) AS ssim, count(*) AS blocks FROM q GROUP BY user_id"""
)
def block_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of a series and its quantised copy, over blocks of eight."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = table(spark, sf_dir, "events").select("user_id", F.floor(at / 8).alias("block"), F.col("value").alias("x"), (F.floor(F.col("value") / 8) * 8).alias("y"))
    x, y = F.col("x"), F.col("y")
    b = s.groupBy("user_id", "block").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"))
    mx, my = F.col("mx"), F.col("my")
    ssim = ((2 * mx * my + 6.5025) * (2 * (F.col("xy") - mx * my) + 58.5225)) / ((mx * mx + my * my + 6.5025) * ((F.col("xx") - mx * mx) + (F.col("yy") - my * my) + 58.5225))
    return b.select("user_id", ssim.alias("q")).groupBy("user_id").agg(F.round(F.avg("q"), 6).alias("ssim"), F.count("*").alias("blocks"))


@query()
def fft_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest period, in hours, of each type's hourly counts: one short series a type, transformed in a task of its own."""

    def strongest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("hour")
        full = np.zeros(int(y["hour"].max() - y["hour"].min()) + 1)
        full[(y["hour"] - y["hour"].min()).astype(int)] = y["n"]
        power = np.abs(np.fft.rfft(full - full.mean()))
        k = int(power[1:].argmax()) + 1 if len(power) > 1 else 0
        return pd.DataFrame({"event_type": [key[0]], "period": [len(full) / k if k else 0.0], "power": [float(power[k]) if k else 0.0]})

    hours = table(spark, sf_dir, "events").groupBy("event_type", F.floor(scalar.millis(F.col("ts")) / 3_600_000).alias("hour")).agg(F.count("*").alias("n"))
    return hours.groupBy("event_type").applyInPandas(strongest, "event_type string, period double, power double")
