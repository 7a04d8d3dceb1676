"""Helpers of several operators: tables in the shared folder, hashing, spanning edges."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"
#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many rows a Python worker is given at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


#: Every byte that is not of a term as a space, A-Z lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of all that is not ASCII, only A-Z lower-cased. Null: none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share, to be deleted when the application is done.

    A default of our own only on one machine: on a cluster, executors would write to folders that nobody else sees, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or '/tmp/checkpoints').rstrip('/')}/loamworks/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends there.

    Unlike cached blocks the files outlive executors, and unlike checkpoint() the plan runs once. The shuffle files of the plan are deleted as soon as it has run: what
    is written takes their place. ``batch_rows``: rows that Python workers are given at once, where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; the frame must not be read again."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spanning_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links a[i]-b[i] among nodes 0..n-1: (node, smallest node of its component) of each touched node but the smallest.

    At most n - 1 edges that connect what the links connect, however many links there are.
    """
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def worker_store() -> dict:
    """What a Python worker keeps from task to task, such as an opened vocabulary."""
    name = "_loamworks_worker_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


class Memo(dict):
    """Results of ``f`` by key, the last ``size`` to twice as many kept: read with [] or map(memo.__getitem__, keys)."""

    def __init__(self, f, size: int):
        super().__init__()
        self.f, self.size, self.old = f, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
