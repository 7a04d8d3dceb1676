"""Graph operators: bounded closure, two hops, propagation of states, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the part of the session's shared folder that is this application's.

    The shared folder is spark.checkpoint.dir; only on one machine is there a default.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or '/tmp/checkpoints').rstrip('/')}/loamworks/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes a frame to the session's shared folder and reads it back, so that a loop's lineage stays short and executors can be lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Deletes what ``settle`` wrote; the frame must not be read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def closure(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, id, depth): what each root reaches over (a, b) edges in up to ``depth`` steps, the root itself at 0, each once at its least depth."""
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    found = level
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("id") == F.col("a")).select("root", F.col("b").alias("id"), F.lit(d).alias("depth")).distinct()
        found = found.unionByName(level)
    return found.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def _steps(hops: DataFrame, most: int) -> DataFrame | None:
    """Pairs two of whose steps after each other make one, or None where there would be more than ``most`` before repeats are dropped."""
    met = hops.groupBy("needs").agg(F.count("*").alias("ends")).join(hops.groupBy("id").agg(F.count("*").alias("starts")), F.col("needs") == F.col("id"))
    pairs = met.agg(F.sum(F.col("ends") * F.col("starts")).alias("n")).first()["n"] or 0
    if pairs > most:
        return None
    after = hops.select(F.col("id").alias("needs"), F.col("needs").alias("_after"))
    return settle(hops.join(after, "needs").select("id", F.col("_after").alias("needs")).distinct())


def propagate(states: DataFrame, depends: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(id, columns): in each of the columns, ``state`` by default, a node takes the greatest value among its own and those it depends on, over any number of steps and around cycles.

    states: (id, columns); depends: (id, needs). A round joins states along hops, which reach twice as far each round as long as there are few of them, so a chain of n nodes
    takes log2(n) rounds; where hops would multiply, they stay as long as they are. It ends when a round changes nothing.
    """
    columns = columns or ["state"]
    now = settle(states.select("id", *columns))
    hops = settle(depends.select("id", "needs").distinct())
    most = 4 * hops.count() + 1000
    while True:
        pushed = hops.join(now.withColumnRenamed("id", "needs"), "needs").groupBy("id").agg(*[F.max(c).alias(f"_{c}") for c in columns])
        joined = now.join(pushed, "id", "left").select("id", *[F.greatest(c, f"_{c}").alias(c) for c in columns], F.coalesce(F.greatest(F.lit(False), *[F.col(f"_{c}") > F.col(c) for c in columns]), F.lit(False)).alias("_risen"))
        after = settle(joined)
        drop_settled(now)
        now = after.drop("_risen")
        if not after.filter("_risen").head(1):
            drop_settled(hops)
            return now
        now._settled = after._settled
        if (further := _steps(hops, most)) is not None:
            drop_settled(hops)
            hops = further


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id of each node's connected component, by hooking labels onto smaller ones and halving the paths between them."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settle(nodes.select("id", F.col("id").alias("component")))
    for _ in range(rounds):
        label = now.select(F.col("id").alias("b"), F.col("component").alias("near"))
        least = both.join(label, "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = now.join(least, F.col("id") == F.col("a"), "left").select("id", F.least("component", "near").alias("component"))
        jump = hooked.select(F.col("id").alias("j"), F.col("component").alias("to"))
        after = settle(hooked.join(jump, F.col("component") == F.col("j"), "left").select("id", F.least("component", "to").alias("component")))
        if not now.join(after.withColumnRenamed("component", "new"), "id").filter("component <> new").head(1):
            return after
        drop_settled(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, level): the round in which each node can be done, 0 without needs, else the one after the last of its needs.

    nodes: (id); needs: distinct (id, needs), both among the nodes. Each node is done once: what it was needed for waits for one less. Raises RuntimeError for
    what waits for itself.
    """
    needs = settle(needs.select("id", "needs"))
    waiting = settle(needs.groupBy("id").agg(F.count("*").alias("n")))
    done = settle(nodes.join(waiting, "id", "left_anti").select("id", F.lit(0).alias("level")))
    found, k = [done], 0
    while done.head(1):
        k += 1
        less = needs.join(done.select(F.col("id").alias("needs")), "needs").groupBy("id").agg(F.count("*").alias("m"))
        after = settle(waiting.join(less, "id", "left").select("id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        drop_settled(waiting)
        done, waiting = settle(after.filter("n = 0").select("id", F.lit(k).alias("level"))), settle(after.filter("n > 0"))
        drop_settled(after)
        found.append(done)
    if waiting.head(1):
        raise RuntimeError("some nodes wait for themselves")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def first_match(node: Column, rules: list[tuple[Column, str]], default: str) -> Column:
    """Name of the first rule that holds, in order."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)
