from datetime import datetime
import pytest
from pyspark.sql import functions as F

from loamworks.streaming import jobs


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over batches of rows, one file each, and returns what it appended."""

    def run(batches, schema, job, mode="append"):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        name = f"out_{abs(hash(str(tmp_path)))}"
        q = job(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return spark.table(name).toPandas()

    return run


def at(text):
    return datetime.fromisoformat(text)


def test_minute_counts(stream):
    rows = [[("a", at("2024-01-01 00:00:01")), ("a", at("2024-01-01 00:00:40")), ("b", at("2024-01-01 00:00:59"))], [("a", at("2024-01-01 01:00:00"))]]
    got = stream(rows, "k string, t timestamp", lambda s: jobs.minute_counts(s, "k", "t", 1))
    assert sorted(zip(got["k"], got["n"], got["allowed"])) == [("a", 2, 1), ("b", 1, 1)]


def test_replays_are_dropped(stream):
    rows = [[("o1", at("2024-01-01 00:00:00")), ("o1", at("2024-01-01 00:00:05"))], [("o1", at("2024-01-01 02:00:00")), ("o2", at("2024-01-01 03:00:00"))]]
    got = stream(rows, "op string, t timestamp", lambda s: jobs.first_operations(s, ["op"], "t"))
    assert sorted(got["op"]) == ["o1", "o2"]


def test_episodes_like_the_batch_operator(stream):
    rows = [[("a", at("2024-01-01 00:00:00")), ("a", at("2024-01-01 01:00:00"))], [("a", at("2024-01-01 02:30:00"))], [("a", at("2024-01-01 06:00:00"))]]
    got = stream(rows, "k string, t timestamp", lambda s: jobs.episodes(s, "k", "t"))
    last = got.groupby("claimed")["n"].max()
    assert last.tolist() == [3, 1] and got["is_new"].sum() == 2


def test_a_failing_target_stops_no_other(spark):
    seen, failed = [], []
    write = jobs.to_targets({"bad": lambda b, i: 1 / 0, "good": lambda b, i: seen.append(b.count())}, lambda name, i, e: failed.append((name, type(e))))
    write(spark.range(3), 0)
    assert seen == [3] and failed == [("bad", ZeroDivisionError)]


def test_hourly_and_hopping(stream):
    rows = [[(at("2024-01-01 00:10:00"), 1.0), (at("2024-01-01 00:50:00"), 3.0)], [(at("2024-01-02 00:00:00"), 0.0)]]
    got = stream(rows, "t timestamp, v double", lambda s: jobs.hourly_counts(s, "t", big=F.col("v") > 2))
    assert got[["n", "big"]].values.tolist() == [[2, 1]]
