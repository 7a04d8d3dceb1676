"""Late, repeated and out-of-order facts: any order of batches gives one table."""

import itertools
import random

import pytest

from loamworks.streaming import late

SCHEMA = "entity string, property string, value string, valid_from bigint, observed_at bigint"
DAY = 86_400_000


def plain(rows):
    by = {}
    for e, p, v, t, o in rows:
        if t is not None:
            by.setdefault((e, p), {}).setdefault(t, []).append((o, v))
    out = []
    for (e, p), times in by.items():
        runs = []
        for t in sorted(times):
            said = max(times[t], key=lambda x: (x[0], x[1] is not None, x[1] or ""))
            last, first = max(o for o, _ in times[t]), min(o for o, _ in times[t])
            if runs and runs[-1][0] == said[1]:
                runs[-1][2], runs[-1][3] = max(runs[-1][2], last), min(runs[-1][3], first)
            else:
                runs.append([said[1], t, last, first])
        for k, (v, t, last, first) in enumerate(runs):
            if v is not None:
                out.append((e, p, v, t, runs[k + 1][1] if k + 1 < len(runs) else None, last, first))
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("entity", "property", "value", "valid_from", "valid_until", "observed_at", "first_seen").collect()))


@pytest.fixture(scope="module")
def facts():
    r = random.Random(3)
    some = [(r.choice("ab"), r.choice(["p", "q"]), r.choice(["1", "2", None]), r.randrange(40) * DAY * 5, r.randrange(100)) for _ in range(120)]
    return some + some[:20] + [("c", "p", "9", None, 5), ("d", "p", "1", 0, 1), ("d", "p", "1", DAY * 300, 9), ("d", "p", "2", DAY * 100, 3), (None, "p", "1", 5, 5)]


def test_history(spark, facts):
    key = lambda f: [x for x in f if x[0] is not None]
    got = late.history(spark.createDataFrame(facts, SCHEMA), ["entity", "property"])
    assert rows(got.filter("entity IS NOT NULL")) == plain(key(facts)) and got.filter("entity IS NULL").count() == 1
    assert rows(late.as_known(spark.createDataFrame(key(facts), SCHEMA), ["entity", "property"], 50)) == plain([f for f in key(facts) if f[4] <= 50])
    assert late.history(spark.createDataFrame([], SCHEMA), ["entity", "property"]).collect() == []


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_history_of_frequent_and_rare_facts(spark, facts, most):
    known = [f for f in facts if f[0] is not None]
    assert rows(late.history(spark.createDataFrame(known, SCHEMA), ["entity", "property"], most=most)) == plain(known)


def test_rare_facts_are_shuffled_once(spark, facts):
    frame = spark.createDataFrame(facts, SCHEMA).filter("valid_from IS NOT NULL").selectExpr("struct(entity, property) AS _key", "value", "valid_from", "observed_at")
    assert late._whole(frame)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_any_order_of_batches_gives_one_table(spark, facts, tmp_path):
    known = [f for f in facts if f[0] is not None]
    parts = [known[0::3], known[1::3], known[2::3]]
    for order in list(itertools.permutations(range(3)))[::2]:
        folder = str(tmp_path / "".join(map(str, order)))
        for k in (*order, order[0]):  # the first comes again
            late.merge(spark.createDataFrame(parts[k], SCHEMA), k, folder, ["entity", "property"], buckets=3)
        assert rows(late.histories(spark, folder)) == plain(known)


def test_stream_keeps_late_rows(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", "p", "new", 10 * DAY, 100)], [("a", "p", "old", 1 * DAY, 101)], [("a", "p", "new", 5 * DAY, 102), ("b", "p", "x", 0, 1)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        late.follow(spark.readStream.schema(SCHEMA).parquet(source), folder, ["entity", "property"], 4).trigger(availableNow=True).start().awaitTermination()
    assert rows(late.histories(spark, folder)) == [("a", "p", "new", 5 * DAY, None, 102, 100), ("a", "p", "old", 1 * DAY, 5 * DAY, 101, 101), ("b", "p", "x", 0, None, 1, 1)]
