"""Scenarios with known answers for what the catalogue's tables don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.functions import colour, pandas_udfs, scalar, values
from loamworks.operators import boards, entities, graph, relational, search, sequences, temporal, traffic


def one(spark, column, **values):
    kinds = {int: "bigint", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x int").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,want", [("1.10", "1.9", 1), ("v1.0", "1", 0), ("1.0-b1", "1.0-b2", None), ("latest", "1", None), ("580.9", "580.1", 1), ("1", "1.0.1", -1), (None, "1", None), ("9" * 70, "1", None)])
def test_version_compare(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(scalar.version_compare(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize("new,old,prop,nv,ov,want", [
    ("OFFICIAL", "OFFICIAL", "size", "1", "1", True), ("COMMUNITY", "OFFICIAL", "size", "1", "1", False), ("AUTOMATED", "OFFICIAL", "version", "580.9", "580.1", True),
    ("AUTOMATED", "OFFICIAL", "version", "580.0", "580.1", False), ("AUTOMATED", "OFFICIAL", "version", "latest", "580.1", False), ("AUTOMATED", "OFFICIAL", "size", "2", "1", False),
])
def test_trust_ladder(spark, new, old, prop, nv, ov, want):
    df = spark.createDataFrame([(new, old, prop, nv, ov)], "n string, o string, p string, nv string, ov string")
    assert df.select(scalar.supersedes(*map(F.col, ("p", "n", "o", "nv", "ov")))).first()[0] is want


@pytest.mark.parametrize("n,want", [(19, 10.0), (20, 18.0), (21, 18.0), (0, 10.0)])
def test_floored_index(spark, n, want):
    df = spark.createDataFrame([([float(i) for i in range(n)],)], "v array<double>")
    assert df.select(scalar.floor_p90(F.col("v"), 10.0, 5.0, 100.0)).first()[0] == want


def test_new_day_in_either_calendar(spark):
    hour = 3_600_000
    f = lambda a, b: spark.range(1).select(scalar.new_day(F.lit(a), F.lit(b))).first()[0]
    assert f(int(14.5 * hour), int(15.5 * hour)) and not f(16 * hour, 17 * hour) and f(23 * hour, 25 * hour)


def test_null_if_either_is(spark):
    assert spark.range(1).select(scalar.both_or_null(F.greatest, F.lit(None).cast("int"), F.lit(1))).first()[0] is None


FACT = "entity_id string, property string, region string, language string, platform string, plan string, app_version string, value string, unit string, verification string, source_id string"


def current(spark, rows):
    full = [(e, p, "*", "*", "*", "*", "*", v, None, label, "a", "auto", 0, None, seen, True) for e, p, v, label, seen in rows]
    return spark.createDataFrame(full, FACT + ", created_by string, valid_from bigint, valid_until bigint, observed_at bigint, is_current boolean")


def document(spark, rows):
    full = [(e, p, None, None, None, None, None, v, None, label, "b", None, newer, i) for i, (e, p, v, label, newer) in enumerate(rows)]
    return spark.createDataFrame(full, FACT + ", valid_from bigint, only_if_newer boolean, position int")


def test_fact_decisions(spark):
    day = scalar.DAY_MS
    state = current(spark, [("a", "size", '"A"', "OFFICIAL", 0), ("b", "size", '"A"', "COMMUNITY", 0), ("c", "version", '"580.1"', "OFFICIAL", 0), ("d", "version", '"2.0"', "AUTOMATED", 0), ("e", "size", "1", "OFFICIAL", 10 * day)])
    doc = document(spark, [("a", "size", '"B"', "COMMUNITY", False), ("b", "size", '"A"', "OFFICIAL", False), ("c", "version", '"580.9"', "AUTOMATED", False), ("d", "version", '"1.9"', "AUTOMATED", True),
        ("e", "size", "1", "OFFICIAL", False), ("f", "size", "1", "ESTIMATE", False), ("f", "size", "2", "ESTIMATE", False)])
    decided = temporal.decide(state, doc, "auto", 10 * day + 1000)
    assert {r["entity_id"]: r["action"] for r in decided.collect()} == {"a": "conflict", "b": "upgrade", "c": "replace", "d": "keep", "e": "confirm", "f": "add"}
    after = temporal.apply(state, decided, "auto")
    got = {(r["entity_id"], r["is_current"]): (r["value"], r["verification"], r["observed_at"]) for r in after.collect()}
    assert got["c", False][0] == '"580.1"' and got["c", True][0] == '"580.9"' and got["f", True][0] == "2" and got["b", True][1] == "OFFICIAL" and got["e", True][2] == 10 * day
    again = temporal.decide(after, doc, "auto", 10 * day + 1000)
    assert {r["action"] for r in again.collect()} == {"conflict", "confirm", "keep"}
    assert sorted(map(str, temporal.apply(after, again, "auto").collect())) == sorted(map(str, after.collect()))


def test_conflicts_once(spark):
    state, doc = current(spark, [("a", "size", "1", "OFFICIAL", 0)]), document(spark, [("a", "size", "2", "COMMUNITY", False)])
    decided = temporal.decide(state, doc, "auto", 1)
    queue = decided.limit(0).withColumn("status", F.lit("open"))
    opened = temporal.conflicts(decided, queue)
    assert opened.count() == 1
    assert temporal.conflicts(decided, decided.withColumn("status", F.lit("rejected"))).count() == 0


def test_value_that_comes_back_opens_a_new_row(spark):
    rows = spark.createDataFrame([("k", 1, "A"), ("k", 2, "A"), ("k", 3, "B"), ("k", 4, "A")], "k string, t int, v string")
    got = [tuple(r) for r in temporal.versions_of(rows, ["k"], "t", [], F.col("v")).orderBy("valid_from").collect()]
    assert got == [("k", "A", 1, 3, False), ("k", "B", 3, 4, False), ("k", "A", 4, None, True)]


def test_first_or_last_wins(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, position int, v string")
    assert temporal.winners(rows, ["k"], "position").first()["v"] == "b" and temporal.winners(rows, ["k"], "position", last=False).first()["v"] == "a"


def test_verdict_ladder(spark):
    day = scalar.DAY_MS
    votes = [("x", u, 100 * day, "works") for u in range(3)] + [("x", 0, 99 * day, "broken")] + [("y", 1, 100 * day, "works"), ("y", 2, 100 * day, "broken")] + [("z", 1, 40 * day, "broken")]
    df = spark.createDataFrame(votes, "t string, u bigint, a bigint, r string")
    got = {r["t"]: r for r in relational.vote_verdict(df, "t", "u", "a", "r", F.lit(1.0), 100 * day, 60.0 * day).collect()}
    assert (got["x"]["verdict"], got["x"]["trust"], got["x"]["users"]) == ("works", "COMMUNITY_VERIFIED", 3)
    assert got["y"]["trust"] == "DISPUTED" and got["z"]["negative"] == pytest.approx(0.5)


def test_small_cells_are_hidden(spark):
    votes = spark.createDataFrame([("kr", 1)] * 4 + [("us", 1)] * 3 + [("us", 0)] * 2, "c string, has int")
    got = {r["c"]: (r["n"], r["pct"]) for r in relational.suppressed_share(votes, ["c"], F.col("has") == 1).collect()}
    assert got == {"kr": (4, None), "us": (5, 60), None: (9, 78)}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, s int, v string")
    got = sorted((r["k"], r["t"], r["v"] or "") for r in relational.as_of(left, right, "k", "t", "s", ["v"]).collect())
    assert got == [("a", 1, ""), ("a", 5, "y"), ("b", 5, "")]


def test_closure_is_bounded_and_distinct(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (5, 6), (6, 5)], "a int, b int")
    got = sorted(tuple(r) for r in graph.closure(edges, spark.createDataFrame([(1,), (5,)], "id int"), 2).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (5, 5, 0), (5, 6, 1)]


def test_propagation_in_cycles_and_chains(spark):
    states = spark.createDataFrame([(i, 9 if i == 0 else 1) for i in range(12)], "id int, state int")
    needs = spark.createDataFrame([(i, i - 1) for i in range(1, 10)] + [(10, 11), (11, 10)], "id int, needs int")
    got = {r["id"]: r["state"] for r in graph.propagate(states, needs).collect()}
    assert all(got[i] == 9 for i in range(10)) and got[10] == got[11] == 1


def test_components_of_a_long_path(spark):
    nodes = spark.range(40).select(F.col("id"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 29)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[i] == i for i in range(30, 40))


def test_retention(spark):
    rows = spark.createDataFrame([("k", i, i * 1000) for i in range(100)], "k string, id int, t bigint")
    kept = sorted(r["id"] for r in sequences.retain(rows, ["k"], "t", "id", 100_000, 5, 50, 20_000).collect())
    assert kept == list(range(80, 100))


def test_islands(spark):
    rows = spark.createDataFrame([("k", h) for h in (1, 2, 4)], "k string, h int")
    runs = sequences.islands(rows, ["k"], ["h"], F.col("h") - sequences.before("h", ["k"], ["h"]) > 1)
    assert sorted((r["h"], r["island"]) for r in runs.collect()) == [(1, 1), (2, 1), (4, 2)]


_BROWSER = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/126.0 Safari/537.36"


@pytest.mark.parametrize("ua,more,cls,name,reason", [
    ("Mozilla/5.0 (compatible; Googlebot/2.1)", {}, "declared", "Googlebot", "agent"), ("Mozilla/5.0 (compatible; Googlebot/2.1)", {"network": 15169}, "verified", "Googlebot", "network"), ("", {}, "suspected", "No user agent", "empty-agent"),
    ("curl/8", {}, "suspected", "curl", "library"), ("my-crawler/1", {}, "declared", "my-crawler", "agent"), (_BROWSER, {}, "candidate", "", ""), ("Opera/9", {}, "suspected", "Opera", "no-browser"), (None, {}, "suspected", "No user agent", "empty-agent"),
    ("x", {"verified": True}, "verified", "Verified bot", "platform"), (_BROWSER, {"accept_language": None}, "suspected", "Browser without Accept-Language", "no-accept-language"), (_BROWSER, {"network": 16509}, "suspected", "Datacenter · AS16509", "datacenter"),
    (_BROWSER, {"sec_fetch_mode": ""}, "suspected", "Browser without Fetch Metadata", "no-fetch-metadata"), (_BROWSER, {"sec_fetch_mode": "", "kind": "beacon"}, "candidate", "", ""), (_BROWSER, {"webdriver": True}, "suspected", "WebDriver", "webdriver"),
])
def test_classification_order(spark, ua, more, cls, name, reason):
    row = {"ua": ua, "accept_language": "en", "sec_fetch_mode": "navigate", "network": 0, "organization": None, "verified": None, "platform_category": None, "kind": "page", "webdriver": None} | more
    kinds = "ua string, accept_language string, sec_fetch_mode string, network bigint, organization string, verified boolean, platform_category string, kind string, webdriver boolean"
    got = traffic.classify(spark.createDataFrame([tuple(row.values())], kinds)).first()
    assert (got["cls"], got["name"], got["reason"]) == (cls, name, reason)


def test_points_are_appended_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "page", "x" * 200), ("2024-01-02 10:00:00", None, "y")], "ts string, kind string, name string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        traffic.append_points(rows, f"{tmp_path}/log")
    got = spark.read.parquet(f"{tmp_path}/log")
    assert got.count() == 4 and sorted((r["kind"], len(r["name"])) for r in got.filter("day = '2024-01-01'").collect()) == [("page", 96)] * 2
    assert got.filter("kind = '' AND path = '' AND weight = 1").count() == 2


def test_trending_drops_nested_terms(spark):
    titles = spark.createDataFrame([(1, "new gpu driver"), (2, "gpu driver crash"), (3, "big patch notes"), (4, "patch notes out")], "id int, t string")
    got = [t for t, _ in search.drop_nested(search.trending(titles, "id", "t"))]
    assert got == ["gpu driver", "patch notes"]


def test_text_udfs(spark):
    df = spark.createDataFrame([("ﬁ e\u0301 👩‍💻",), (None,)], "t string")
    assert [tuple(r) for r in df.select(pandas_udfs.nfkc("t"), pandas_udfs.graphemes("t")).collect()] == [("fi é 👩‍💻", 5), (None, 0)]


def test_running_totals_reach_marks_exactly(spark, tmp_path):
    from loamworks.operators import sequences
    from loamworks.plans.catalogue import QUERIES

    rows = [("a", i, 0.1) for i in range(10)] + [("b", 0, None), ("b", 1, 1e15), ("b", 2, 0.5), ("c", 0, 2.5), ("c", 1, float("nan")), ("d", 0, 1e-20), ("d", 1, None)]
    frame = spark.createDataFrame(rows, "k string, i int, v double").select("k", "i", sequences.running_total("v", ["k"], ["i"]).alias("t"))
    got = {(r["k"], r["i"]): (r["t"]["exact"], r["t"]["near"]) for r in frame.collect()}
    assert got["a", 9][0] == 1 and got["a", 9][1] < 1 and got["b", 0] == (None, None) and got["b", 2] == (None, 1e15 + 0.5)
    assert got["c", 0][0] == 2.5 and got["c", 1][0] is None and got["c", 1][1] != got["c", 1][1] and got["d", 1] == (0, 1e-20)

    values = [79.05, 78.91, 80.83, 25.27, 83.33, 66.64, 8.24, 1.65, 1.44, 74.64, 1.0]  # the first ten are 500, and 499.9999999999999 as doubles
    events = spark.createDataFrame(list(enumerate(values)), "event_id long, value double").withColumns({"user_id": F.lit(7), "ts": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id)")})
    events.write.parquet(f"{tmp_path}/events.parquet")
    start = 1_704_067_200_000
    assert [tuple(r) for r in QUERIES["alert_thresholds"](spark, str(tmp_path)).collect()] == [(7, 500, start + 9000)]


def test_agent_texts_are_judged_once_each(spark):
    kinds = {"accept_language": "'en'", "sec_fetch_mode": "'navigate'", "network": "0", "organization": "CAST(NULL AS STRING)", "verified": "false", "platform_category": "CAST(NULL AS STRING)", "kind": "'page'", "webdriver": "false"}
    requests = spark.range(300).selectExpr("id", "element_at(array('curl/8.5', 'Mozilla/5.0 (X11) Chrome/126.0', NULL), CAST(id % 3 AS INT) + 1) AS ua", *[f"{v} AS {k}" for k, v in kinds.items()])
    told = traffic.classify(requests)
    assert "Aggregate [_ua" in told._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"] % 3, r["name"], r["browser"]) for r in told.collect()} == {(0, "curl", "bot"), (1, "", "chrome"), (2, "No user agent", "bot")} and told.count() == 300


def test_fnv_hashes_are_taken_in_batches(spark):
    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "foobar", "한글 ü 👩", "x" * 5000, "a", " ", "\0", *map(str, range(300)), None]
    hashed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", "t", values.fnv64(F.col("t")).alias("h"))
    assert {r["i"]: r["h"] for r in hashed.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)} and plain("foobar") == "85944171f73967e8"
    assert "ArrowEvalPython" in hashed._jdf.queryExecution().executedPlan().toString()  # whole batches, not byte by byte through decimals


def test_either_end_meets_edges_that_lack_an_end(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, None, 2), (4, 2, None), (5, None, None), (6, 9, 9)], "e int, a int, b int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    got = sorted((r["node"], r["e"]) for r in relational.either_end(edges, nodes, "a", "b", "node").collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 3), (2, 4)]


def test_plans_push_down_and_stay_off_products(spark, sf):
    from loamworks.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(o_orderstatus,O)" in plan("anti_unconfirmed") and "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan("anti_unconfirmed")
    for name in ("or_join_union", "asof_latest", "two_hop"):
        assert "CartesianProduct" not in plan(name) and "NestedLoop" not in plan(name)


def test_search_intent_takes_the_first_word_only_if_others_remain(spark):
    rows = [("GPT Price status",), ("가격",), ("  Claude   장애 ",), ("nothing here",), ("",), (None,)]
    intent, rest = boards.search_intent(F.col("q"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "q string").select(intent.alias("i"), rest.alias("r")).collect()]
    assert got == [("price", "GPT status"), (None, ""), ("status", "Claude"), (None, "nothing here"), (None, ""), (None, None)]


def test_evidence_confidence(spark):
    day = 86_400_000
    rows = [("a", 990 * day, 6), ("a", 900 * day, 2), ("b", 990 * day, 5), ("c", 100 * day, 7), ("d", 1001 * day, 7), ("d", None, 7), ("e", 999 * day, None), ("f", 990 * day, 3)]
    got = {r["k"]: (r["n"], r["age_days"], r["stale"], r["confidence"]) for r in boards.evidence_confidence(spark.createDataFrame(rows, "k string, ms long, rank int"), "k", "ms", "rank", 1000 * day).collect()}
    assert got == {"a": (2, 100, False, "HIGH"), "b": (1, 10, False, "MEDIUM"), "c": (1, 900, True, "LOW"), "d": (0, None, True, "LOW"), "e": (0, None, True, "LOW"), "f": (1, 10, False, "LOW")}


def test_merge_ordered_and_next_content(spark):
    lists = spark.createDataFrame([(["b", "a"], ["c", "a", "c"]), (None, ["x"]), (["x"], None)], "s array<string>, i array<string>")
    assert [r[0] for r in lists.select(boards.merge_ordered(F.col("s"), F.col("i"))).collect()] == [["b", "a", "c"], ["x"], ["x"]]
    pages = spark.createDataFrame([("t", 1, "/a"), ("u", 2, "/b"), (None, 2, "/0")], "cluster string, priority int, route string")
    found = boards.next_content(pages, "cluster", "priority", "route", pages.filter("cluster = 't'")).collect()
    assert [(r["route"], r["penalty"]) for r in found] == [("/0", 0), ("/b", 0), ("/a", 1)]


def test_colours_and_shapes(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (None, 0.0, 0.0)], "r double, g double, b double")
    light = [r[0] for r in rows.select(colour.oklab(F.col("r"), F.col("g"), F.col("b"))[0]).collect()]
    assert abs(light[0] - 1) < 1e-6 and light[1] == 0 and light[2] is None
    one = rows.limit(1).select(colour.contrast(colour.luminance(*[F.lit(1.0)] * 3), colour.luminance(*[F.lit(0.0)] * 3))).first()[0]
    assert abs(one - 21) < 1e-9
    shapes = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 3.0, 3.0]), ([0.0, 1.0], [0.0, 1.0])], "x array<double>, y array<double>")
    assert [r[0] for r in shapes.select(colour.polygon_area(F.col("x"), F.col("y"))).collect()] == [6.0, 0.0]


@pytest.mark.parametrize("radius,shared", [(3, 3), (1, 2), (0, 1), (5, 2)])
def test_near_signatures(spark, radius, shared):
    rng = np.random.default_rng(radius)
    values = rng.integers(-(2**63), 2**63 - 1, 40).tolist()
    for v in list(values)[:25]:
        for k in range(1, radius + 2):
            flipped = v
            for bit in rng.choice(64, k, replace=False).tolist():
                flipped ^= 1 << bit
            values.append(flipped - (1 << 64) if flipped >= 1 << 63 else flipped + (1 << 64) if flipped < -(1 << 63) else flipped)
    values += values[:3]
    least = {v: i for i, v in reversed(list(enumerate(values)))}
    away = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = sorted((i, j) for a, i in least.items() for b, j in least.items() if i < j and away(a, b) <= radius)
    got = entities.near_signatures(spark.createDataFrame(list(enumerate(values)), "id int, s bigint"), "id", "s", radius, 64, shared)
    assert sorted(map(tuple, got.collect())) == want


def test_near_signatures_send_no_side_whole(spark):
    frame = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, 1 << 40), (5, 0)], "id int, s bigint")
    got = entities.near_signatures(frame, "id", "s", 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 4), (2, 3)]


def test_undated_order_with_null_ids(spark, tmp_path):
    from loamworks.plans.catalogue import QUERIES

    spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT), 'a', TIMESTAMP_NTZ '2024-01-02 00:00:00'), (5, 'a', NULL), (10, 'a', NULL), (NULL, 'a', NULL), (1, 'a', TIMESTAMP_NTZ '2024-01-01 00:00:00') AS t(event_id, event_type, ts)").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["event_id"], r["rising"], r["falling"]) for r in QUERIES["undated_order"](spark, str(tmp_path)).collect()}
    assert {g[:2] for g in got} == {(1, 1), (5, 2), (10, 3), (None, 4), (None, 5)} and {g[::2] for g in got} == {(1, 1), (5, 2), (10, 3), (None, 4), (None, 5)}


def test_change_rows_of_equal_and_missing_positions(spark):
    from loamworks.operators import publish

    text = "entity_id int, kind string, property string, scope string, old_value string, new_value string, ref_id string, source_id int, position int"
    row = lambda e, source, position: (e, "k", None, None, "a", "b", None, source, position)
    rows = [row(1, 9, 5), row(1, 3, 5), row(1, 4, 5), row(2, 3, None), row(2, 4, 7)]
    for given in (rows, rows[::-1]):
        got = publish.change_rows(spark.createDataFrame(given, text).coalesce(1), spark.createDataFrame([(3, "feed")], "source_id int, adapter string"), "seed")
        assert sorted((r["entity_id"], r["position"], r["origin"]) for r in got.collect()) == [(1, 5, "collector"), (2, 7, "seed")]
