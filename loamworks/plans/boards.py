"""Boards, evidence, colours and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import colour
from loamworks.operators import boards, relational
from loamworks.plans.registry import query
from loamworks.session import table

NOW_MS = 1_735_689_600_000  # 2025-01-01 in UTC


@query(
    """SELECT a.l_partkey AS entity, a.v AS weights, b.v AS released FROM (SELECT l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a
        JOIN (SELECT l_partkey, max(l_shipdate) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.l_partkey = b.l_partkey"""
)
def fact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that have both of two properties, in one aggregation instead of a self join."""
    facts = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A', 'R')").groupBy(F.col("l_partkey").alias("entity"))
    pairs = facts.agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("weights"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("released"))
    return pairs.filter("weights IS NOT NULL AND released IS NOT NULL")


@query(
    """SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY 1"""
)
def interval_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fall into each order's interval: the range is a condition of an equi join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    inside = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return orders.join(lines, inside, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 12")
def popular_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve brands with most lines; lines are counted by part before they meet the parts."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    tagged = counts.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return tagged.groupBy("p_brand").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


@query(
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS posts, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS comments,
        coalesce((SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'A'), 0) AS ups FROM customer"""
)
def author_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, comments and votes of every author, zeros included."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "A").alias("marked"))
    posts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = posts.groupBy("o_custkey").agg(F.count("*").alias("posts"), F.sum("lines").alias("comments"), F.sum("marked").alias("ups"))
    all_ = table(spark, sf_dir, "customer").select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return all_.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("posts", "comments", "ups")])


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1")
def recent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type in the last day of data."""
    events = table(spark, sf_dir, "events").select("event_type", "ts")
    last = events.agg(F.max("ts").alias("last"))  # one row
    return events.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH e AS (SELECT l_partkey AS entity, epoch_ms(l_shipdate) AS ms, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS rank FROM lineitem),
    g AS (SELECT entity, count(*) FILTER (WHERE ok) AS n, CAST(floor(({NOW_MS} - min(ms) FILTER (WHERE ok)) / 86400000) AS BIGINT) AS age_days, max(rank) FILTER (WHERE ok) AS best
        FROM (SELECT *, ms <= {NOW_MS} AND rank IS NOT NULL AS ok FROM e) GROUP BY 1)
    SELECT entity, n, age_days, coalesce(age_days > 9000, true) AS stale, CASE WHEN coalesce(age_days > 9000, true) OR coalesce(best, 0) < 4 THEN 'LOW' WHEN best >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM g"""
)
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the evidence for each entity can be trusted."""
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"), F.when(line < 7, line).alias("rank"))
    return boards.evidence_confidence(rows, "entity", "ms", "rank", NOW_MS, 9000)


@query("SELECT l.doc_id, coalesce(quality, 0) - coalesce(toxic, 0) + 2 * (l.doc_id % 7) AS hot FROM labels l ORDER BY hot DESC, l.doc_id LIMIT 50")
def front_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front page: votes and twice the comments, newest id last among equals."""
    hot = F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0)) + 2 * (F.col("doc_id") % 7)
    return table(spark, sf_dir, "labels").select("doc_id", hot.alias("hot")).orderBy(F.desc("hot"), "doc_id").limit(50)


@query(
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY starts NULLS LAST, event_id) AS rising, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(starts, 0) DESC, event_id) AS falling
        FROM (SELECT event_type, event_id, CASE WHEN event_id % 5 > 0 THEN epoch_ms(ts) END AS starts FROM events)"""
)
def undated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of events in either direction; those without a date come last in both."""
    starts = F.when(F.col("event_id") % 5 > 0, F.unix_millis(F.col("ts").cast("timestamp")))
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", starts.alias("starts"))
    day = F.floor(F.col("starts") / 86_400_000)
    rising = relational.blocked_places(rows, ["event_type"], day, [F.asc_nulls_last("starts"), F.asc_nulls_last("event_id")], name="rising")
    both = relational.blocked_places(rising, ["event_type"], F.coalesce(day, F.lit(0)), [F.desc(F.coalesce("starts", F.lit(0))), F.asc_nulls_last("event_id"), F.desc("rising")], descending=True, name="falling")
    return both.select("event_type", "event_id", "rising", "falling")


@query(
    """SELECT l_partkey, strftime(day, '%Y-%m-%d') AS day, major, minor FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC) AS k FROM (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, l_linenumber AS major,
        CAST(l_quantity AS BIGINT) AS minor, row_number() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE) ORDER BY l_linenumber DESC, CAST(l_quantity AS BIGINT) DESC) AS j FROM lineitem) WHERE j = 1) WHERE k = 1"""
)
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest version of each entity's last day: day and version compare as one value, so one aggregation does."""
    version = F.struct(F.col("l_shipdate").cast("date").alias("day"), F.col("l_linenumber").alias("major"), F.col("l_quantity").cast("bigint").alias("minor"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(version).alias("v")).select("l_partkey", F.col("v.day").cast("string").alias("day"), "v.major", "v.minor")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)")
def folded_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the automatic rows of the last seven days."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    last = events.agg(F.max("ts").alias("last"))  # one row
    return events.join(F.broadcast(last), ~((F.col("event_type") == "error") & (F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")))).select("event_id")


@query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
)
def replaced_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measurement for each user and kind: a later one takes the place of the one before."""
    return relational.extremal(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), ["event_id", "value"])


@query(
    """WITH l AS (SELECT o_custkey, o_orderpriority AS p, o_orderstatus = 'F' AS stored, min(o_orderkey) AS since FROM orders GROUP BY ALL),
    s AS (SELECT o_custkey, coalesce(list(p ORDER BY since) FILTER (WHERE stored), []) AS a, coalesce(list(p ORDER BY since) FILTER (WHERE NOT stored), []) AS b FROM l GROUP BY 1)
    SELECT o_custkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS merged FROM s"""
)
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries in their order, then what an update adds."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("stored")).agg(F.min("o_orderkey").alias("at"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "o_orderpriority")))), lambda x: x["o_orderpriority"])
    lists = first.groupBy("o_custkey").agg(of(F.col("stored")).alias("a"), of(~F.col("stored")).alias("b"))
    return lists.select("o_custkey", F.array_join(boards.merge_ordered(F.col("a"), F.col("b")), ",").alias("merged"))


@query("SELECT event_type, count(*) AS n, sum(1 + event_id % 4) AS weighted FROM events GROUP BY 1")
def weighted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and rows corrected for sampling: each stands for as many as its interval says."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(1 + F.col("event_id") % 4).alias("weighted"))


@query(
    """WITH q AS (SELECT conv_id, turn, concat_ws(' ', CASE turn % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'Down' ELSE role END, CASE WHEN turn % 3 > 0 THEN role || ' local' END) AS q FROM conversations),
    w AS (SELECT conv_id, turn, string_split(q, ' ') AS w FROM q), m AS (SELECT *, list_transform(w, lambda x: CASE WHEN lower(x) = 'price' THEN 'price' WHEN lower(x) = 'down' THEN 'status' WHEN lower(x) = 'local' THEN 'local' ELSE '' END) AS m FROM w),
    f AS (SELECT *, coalesce(list_position(list_transform(m, lambda x: x <> ''), true), 0) AS f FROM m), r AS (SELECT *, list_filter(w, lambda x, i: i <> f) AS rest FROM f)
    SELECT conv_id, turn, CASE WHEN f > 0 AND len(rest) > 0 THEN m[f] END AS intent, array_to_string(rest, ' ') AS rest FROM r"""
)
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of many searches is after, and its other words."""
    turn = F.col("turn") % 4
    first = F.when(turn == 0, "price").when(turn == 1, "Down").otherwise(F.col("role"))
    text = F.concat_ws(" ", first, F.when(F.col("turn") % 3 > 0, F.concat("role", F.lit(" local"))))
    intent, rest = boards.search_intent(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intent.alias("intent"), rest.alias("rest"))


@query(
    """SELECT p_partkey, p_brand, penalty FROM (SELECT *, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size >= 45) THEN 1 ELSE 0 END AS penalty FROM part) ORDER BY penalty, p_size, p_name, p_partkey LIMIT 20"""
)
def publish_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to publish next: topics that were not used of late first."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    ordered = boards.next_content(part, "p_brand", "p_size", "p_name", part.filter("p_size >= 45"))
    return ordered.orderBy("penalty", "p_size", "p_name", "p_partkey").limit(20).select("p_partkey", "p_brand", "penalty")


def _channel(i: int):
    return F.round((F.col("embedding")[i].cast("double") + 1) / 2, 3)


_LIGHT = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_CHANNELS = "SELECT vec_id, " + ", ".join(f"round((CAST(embedding[{i + 1}] AS DOUBLE) + 1) / 2, 3) AS c{i}" for i in range(6)) + " FROM embeddings"


@query(
    f"""WITH v AS ({_CHANNELS}), l AS (SELECT vec_id, {", ".join(f"{_LIGHT.format(f'c{i}')} AS c{i}" for i in range(3))} FROM v),
    k AS (SELECT vec_id, {", ".join(f"cbrt({' + '.join(f'{x} * c{i}' for i, x in enumerate(w))}) AS k{j}" for j, w in enumerate(colour.TO_CONES))} FROM l)
    SELECT vec_id, {", ".join(f"round({' + '.join(f'{x} * k{i}' for i, x in enumerate(w))}, 6) AS {name}" for name, w in zip(("lightness", "a", "b"), colour.TO_LAB))} FROM k"""
)
def oklab_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual coordinates of colours."""
    lab = colour.oklab(*map(_channel, range(3)))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(lab, ("lightness", "a", "b"))])


@query(
    f"""WITH v AS ({_CHANNELS}), y AS (SELECT vec_id, {", ".join(f"{' + '.join(f'{w} * {_LIGHT.format(f"c{3 * k + i}")}' for i, w in enumerate(colour.LUMINANCE))} AS y{k}" for k in range(2))} FROM v)
    SELECT vec_id, round((greatest(y0, y1) + 0.05) / (least(y0, y1) + 0.05), 6) AS ratio, (greatest(y0, y1) + 0.05) / (least(y0, y1) + 0.05) >= 4.5 AS readable FROM y"""
)
def contrast_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text colour can be read on its ground."""
    ratio = colour.contrast(colour.luminance(*map(_channel, range(3))), colour.luminance(*map(_channel, range(3, 6))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(ratio, 6).alias("ratio"), (ratio >= 4.5).alias("readable"))


@query(
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:6]] AS x, [CAST(y AS DOUBLE) FOR y IN embedding[7:12]] AS y FROM embeddings)
    SELECT vec_id, round(abs(list_sum([x[i] * y[i % 6 + 1] - x[i % 6 + 1] * y[i] FOR i IN range(1, 7)])) / 2, 6) AS area FROM v"""
)
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of hexagons."""
    part = lambda a: F.transform(F.slice("embedding", a, 6), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(colour.polygon_area(part(1), part(7)), 6).alias("area"))


@query(
    """SELECT label, min(embedding[1]) AS x0, max(embedding[1]) AS x1, min(embedding[2]) AS y0, max(embedding[2]) AS y1, round((max(embedding[1]) - min(embedding[1])) * (max(embedding[2]) - min(embedding[2])), 5) AS area, count(*) AS n FROM embeddings GROUP BY 1"""
)
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each label's points."""
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    boxes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))
    return boxes.withColumn("area", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 5))
