"""Compatibility of stacks with an upgrade: orders are stacks, their lines the parts, and every part of the catalogue states a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.operators import compatibility, graph
from loamworks.plans.registry import query
from loamworks.session import table

TODAY = 20_000
_PLATFORMS = ("windows", "macos", "linux")
_STATUS_OF = ("READY", "READY", "READY", "CAUTION", "LEGACY", "BLOCKED")
_SOURCES = ("vendor", "release_notes", "repository", "verified_community", "community", "inference")
_PROOF = ("title", "quote")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pk, size, key = F.col("p_partkey"), F.col("p_size"), F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stack"), F.col("l_linenumber").alias("line")).agg(F.max("l_partkey").alias("pk"), F.max("l_quantity").cast("int").alias("q"))
    lines = graph.settle(lines.withColumn("id", F.col("line") * 10 + F.col("pk") % 10))
    number = F.concat(F.floor(F.col("q") / 10).cast("string"), F.lit("."), (F.col("q") % 10).cast("string"))
    parts = lines.select(
        "stack", "id", F.when(F.col("q") % 11 == 0, "latest").otherwise(number).alias("version"), F.when(F.col("pk") % 97 == 0, "macos").alias("platform"), F.when(F.col("pk") % 53 == 0, "arm64").alias("architecture"), F.lit(None).cast("string").alias("install_type"),
        (F.col("pk") % 53 == 0).alias("native"), (F.col("line") % 2 == 1).alias("critical"), (F.col("pk") % 29 == 0).alias("ignored"), F.lit(False).alias("sample"),
    )
    targets = table(spark, sf_dir, "orders").select(
        key.alias("stack"), F.concat(F.lit("3."), F.col("o_custkey") % 4).alias("version"), _pick(_PLATFORMS, key % 3).alias("platform"), F.when(key % 4 == 3, "arm64").otherwise("x86_64").alias("architecture"), F.lit("Studio").alias("host"),
        F.when(F.col("o_custkey") % 37 == 0, "3.9").otherwise("2.9").alias("current"), F.when(key % 13 != 0, F.create_map(F.lit("os"), (key % 4 + 8).cast("string"))).alias("facts"), _texts().alias("formats"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    id = (pk % 7 + 1) * 10 + pk % 10
    low = size % 3
    rules = part.select(
        pk.alias("rule"), pk.alias("place"), id.alias("part"), F.lit("studio").alias("host"), F.when(size % 3 == 0, _texts(*_PLATFORMS)).when(size % 3 == 1, _texts("windows", "macos")).otherwise(_texts("linux")).alias("platforms"),
        F.when(size % 2 == 1, _texts("universal")).otherwise(_texts("x86_64")).alias("architectures"), F.lit(None).cast("array<string>").alias("install_types"), F.concat(F.lit(">=3."), low, F.lit(" <3."), low + 2).alias("host_range"),
        F.when(size % 5 != 0, ">=0.5 <4.5").alias("part_range"), F.when(pk % 31 == 0, "DEPRECATED").otherwise(_pick(_STATUS_OF, id % 6)).alias("status"), F.when(size % 7 == 0, "1.5").alias("minimum"), F.when(size % 11 == 0, "3.1").alias("tested"),
        (pk % 2 == 0).alias("hard"), F.lit(False).alias("sample"), (TODAY - pk % 120).cast("int").alias("checked"),
    )
    proof = lambda change, source, url, age: [pk.alias("rule"), change.alias("change"), source.alias("source"), *[F.lit(t).alias(t) for t in _PROOF], url.alias("url"), (TODAY - age).cast("int").alias("checked")]
    none, address = F.lit(None).cast("string"), F.concat(F.lit("https://x.test/"), pk)
    evidence = (
        part.select(*proof(none, _pick(_SOURCES, size % 6), F.when(pk % 41 == 0, "http://x.test/").otherwise(address), pk % 100))
        .unionByName(part.filter(pk % 3 == 0).select(*proof(none, F.lit("repository"), address, pk % 50)))
        .unionByName(part.filter((pk % 17 == 0) & (pk % 4 != 1)).select(*proof(F.lit("api"), F.lit("community"), address, pk % 60)))
    )
    changes = part.filter(pk % 17 == 0).select(pk.alias("rule"), F.lit("api").alias("change"), F.lit(">=3.2").alias("range"), (pk % 3 == 0).alias("resolved"), F.lit(False).alias("hard"))
    asked = lambda test, field, wanted, of: part.filter(of).select(pk.alias("rule"), F.lit(test).alias("test"), F.lit(field).cast("string").alias("field"), _texts(wanted).alias("wanted"))
    requirements = asked("range", "os", ">=9", size % 13 == 0).unionByName(asked("native", None, "rosetta", size % 17 == 0)).unionByName(asked("formats", None, "vst3", size % 19 == 0))
    order = Window.partitionBy("stack").orderBy("line")
    placed = lines.select("stack", "id", "pk", "line", F.lead("id").over(order).alias("next"), F.first("id").over(order).alias("first"))
    depends = placed.select("stack", "id", F.when(F.col("next").isNotNull() & (F.col("pk") % 3 == 0), F.col("next")).when(F.col("next").isNull() & (F.col("stack") % 5 == 0) & (F.col("first") != F.col("id")), F.col("first")).when(F.col("pk") % 43 == 0, 999).alias("needs"),
        F.when(F.col("pk") % 6 == 0, ">=1").alias("range"), (F.col("pk") % 23 == 0).alias("optional")).filter("needs IS NOT NULL")
    return {"parts": parts, "targets": targets, "rules": rules, "evidence": evidence, "changes": changes, "requirements": requirements, "depends": depends}


_FOUND = """WITH RECURSIVE p AS (SELECT l_orderkey AS stack, l_linenumber AS ln, max(l_partkey) AS pk, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY ALL),
    parts AS (SELECT *, ln * 10 + pk % 10 AS id, CASE WHEN q % 11 <> 0 THEN q END AS v, pk % 29 = 0 AS ignored, lead(ln * 10 + pk % 10) OVER w AS nxt, first_value(ln * 10 + pk % 10) OVER w AS fst FROM p WINDOW w AS (PARTITION BY stack ORDER BY ln)),
    targets AS (SELECT o_orderkey AS stack, o_custkey % 4 AS t, o_custkey % 37 = 0 AS down, o_orderkey % 3 AS pf, o_orderkey % 4 = 3 AS arm, CASE WHEN o_orderkey % 13 <> 0 THEN 8 + o_orderkey % 4 END AS os FROM orders),
    rules AS (SELECT p_partkey AS rule, (p_partkey % 7 + 1) * 10 + p_partkey % 10 AS id, p_size AS s, p_size % 3 AS lo, p_size % 5 <> 0 AS ranged, CASE WHEN p_partkey % 31 = 0 THEN 4 ELSE [1, 1, 1, 2, 3, 7][((p_partkey % 7 + 1) * 10 + p_partkey % 10) % 6 + 1] END AS status,
        p_size % 7 = 0 AS has_min, p_size % 11 = 0 AS tested, p_partkey % 2 = 0 AS hard, p_partkey % 120 AS age FROM part),
    ev AS (SELECT rule, max(rank) AS rank, max(age) AS ev_age, bool_or(rank NOT IN (1, 3)) AS firm FROM (SELECT p_partkey AS rule, [7, 6, 5, 4, 3, 1][p_size % 6 + 1] AS rank, p_partkey % 100 AS age FROM part WHERE p_partkey % 41 <> 0
        UNION ALL SELECT p_partkey, 5, p_partkey % 50 FROM part WHERE p_partkey % 3 = 0) GROUP BY rule),
    met AS (SELECT p.stack, p.id, r.rule, r.status, r.age, r.has_min, NOT ranged OR coalesce(v >= 5 AND v < 45, false) AS exact FROM parts p JOIN targets t ON t.stack = p.stack
        JOIN rules r ON r.id = p.id AND (s % 3 = 0 OR s % 3 = 1 AND pf < 2 OR s % 3 = 2 AND pf = 2) AND (s % 2 = 1 OR NOT arm) AND t >= lo AND t < lo + 2),
    kept AS (SELECT * FROM (SELECT *, bool_or(exact) OVER (PARTITION BY stack, id) AS any_exact FROM met) WHERE CASE WHEN any_exact THEN exact ELSE has_min END),
    chosen AS (SELECT stack, id, CASE WHEN count(DISTINCT status) = 1 THEN arg_min(rule, age * 1000000 + rule) END AS rule FROM kept GROUP BY ALL),
    one AS (SELECT p.*, t.t, t.pf, t.arm, t.os, c.rule, c.stack IS NOT NULL AS any_rule, r.status, r.s, r.ranged, r.has_min, r.tested, r.hard AS rule_hard, r.age AS rule_age, e.rank, e.ev_age, coalesce(e.firm, false) AS firm, e.rule IS NOT NULL AS proven,
        coalesce(c.rule % 17 = 0 AND c.rule % 4 <> 1 AND t >= 2, false) AS hit, c.rule % 3 = 0 AS resolved,
        coalesce(s % 17 = 0 AND arm AND pf = 1, false) AS rosetta, CASE WHEN s % 13 = 0 AND os < 9 THEN 7 WHEN s % 13 = 0 AND os IS NULL OR s % 19 = 0 THEN 6 WHEN s % 17 = 0 AND arm AND pf = 1 THEN 2 ELSE 0 END AS req
        FROM parts p JOIN targets t USING (stack) LEFT JOIN chosen c ON c.stack = p.stack AND c.id = p.id LEFT JOIN rules r ON r.rule = c.rule LEFT JOIN ev e ON e.rule = c.rule),
    two AS (SELECT *, firm AND hit AS broke, CASE WHEN NOT has_min THEN status WHEN v IS NULL THEN 6 WHEN v < 15 THEN greatest(status, 5) ELSE status END AS aged, ranged AND NOT coalesce(v >= 5 AND v < 45, false) AS outside,
        pk % 97 = 0 AND pf <> 1 OR pk % 53 = 0 AND NOT arm AS mismatch FROM one),
    three AS (SELECT *, greatest(CASE WHEN outside AND aged <> 5 THEN 6 ELSE aged END, req) AS asked FROM two),
    four AS (SELECT *, asked = 1 AND tested AND t > 1 AS beyond FROM three),
    five AS (SELECT *, CASE WHEN mismatch THEN 7 WHEN firm THEN greatest(CASE WHEN beyond THEN 6 ELSE asked END, CASE WHEN broke THEN CASE WHEN resolved THEN 2 ELSE 7 END ELSE 0 END) ELSE 6 END AS sev,
        CASE WHEN rule IS NOT NULL THEN greatest(rule_age, coalesce(ev_age, 0), CASE WHEN broke THEN rule % 60 ELSE 0 END) END AS age FROM four),
    six AS (SELECT *, proven AND age > 90 AS stale, CASE WHEN NOT proven OR age > 90 OR sev = 6 OR greatest(rank, CASE WHEN broke THEN 3 ELSE 0 END) < 4 THEN 2 WHEN greatest(rank, CASE WHEN broke THEN 3 ELSE 0 END) >= 6 THEN 0 ELSE 1 END AS conf,
        mismatch OR firm AND rule_hard AS hard, broke AND NOT resolved AS unresolved FROM five),
    dep AS (SELECT stack, id, CASE WHEN nxt IS NOT NULL AND pk % 3 = 0 THEN nxt WHEN nxt IS NULL AND stack % 5 = 0 AND fst <> id THEN fst WHEN pk % 43 = 0 THEN 999 END AS needs, pk % 6 = 0 AS ranged FROM parts WHERE pk % 23 <> 0),
    link AS (SELECT d.stack, d.id, d.needs, n.id IS NULL OR n.ignored AS missing, CASE WHEN n.id IS NULL OR n.ignored THEN 7 WHEN d.ranged AND n.v IS NULL THEN 6 WHEN d.ranged AND n.v < 10 THEN 7 ELSE 0 END AS flag
        FROM dep d LEFT JOIN parts n ON n.stack = d.stack AND n.id = d.needs WHERE d.needs IS NOT NULL),
    own AS (SELECT s.* EXCLUDE (sev, conf), greatest(sev, coalesce(flag, 0)) AS sev, CASE WHEN flag = 6 THEN 2 ELSE conf END AS conf, coalesce(missing, false) AS missing, coalesce(flag > 0 AND NOT missing, false) AS misfit FROM six s LEFT JOIN link l USING (stack, id)),
    edge AS (SELECT stack, id, needs FROM link WHERE NOT missing), reach AS (SELECT * FROM edge UNION SELECT r.stack, r.id, e.needs FROM reach r JOIN edge e ON e.stack = r.stack AND e.id = r.needs),
    dated AS (SELECT e.* FROM edge e JOIN own a ON a.stack = e.stack AND a.id = e.id AND a.age IS NOT NULL JOIN own b ON b.stack = e.stack AND b.id = e.needs AND b.age IS NOT NULL),
    back AS (SELECT * FROM dated UNION SELECT r.stack, r.id, e.needs FROM back r JOIN dated e ON e.stack = r.stack AND e.id = r.needs),
    ages AS (SELECT b.stack, b.id, max(o.age) AS m FROM back b JOIN own o ON o.stack = b.stack AND o.id = b.needs GROUP BY ALL),
    got AS (SELECT r.stack, r.id, max(CASE WHEN sev >= 6 THEN sev WHEN sev >= 2 OR stale THEN 2 ELSE 0 END) AS tells, bool_or(hard) AS hard, bool_or(unresolved) AS unresolved, max(conf) AS conf, bool_or(stale) AS stale FROM reach r JOIN own o ON o.stack = r.stack AND o.id = r.needs GROUP BY ALL),
    found AS (SELECT o.stack, o.id, o.ln, o.ignored, greatest(o.sev, coalesce(g.tells, 0)) AS sev, greatest(o.conf, coalesce(g.conf, 0)) AS conf, CASE WHEN o.age IS NOT NULL THEN greatest(o.age, coalesce(a.m, 0)) END AS age, o.stale OR coalesce(g.stale, false) AS stale,
        o.hard OR coalesce(g.hard, false) AS hard, o.unresolved OR coalesce(g.unresolved, false) AS unresolved, list_sort(list_filter([CASE WHEN any_rule AND rule IS NULL THEN 'conflictingEvidence' END, CASE WHEN NOT any_rule THEN 'noRecord' END, CASE WHEN rule IS NOT NULL AND NOT firm THEN 'noVerifiedEvidence' END,
        CASE WHEN firm THEN 'record' END, CASE WHEN firm AND has_min AND v IS NULL THEN 'missingComponentVersion' END, CASE WHEN firm AND has_min AND v < 15 THEN 'minimumVersion' END, CASE WHEN firm AND outside AND aged <> 5 THEN 'componentRange' END, CASE WHEN firm AND req = 6 THEN 'missingRequirement' END,
        CASE WHEN firm AND req = 7 THEN 'runtimeRequirement' END, CASE WHEN firm AND rosetta THEN 'rosetta' END, CASE WHEN firm AND beyond THEN 'beyondTested' END, CASE WHEN broke THEN 'breakingChange' END, CASE WHEN o.stale THEN 'stale' END, CASE WHEN mismatch THEN 'inventoryMismatch' END,
        CASE WHEN missing THEN 'missingDependency' END, CASE WHEN misfit THEN 'dependencyVersion' END, CASE WHEN g.tells > 0 THEN 'dependencyStatus' END], lambda x: x IS NOT NULL)) AS reasons
        FROM own o LEFT JOIN got g USING (stack, id) LEFT JOIN ages a USING (stack, id))"""
_NAMES = "[" + ", ".join(f"'{name}'" for name, _, _ in compatibility.STATUSES) + "]"
_WEIGHTS = "[" + ", ".join(str(w) for _, _, w in compatibility.STATUSES) + "]"


@query(
    f"""{_FOUND} SELECT stack, id, {_NAMES}[sev + 1] AS status, ['HIGH', 'MEDIUM', 'LOW'][conf + 1] AS confidence, CAST(age AS INTEGER) AS age, stale, hard, unresolved, array_to_string(reasons, ',') AS reasons FROM found"""
)
def preflight_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's status for the upgrade of its stack, with its reasons, after what it depends on."""
    found, _ = compatibility.preflight(today=TODAY, **_tables(spark, sf_dir))
    return compatibility.named(found).withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""{_FOUND}, sums AS (SELECT stack, count(*) AS n, count(*) FILTER (WHERE NOT ignored) AS na, coalesce(bool_or(NOT ignored AND sev = 7 AND ln % 2 = 1 AND hard), false) AS ch, coalesce(bool_or(NOT ignored AND unresolved), false) AS ub, coalesce(bool_or(NOT ignored AND sev = 7 AND ln % 2 = 1), false) AS cb,
        coalesce(bool_or(NOT ignored AND (sev > 1 OR stale)), false) AS act, max(conf) FILTER (WHERE NOT ignored) AS weakest, sum({_WEIGHTS}[sev + 1] + CASE WHEN stale THEN 10 ELSE 0 END) FILTER (WHERE NOT ignored) AS w FROM found GROUP BY stack),
    told AS (SELECT t.stack, list_filter([CASE WHEN down THEN 'downgrade' END, CASE WHEN coalesce(na, 0) = 0 THEN 'emptyStack' END, CASE WHEN coalesce(na, 0) = 0 THEN 'noApplicable' END, CASE WHEN coalesce(n > na, false) THEN 'excluded' END], lambda x: x IS NOT NULL) AS warnings, s.* EXCLUDE (stack)
        FROM targets t LEFT JOIN sums s ON s.stack = t.stack),
    ruled AS (SELECT *, CASE WHEN ch THEN 'critical-hard-blocker' WHEN ub THEN 'unresolved-break' WHEN cb THEN 'critical-blocker' WHEN len(warnings) > 0 THEN 'incomplete-or-excluded' WHEN act THEN 'component-action' ELSE 'verified-stack' END AS rule FROM told)
    SELECT stack, CASE rule WHEN 'critical-hard-blocker' THEN 'BLOCKED' WHEN 'unresolved-break' THEN 'WAIT' WHEN 'critical-blocker' THEN 'WAIT' WHEN 'verified-stack' THEN 'READY' ELSE 'CAUTION' END AS verdict, rule,
        CASE WHEN len(warnings) > 0 THEN 'LOW' ELSE ['HIGH', 'MEDIUM', 'LOW'][coalesce(weakest, 2) + 1] END AS confidence, CASE WHEN coalesce(na, 0) > 0 THEN least(100, CAST(floor(w / na + 0.5) AS INTEGER)) ELSE 100 END AS risk, array_to_string(warnings, ',') AS warnings FROM ruled"""
)
def preflight_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stack's verdict: the first rule of the table of verdicts that holds of its parts."""
    _, stacks = compatibility.preflight(today=TODAY, **_tables(spark, sf_dir))
    return stacks.drop("counts").withColumn("warnings", F.array_join("warnings", ","))
