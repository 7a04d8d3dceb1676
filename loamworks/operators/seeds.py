"""Checks of nested source documents by rules that are rows: every node of a document is tested, references are anti joins, repeats are counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.operators import graph

#: Vocabularies and patterns of the documents.
LOCALES = ("en", "ko", "ja")
VERTICALS = ("ai", "games", "hardware", "studio", "subculture")
VERIFICATION = ("OFFICIAL", "AUTOMATED", "COMMUNITY_VERIFIED", "ESTIMATE", "COMMUNITY", "DISPUTED", "UNKNOWN")
SOURCE_KINDS = ("OFFICIAL", "OFFICIAL_API", "FEED", "CURATED", "COMMUNITY", "MANUAL_SOURCE", "ESTIMATE_METHOD")
COMPAT_STATUS = ("supported", "works", "works_with_issues", "broken", "unsupported", "unverified_after_update", "unknown")
AVAILABILITY = ("available", "rolling_out", "preview", "limited", "unavailable", "deprecated", "unknown")
EVENT_KINDS = ("release", "event", "collab", "popup", "merch_release", "broadcast", "exhibition", "sale", "update", "incident", "other")
PLATFORMS = ("web", "ios", "android", "windows", "macos", "linux", "api", "*")
PREDICATES = (
    "made_by", "offers", "has_plan", "includes_model", "part_of", "successor_of", "variant_of", "runs_on", "developed_by", "published_by", "translates", "supports_host", "belongs_to", "appears_in", "voiced_by", "produced_by", "created_by", "adapted_from",
    "merchandise_of", "collab_with", "related_to",
)
VERSION_PROPERTIES = ("latest_version", "current_build", "current_version", "latest_driver", "patch_version")
ENTITY_ID = r"^[a-z_]+:[a-z0-9][a-z0-9.-]{0,95}$"
SOURCE_ID = r"^src:[a-z0-9][a-z0-9._-]{0,120}$"
SLUG = r"^[a-z0-9][a-z0-9-]{0,95}$"
DAY, DATE = r"^\d{4}-\d\d-\d\d$", r"^\d{4}(-\d\d(-\d\d)?)?$"
TIME = r"^\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d)?(Z|[+-]\d\d:\d\d))?)?)?$"
REGION = r"^(\*|GLOBAL|EEA|EU|[A-Z]{2})$"
CURRENCY = r"^[A-Z]{3}$"
URL = r"(?i)^https?://[^\s/?#@\\]+([/?#]\S*)?$"

#: (kind of node, field, when it is tested, test, what it asks for, message). A field is tested always, only where it is given, or where a condition of ``_conditions`` holds.
RULES = (
    ("document", "schema", "always", "is", "schema", "schema not known"),
    ("document", "vertical", "always", "one_of", VERTICALS, "vertical not known"),
    ("source", "id", "always", "pattern", SOURCE_ID, "id invalid"),
    ("source", "kind", "always", "one_of", SOURCE_KINDS, "kind not known"),
    ("source", "url", "linked", "pattern", URL, "url required"),
    ("source", "url", "given", "pattern", URL, "url invalid"),
    ("source", "retrieved", "always", "pattern", DAY, "retrieved must be a day"),
    ("entity", "id", "always", "pattern", ENTITY_ID, "id invalid"),
    ("entity", "type", "whole", "prefix", "id", "type must be the id's prefix"),
    ("entity", "type", "whole", "declared", "types", "type not defined for the vertical"),
    ("entity", "slug", "whole", "pattern", SLUG, "slug invalid"),
    ("entity", "names", "whole", "label", ("en",), "names.en required"),
    ("entity", "description", "given", "label", (), "description must be texts by locale"),
    ("entity", "names_src", "given", "object", None, "names_src must map locales to sources"),
    ("entity", "aliases_src", "given", "object", None, "aliases_src must map aliases to sources"),
    ("entity", "aliases", "given", "texts", 120, "aliases must be texts"),
    ("entity", "regions", "given", "all", REGION, "regions invalid"),
    ("url", "url", "always", "pattern", URL, "url invalid"),
    ("url", "label", "always", "string", None, "label required"),
    ("name source", "key", "always", "key of", "names", "locale without a name"),
    ("alias source", "key", "always", "within", "aliases", "no such alias"),
    ("fact", "only_if_newer", "given", "boolean", None, "only_if_newer must be a boolean"),
    ("fact", "p", "only if newer", "one_of", VERSION_PROPERTIES, "only_if_newer on what is no version"),
    ("fact", "p", "always", "declared", "properties", "property not defined for the vertical"),
    ("fact", "v", "always", "value", None, "value required"),
    ("fact", "v", "number", "number", None, "number expected"),
    ("fact", "v", "tokens", "number", None, "number expected"),
    ("fact", "v", "money", "amount", None, "amount expected"),
    ("fact", "unit", "money without unit", "pattern", CURRENCY, "currency required"),
    ("fact", "v", "date", "pattern", DATE, "date expected"),
    ("fact", "v", "bool", "boolean", None, "boolean expected"),
    ("fact", "v", "list", "texts", 10**9, "list of texts expected"),
    ("fact", "v", "url", "pattern", URL, "url expected"),
    ("fact", "v", "enum", "choice", None, "not one of the property's values"),
    ("fact", "v", "text", "string", None, "text expected"),
    ("fact", "ver", "always", "one_of", VERIFICATION, "ver not known"),
    ("relation", "p", "always", "one_of", PREDICATES, "predicate not known"),
    ("relation", "ver", "given", "one_of", VERIFICATION, "ver not known"),
    ("version", "version", "always", "text", None, "version required"),
    ("version", "released", "given", "pattern", DATE, "released must be a date"),
    ("version", "notes_url", "given", "pattern", URL, "notes_url invalid"),
    ("event", "kind", "always", "one_of", EVENT_KINDS, "kind not known"),
    ("event", "title", "always", "label", ("en",), "title.en required"),
    ("event", "starts", "given", "pattern", TIME, "starts must be a date or time"),
    ("event", "ends", "given", "pattern", TIME, "ends must be a date or time"),
    ("event", "entities", "always", "some", None, "entities required"),
    ("event", "url", "given", "pattern", URL, "url invalid"),
    ("event", "ver", "always", "one_of", VERIFICATION, "ver not known"),
    ("availability", "state", "always", "one_of", AVAILABILITY, "state not known"),
    ("availability", "ver", "always", "one_of", VERIFICATION, "ver not known"),
    ("compatibility", "status", "always", "one_of", COMPAT_STATUS, "status not known"),
    ("compatibility", "env", "given", "object", None, "env must be an object"),
    ("compatibility", "ver", "always", "one_of", VERIFICATION, "ver not known"),
    *((kind, "region", "given", "pattern", REGION, "region invalid") for kind in ("fact", "availability", "event")),
    *((kind, "platform", "given", "one_of", PLATFORMS, "platform not known") for kind in ("fact", "availability")),
    *((kind, "plan", "given", "pattern", ENTITY_ID, "plan must be an id") for kind in ("fact", "availability")),
    *((kind, "from", "given", "pattern", DATE, "from must be a date") for kind in ("fact", "availability")),
)
#: (kind of node, field, what it names, whether it must be there).
REFERENCES = (
    ("fact", "src", "source", True), ("fact", "plan", "entity", False), ("relation", "o", "entity", True), ("relation", "src", "source", False), ("version", "src", "source", True), ("event", "src", "source", True), ("event", "entities", "entity", False),
    ("availability", "entity", "entity", True), ("availability", "plan", "entity", False), ("availability", "src", "source", True), ("compatibility", "subject", "entity", True), ("compatibility", "target", "entity", True), ("compatibility", "src", "source", True),
    ("name source", "value", "source", True), ("alias source", "value", "source", True),
)
#: (kind of node, fields of which no two nodes of a document may have the same, * where missing; message).
UNIQUE = (
    ("source", ("id",), "id twice"),
    ("entity", ("slug",), "slug twice"),
    ("availability", ("entity", "plan", "platform", "region"), "the same plan, platform and region twice"),
    ("compatibility", ("subject", "subject_version", "target", "target_version", "env"), "the same versions and env twice"),
)
#: (kind, list in the document or entity, its place, what a node is called by).
_LISTS = (("source", "sources", 1, "id"), ("entity", "entities", 2, "id"), ("event", "events", 3, "title.en"), ("availability", "availability", 4, "entity"), ("compatibility", "compatibility", 5, "subject"))
_INNER = (("url", "official_urls", 1, "url"), ("fact", "facts", 4, "p"), ("relation", "relations", 5, "p"), ("version", "versions", 6, "version"))
_MAPS = (("name source", "names_src", 2), ("alias source", "aliases_src", 3))


def _at(node: Column, field: str) -> Column:
    return F.try_variant_get(node, f"$.{field}", "variant")


def _type(x: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, NUMBER or VOID; null where there is nothing."""
    t = F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    return F.when(t.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "INT"), "NUMBER").otherwise(t)


def _text(node: Column, field: str) -> Column:
    return F.try_variant_get(node, f"$.{field}", "string")


def nodes(documents: DataFrame) -> DataFrame:
    """(document, vertical, kind, place array<int>, label, node variant, around variant) of all nodes of JSON documents (document, body); places give the order in which they stand.

    ``around`` is the entity of what stands in one. A body that is no JSON object is one node of kind ``document`` with a null node.
    """
    doc = documents.select("document", F.try_parse_json("body").alias("doc"))
    doc = graph.settle(doc.select("document", F.when(_type(F.col("doc")) == "OBJECT", F.col("doc")).alias("doc")).withColumn("vertical", _text(F.col("doc"), "vertical")))
    none = F.lit(None).cast("variant")
    order = lambda *p: F.array(*[F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in p])
    frames = [doc.select("document", "vertical", F.lit("document").alias("kind"), order(0, 0, 0, 0).alias("place"), F.lit("document").alias("label"), F.col("doc").alias("node"), none.alias("around"))]
    entities = None
    for kind, field, k, name in _LISTS:
        found = doc.select("document", "vertical", F.posexplode(F.try_variant_get("doc", f"$.{field}", "array<variant>")).alias("i", "node"))
        label = F.concat(F.lit(f"{kind} "), F.coalesce(_text(F.col("node"), name), F.lit("?")))
        found = found.select("document", "vertical", F.lit(kind).alias("kind"), order(k, F.col("i"), 0, 0).alias("place"), label.alias("label"), "node", none.alias("around"))
        frames.append(found)
        entities = found if kind == "entity" else entities
    inner = entities.select("document", "vertical", F.col("place")[1].alias("i"), F.col("label").alias("outer"), F.col("node").alias("around"))
    for kind, field, k, name in _INNER:
        found = inner.select("*", F.posexplode(F.try_variant_get("around", f"$.{field}", "array<variant>")).alias("j", "node"))
        label = F.concat("outer", F.lit(f" {kind} "), F.coalesce(_text(F.col("node"), name), F.lit("?")))
        frames.append(found.select("document", "vertical", F.lit(kind).alias("kind"), order(2, F.col("i"), k, F.col("j")).alias("place"), label.alias("label"), "node", "around"))
    for kind, field, k in _MAPS:
        entries = F.array_sort(F.map_entries(F.try_variant_get("around", f"$.{field}", "map<string, string>")))
        found = inner.select("*", F.posexplode(entries).alias("j", "e"))
        node = F.parse_json(F.to_json(F.struct(F.col("e.key"), F.col("e.value"))))
        frames.append(found.select("document", "vertical", F.lit(kind).alias("kind"), order(2, F.col("i"), k, F.col("j")).alias("place"), F.concat("outer", F.lit(f" {kind} "), "e.key").alias("label"), node.alias("node"), "around"))
    return reduce(DataFrame.unionByName, frames)


def _holds(x: Column, test: str, wanted) -> Column:
    """Whether a value passes a test; what is missing passes none."""
    t = _type(x)
    text = F.when(t == "STRING", x.cast("string"))
    number = F.when(t == "NUMBER", x.cast("double"))
    listed = F.when(t == "ARRAY", F.try_variant_get(x, "$", "array<variant>"))
    if test == "pattern":
        return text.rlike(wanted)
    if test == "one_of":
        return text.isin(*wanted)
    if test == "label":
        by = F.when(t == "OBJECT", F.try_variant_get(x, "$", "map<string, variant>"))
        good = F.forall(F.map_entries(by), lambda e: e["key"].isin(*LOCALES) & (_type(e["value"]) == "STRING") & (F.trim(e["value"].cast("string")) != "") & (F.length(e["value"].cast("string")) <= 2000))
        return reduce(lambda a, k: a & F.map_contains_key(by, k), wanted, (F.size(by) > 0) & good)
    if test == "texts":
        return F.forall(listed, lambda v: (_type(v) == "STRING") & ((F.lit(wanted) == 10**9) | ((F.trim(v.cast("string")) != "") & (F.length(v.cast("string")) <= wanted))))
    if test == "all":
        return F.forall(listed, lambda v: (_type(v) == "STRING") & v.cast("string").rlike(wanted))
    simple = {
        "object": t == "OBJECT", "boolean": t == "BOOLEAN", "string": t == "STRING", "text": F.length(text) > 0, "number": t == "NUMBER", "amount": number >= 0, "some": F.size(listed) > 0, "value": (t != "VOID") & ~F.coalesce(text == "", F.lit(False)),
    }
    return simple[test]


def errors(documents: DataFrame, types: DataFrame, properties: DataFrame, schema: str, most: int | None = 200) -> DataFrame:
    """(document, n, error): what is wrong with each document, in the order in which it stands there, the first ``most`` of each (None: all).

    documents: (document, body), body JSON; types: (vertical, type); properties: (vertical, property, type, unit, values array<string>). Ids may be declared in any of the documents; an entity that
    another document declares may be given again in part, without names and slug. A document that is no object has one error. Rules are those of ``RULES``, ``REFERENCES`` and ``UNIQUE``.
    """
    all_nodes = graph.settle(nodes(documents))
    c = F.col
    ids = lambda kind: all_nodes.filter(c("kind") == kind).select("document", _text(c("node"), "id").alias("id"), (_at(c("node"), "names").isNotNull() | _at(c("node"), "slug").isNotNull()).alias("whole"))
    entity, source = ids("entity").filter("id IS NOT NULL"), ids("source").filter("id IS NOT NULL")
    # an id that others declare too may be given in part
    owners = entity.filter("whole").groupBy("id").agg(F.min("document").alias("low"), F.max("document").alias("high"))
    found = all_nodes.withColumn("_id", F.when(c("kind") == "entity", _text(c("node"), "id"))).join(owners, c("_id") == c("id"), "left").drop("id", "_id")
    elsewhere = (c("low") != c("document")) | (c("high") != c("document"))
    found = found.withColumn("whole", ~F.coalesce(elsewhere & _at(c("node"), "names").isNull() & _at(c("node"), "slug").isNull(), F.lit(False))).drop("low", "high")
    given = properties.select("vertical", c("property").alias("_p"), c("type").alias("_kind"), F.coalesce("unit", F.lit("")).alias("_unit"), c("values").alias("_values"))
    found = found.withColumn("_p", F.when(c("kind") == "fact", _text(c("node"), "p"))).join(given, ["vertical", "_p"], "left")
    found = found.withColumn("_t", F.when(c("kind") == "entity", _text(c("node"), "type"))).join(types.select("vertical", c("type").alias("_t"), F.lit(True).alias("_declared")), ["vertical", "_t"], "left")
    known_vertical = c("vertical").isin(*VERTICALS)
    kinds = ("number", "tokens", "money", "date", "bool", "list", "url", "enum")
    conditions = {
        "always": F.lit(True), "whole": c("whole"), "linked": ~F.coalesce(_text(c("node"), "kind").isin("MANUAL_SOURCE", "ESTIMATE_METHOD"), F.lit(False)), "only if newer": _at(c("node"), "only_if_newer").isNotNull(),
        "money without unit": (c("_kind") == "money") & (c("_unit") == ""), "text": c("_kind").isNotNull() & ~c("_kind").isin(*kinds), **{k: c("_kind") == k for k in kinds},
    }

    def fails(kind: str, field: str, when: str, test: str, wanted) -> Column:
        x = _at(c("node"), field)
        if test == "is":
            ok = _text(c("node"), field) == schema
        elif test == "declared":
            ok = ~known_vertical | (c("_declared") if wanted == "types" else c("_kind")).isNotNull()
        elif test == "prefix":
            ok = _text(c("node"), field) == F.substring_index(_text(c("node"), wanted), ":", 1)
        elif test == "choice":
            ok = F.array_contains("_values", _text(c("node"), field))
        elif test == "key of":
            ok = _text(c("node"), field).isin(*LOCALES) & F.map_contains_key(F.try_variant_get("around", f"$.{wanted}", "map<string, string>"), _text(c("node"), field))
        elif test == "within":
            ok = F.array_contains(F.try_variant_get("around", f"$.{wanted}", "array<string>"), _text(c("node"), field))
        else:
            ok = _holds(x, test, wanted)
        on = x.isNotNull() if when == "given" else F.coalesce(conditions[when], F.lit(False))
        return on & ~F.coalesce(ok, F.lit(False))

    broken, grouped = [], {}
    for k, (kind, *rule, message) in enumerate(RULES):
        grouped.setdefault(kind, []).append((k, rule, message))
    for kind, rules in grouped.items():
        tests = [F.when(fails(kind, *rule), F.struct(F.lit(k).alias("rule"), F.lit(message).alias("message"))) for k, rule, message in rules]
        if kind == "document":
            tests = [F.when(c("node").isNull(), F.struct(F.lit(-1).alias("rule"), F.lit("must be an object").alias("message"))), *[F.when(c("node").isNotNull(), t) for t in tests]]
        own = found.filter(c("kind") == kind).select("document", "place", "label", F.explode(F.array_compact(F.array(*tests))).alias("e"))
        broken.append(own.select("document", "place", "e.rule", F.concat("label", F.lit(": "), "e.message").alias("error")))
    asked = []
    for k, (kind, field, of, must) in enumerate(REFERENCES):
        node = all_nodes.filter(c("kind") == kind)
        many = F.try_variant_get("node", f"$.{field}", "array<string>") if field == "entities" else F.array(_text(c("node"), field))
        if not must:
            node = node.filter(_at(c("node"), field).isNotNull())
        asked.append(node.select("document", "place", "label", F.lit(1000 + k).alias("rule"), F.lit(of).alias("of"), F.lit(field).alias("field"), F.explode(many).alias("id")))
    declared = entity.select(F.lit("entity").alias("of"), "id").unionByName(source.select(F.lit("source").alias("of"), "id")).distinct()
    missing = reduce(DataFrame.unionByName, asked).join(declared, ["of", "id"], "left_anti")
    told = F.when(c("id").isNull(), F.concat("label", F.lit(": "), "field", F.lit(" required"))).otherwise(F.concat("label", F.lit(": unknown "), "of", F.lit(" "), "id"))
    broken.append(missing.select("document", "place", "rule", told.alias("error")))
    for k, (kind, fields, message) in enumerate(UNIQUE):
        node = (found.filter("whole") if kind == "entity" else all_nodes).filter(c("kind") == kind)
        key = [F.coalesce(_text(c("node"), f) if f != "env" else _env(c("node")), F.lit("*")).alias(f"_{f}") for f in fields]
        # the first stays; a key with many nodes is numbered after a shuffle by all of the key
        place = F.row_number().over(Window.partitionBy("document", *[f"_{f}" for f in fields]).orderBy("place"))
        again = node.select("document", "place", "label", *key).withColumn("_n", place).filter("_n > 1")
        broken.append(again.select("document", "place", F.lit(2000 + k).alias("rule"), F.concat("label", F.lit(f": {message}")).alias("error")))
    n = F.row_number().over(Window.partitionBy("document").orderBy("place", "rule", "error")).cast("bigint")
    out = reduce(DataFrame.unionByName, broken).withColumn("n", n)
    return (out if most is None else out.filter(c("n") <= most)).select("document", "n", "error")


def _env(node: Column) -> Column:
    """An environment's entries in the order of their keys; nothing for one that is empty or missing."""
    by = F.map_entries(F.try_variant_get(node, "$.env", "map<string, string>"))
    return F.coalesce(F.array_join(F.transform(F.array_sort(by), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";"), F.lit(""))
