"""Rules over nested documents: each rule has a document that passes and one that it fails."""

import copy
import json

import pytest

from loamworks.operators import seeds

TYPES = [("ai", "app")]
PROPERTIES = [("ai", p, k, u, v) for p, k, u, v in [
    ("size", "number", None, None), ("context", "tokens", None, None), ("price", "money", None, None), ("fee", "money", "USD", None), ("launched", "date", None, None), ("open", "bool", None, None), ("langs", "list", None, None), ("site", "url", None, None),
    ("tier", "enum", None, ["free", "paid"]), ("note", "text", None, None), ("latest_version", "text", None, None),
]]
FACT = {"ver": "OFFICIAL", "src": "src:a"}
GOOD = {
    "schema": "seed/1", "vertical": "ai",
    "sources": [{"id": "src:a", "kind": "OFFICIAL", "url": "https://x.test/", "retrieved": "2026-01-02"}, {"id": "src:m", "kind": "MANUAL_SOURCE", "retrieved": "2026-01-02"}],
    "entities": [
        {"id": "app:one", "type": "app", "slug": "one", "names": {"en": "One", "ko": "하나"}, "description": {"en": "A thing"}, "aliases": ["uno"], "names_src": {"ko": "src:a"}, "aliases_src": {"uno": "src:a"}, "regions": ["KR", "*"],
         "official_urls": [{"url": "https://x.test/", "label": "Site"}],
         "facts": [{**FACT, "p": "size", "v": 3}, {**FACT, "p": "context", "v": 3.5}, {**FACT, "p": "price", "v": 3, "unit": "USD"}, {**FACT, "p": "fee", "v": 0}, {**FACT, "p": "launched", "v": "2026-01"}, {**FACT, "p": "open", "v": True},
                   {**FACT, "p": "langs", "v": ["a", ""]}, {**FACT, "p": "site", "v": "http://x.test"}, {**FACT, "p": "tier", "v": "free", "region": "EU", "platform": "web", "plan": "app:one", "from": "2026"}, {**FACT, "p": "note", "v": "t"},
                   {**FACT, "p": "latest_version", "v": "1.0", "only_if_newer": True}],
         "relations": [{"p": "part_of", "o": "app:other", "src": "src:a", "ver": "OFFICIAL"}], "versions": [{"version": "1.0", "released": "2026-01-02", "notes_url": "https://x.test/n", "src": "src:a"}]},
        {"id": "app:other", "facts": []},
    ],
    "events": [{"kind": "release", "title": {"en": "Out"}, "starts": "2026-01-02T10:00:00Z", "ends": "2026-01", "entities": ["app:one"], "url": "https://x.test/e", "region": "KR", "ver": "OFFICIAL", "src": "src:a"}],
    "availability": [{"entity": "app:one", "plan": "app:one", "platform": "ios", "region": "KR", "state": "available", "from": "2026", "ver": "OFFICIAL", "src": "src:a"}],
    "compatibility": [{"subject": "app:one", "target": "app:other", "status": "works", "env": {"b": 1, "a": "x"}, "ver": "OFFICIAL", "src": "src:a"}],
}
OTHER = {"schema": "seed/1", "vertical": "ai", "sources": [], "entities": [{"id": "app:other", "type": "app", "slug": "other", "names": {"en": "Other"}}]}
GONE = object()
E, R, V, EV, AV, CO = "entity app:one", "relations", "versions", "event Out", "availability app:one", "compatibility app:one"
#: name: (path into the good document, new value or GONE, errors)
BAD = {
    "schema": (["schema"], "seed/0", ["document: schema not known"]), "vertical": (["vertical"], "cars", ["document: vertical not known"]), "source id": (["sources", 1, "id"], "m", ["source m: id invalid"]),
    "source kind": (["sources", 0, "kind"], "BLOG", ["source src:a: kind not known"]), "source without url": (["sources", 0, "url"], GONE, ["source src:a: url required"]), "manual source's url": (["sources", 1, "url"], "x", ["source src:m: url invalid"]),
    "retrieved": (["sources", 0, "retrieved"], "2026-1", ["source src:a: retrieved must be a day"]), "source twice": (["sources", 1], GOOD["sources"][0], ["source src:a: id twice"]),
    "entity id": (["entities", 1, "id"], "App", ["entity App: id invalid", "entity App: type must be the id's prefix", "entity App: type not defined for the vertical", "entity App: slug invalid", "entity App: names.en required"]),
    "type": (["entities", 0, "type"], "plan", [f"{E}: type must be the id's prefix", f"{E}: type not defined for the vertical"]), "slug": (["entities", 0, "slug"], "One", [f"{E}: slug invalid"]), "names": (["entities", 0, "names"], {"ko": "하나"}, [f"{E}: names.en required"]),
    "long name": (["entities", 0, "names", "en"], "x" * 2001, [f"{E}: names.en required"]), "description": (["entities", 0, "description"], {"fr": "x"}, [f"{E}: description must be texts by locale"]), "aliases": (["entities", 0, "aliases"], ["uno", " "], [f"{E}: aliases must be texts"]),
    "names_src": (["entities", 0, "names_src"], "src:a", [f"{E}: names_src must map locales to sources"]), "names_src without name": (["entities", 0, "names_src"], {"ja": "src:a"}, [f"{E} name source ja: locale without a name"]),
    "names_src unknown": (["entities", 0, "names_src"], {"ko": "src:z"}, [f"{E} name source ko: unknown source src:z"]), "aliases_src": (["entities", 0, "aliases_src"], [], [f"{E}: aliases_src must map aliases to sources"]),
    "aliases_src without alias": (["entities", 0, "aliases_src"], {"due": "src:a"}, [f"{E} alias source due: no such alias"]), "regions": (["entities", 0, "regions"], ["KR", "Korea"], [f"{E}: regions invalid"]),
    "official url": (["entities", 0, "official_urls", 0, "url"], "ftp://x", [f"{E} url ftp://x: url invalid"]), "official label": (["entities", 0, "official_urls", 0, "label"], GONE, [f"{E} url https://x.test/: label required"]),
    "number": (["entities", 0, "facts", 0, "v"], "3", [f"{E} fact size: number expected"]), "tokens": (["entities", 0, "facts", 1, "v"], True, [f"{E} fact context: number expected"]), "amount": (["entities", 0, "facts", 2, "v"], -1, [f"{E} fact price: amount expected"]),
    "currency": (["entities", 0, "facts", 2, "unit"], "usd", [f"{E} fact price: currency required"]), "date": (["entities", 0, "facts", 4, "v"], "Jan", [f"{E} fact launched: date expected"]), "bool": (["entities", 0, "facts", 5, "v"], "yes", [f"{E} fact open: boolean expected"]),
    "list": (["entities", 0, "facts", 6, "v"], ["a", 1], [f"{E} fact langs: list of texts expected"]), "fact url": (["entities", 0, "facts", 7, "v"], "x.test", [f"{E} fact site: url expected"]), "enum": (["entities", 0, "facts", 8, "v"], "gold", [f"{E} fact tier: not one of the property's values"]),
    "text": (["entities", 0, "facts", 9, "v"], 1, [f"{E} fact note: text expected"]), "no value": (["entities", 0, "facts", 9, "v"], "", [f"{E} fact note: value required"]), "null value": (["entities", 0, "facts", 0, "v"], None, [f"{E} fact size: value required", f"{E} fact size: number expected"]),
    "property": (["entities", 0, "facts", 0, "p"], "weight", [f"{E} fact weight: property not defined for the vertical"]), "only_if_newer": (["entities", 0, "facts", 10, "only_if_newer"], "yes", [f"{E} fact latest_version: only_if_newer must be a boolean"]),
    "only_if_newer elsewhere": (["entities", 0, "facts", 0, "only_if_newer"], True, [f"{E} fact size: only_if_newer on what is no version"]), "fact ver": (["entities", 0, "facts", 0, "ver"], "SURE", [f"{E} fact size: ver not known"]),
    "fact without source": (["entities", 0, "facts", 0, "src"], GONE, [f"{E} fact size: src required"]), "fact source": (["entities", 0, "facts", 0, "src"], "src:z", [f"{E} fact size: unknown source src:z"]), "region": (["entities", 0, "facts", 8, "region"], "eu", [f"{E} fact tier: region invalid"]),
    "platform": (["entities", 0, "facts", 8, "platform"], "tv", [f"{E} fact tier: platform not known"]), "plan": (["entities", 0, "facts", 8, "plan"], "app:zero", [f"{E} fact tier: unknown entity app:zero"]), "from": (["entities", 0, "facts", 8, "from"], "now", [f"{E} fact tier: from must be a date"]),
    "plan id": (["entities", 0, "facts", 8, "plan"], "Pro", [f"{E} fact tier: plan must be an id", f"{E} fact tier: unknown entity Pro"]), "predicate": (["entities", 0, R, 0, "p"], "likes", [f"{E} relation likes: predicate not known"]), "object": (["entities", 0, R, 0, "o"], "app:zero", [f"{E} relation part_of: unknown entity app:zero"]),
    "relation source": (["entities", 0, R, 0, "src"], "src:z", [f"{E} relation part_of: unknown source src:z"]), "relation ver": (["entities", 0, R, 0, "ver"], "SURE", [f"{E} relation part_of: ver not known"]), "version": (["entities", 0, V, 0, "version"], "", [f"{E} version : version required"]),
    "released": (["entities", 0, V, 0, "released"], "soon", [f"{E} version 1.0: released must be a date"]), "notes": (["entities", 0, V, 0, "notes_url"], "n", [f"{E} version 1.0: notes_url invalid"]), "event kind": (["events", 0, "kind"], "party", [f"{EV}: kind not known"]),
    "event title": (["events", 0, "title"], {"ko": "x"}, ["event ?: title.en required"]), "starts": (["events", 0, "starts"], "2026-01-02T10", [f"{EV}: starts must be a date or time"]), "ends": (["events", 0, "ends"], "x", [f"{EV}: ends must be a date or time"]),
    "event entities": (["events", 0, "entities"], [], [f"{EV}: entities required"]), "event entity": (["events", 0, "entities"], ["app:one", "app:zero"], [f"{EV}: unknown entity app:zero"]), "event url": (["events", 0, "url"], "x", [f"{EV}: url invalid"]), "event region": (["events", 0, "region"], "x", [f"{EV}: region invalid"]),
    "event ver": (["events", 0, "ver"], GONE, [f"{EV}: ver not known"]), "state": (["availability", 0, "state"], "soon", [f"{AV}: state not known"]), "availability entity": (["availability", 0, "entity"], "app:zero", ["availability app:zero: unknown entity app:zero"]),
    "availability ver": (["availability", 0, "ver"], "SURE", [f"{AV}: ver not known"]), "availability twice": (["availability"], GOOD["availability"] * 2, [f"{AV}: the same plan, platform and region twice"]), "status": (["compatibility", 0, "status"], "fine", [f"{CO}: status not known"]),
    "env": (["compatibility", 0, "env"], "x", [f"{CO}: env must be an object"]), "subject": (["compatibility", 0, "subject"], GONE, ["compatibility ?: subject required"]), "target": (["compatibility", 0, "target"], "app:zero", [f"{CO}: unknown entity app:zero"]),
    "compatibility twice": (["compatibility"], [GOOD["compatibility"][0], GOOD["compatibility"][0] | {"env": {"a": "x", "b": 1}}], [f"{CO}: the same versions and env twice"]), "compatibility ver": (["compatibility", 0, "ver"], None, [f"{CO}: ver not known"]),
    "slug twice": (["entities", 1], GOOD["entities"][0] | {"id": "app:two", "facts": [], "relations": [], "versions": [], "official_urls": []}, ["entity app:two: slug twice"]),
    "source ver": (["sources"], GOOD["sources"] + [{"id": "src:n", "kind": "FEED", "url": "https://u:p@x.test/", "retrieved": "2026-01-02"}], ["source src:n: url required", "source src:n: url invalid"]),
}


def changed(path, value):
    doc = copy.deepcopy(GOOD)
    at = doc
    for key in path[:-1]:
        at = at[key]
    if value is GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


@pytest.fixture(scope="module")
def found(spark):
    docs = {"good": GOOD, "other": OTHER} | {name: changed(path, value) for name, (path, value, _) in BAD.items()}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("a text", '"x"'), ("broken", "{"), ("null", None), ("a list", "[]"), ("many", json.dumps(GOOD | {"events": [{"kind": "party", "title": {"en": "Out"}, "entities": ["app:one"], "ver": "OFFICIAL", "src": "src:a"}] * 250}))]
    frame = lambda r, s: spark.createDataFrame(r, s)
    out = seeds.errors(frame(rows, "document string, body string"), frame(TYPES, "vertical string, type string"), frame(PROPERTIES, "vertical string, property string, type string, unit string, values array<string>"), "seed/1").collect()
    by = {}
    for r in sorted(out):
        by.setdefault(r["document"], []).append(r["error"])
    return by


def test_good_documents_pass(found):
    assert "good" not in found and "other" not in found


@pytest.mark.parametrize("name", list(BAD))
def test_rule(found, name):
    assert found[name] == BAD[name][2]


def test_what_is_no_object_and_the_limit(found):
    assert all(found[k] == ["document: must be an object"] for k in ("a text", "broken", "null", "a list"))
    assert found["many"] == ["event Out: kind not known"] * 200


def test_every_rule_has_a_case():
    told = {e.split(": ", 1)[1] for _, _, errors in BAD.values() for e in errors}
    assert {message for *_, message in seeds.RULES} | {message for *_, message in seeds.UNIQUE} <= told
