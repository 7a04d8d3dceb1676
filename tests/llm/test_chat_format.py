"""Reply trees against plain walks, and formatted conversations read back."""

import hashlib
import random
from collections import defaultdict

import pytest

from loamworks.llm import chat_format
from loamworks.llm.chat_format import TEMPLATE, branch_paths, chains, digests, format_trees

SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"
ODD = ["", None, "\\", "\\.", "\\n", "a\nb", "<|end|>\n", "<|turn|>user\n", "</s>[INST] ok [/INST]", "<<|end|>", "<|end|><|end|>", "<<SYS>>", "<\\.|end|>", "naïve 😀 \x00", "<|en", "x" * 20_000, "<s><s>", "$0 \\1"]


def plain_paths(rows, branches):
    """{(tree, leaf): (rank, nodes from the root)}"""
    by = {r[1]: r for r in rows}
    children, found = defaultdict(list), defaultdict(list)
    for r in rows:
        if r[2] in by:
            children[r[2]].append(r[1])
    for r in rows:
        if r[1] in children:
            continue
        path, at = [r[1]], r[1]
        while by[at][2] in by and len(path) <= len(rows):
            at = by[at][2]
            path.append(at)
        if len(path) <= len(rows):
            found[r[0]].append((-sum(by[n][5] or 0 for n in path) / len(path), r[1], path[::-1]))
    return {(t, leaf): (k, path) for t, x in found.items() for k, (_, leaf, path) in enumerate(sorted(x), 1) if branches is None or k <= branches}


@pytest.mark.parametrize("branches", [1, 2, None])
@pytest.mark.parametrize("seed", [0, 1])
def test_paths(spark, seed, branches):
    r = random.Random(seed)
    rows = []
    for i in range(160):
        tree = r.choice([1, 2, 3, None])
        mine = [x[1] for x in rows if x[0] == tree]
        deep = mine and r.random() < 0.7
        parent = (mine[-1] if deep else r.choice(mine)) if mine else None
        rows.append((tree, i, parent, "user", "t", r.choice([0.0, 1.0, 2.0, None])))
    rows += [(4, 500, 501, "user", "on a circle", 1.0), (4, 501, 500, "user", "on a circle", 1.0), (4, 502, 500, "user", "under it", 1.0), (5, 600, 999, "user", "its parent is missing", 1.0), (5, 601, 600, "user", "x", 1.0)]
    rows += [(6, 700 + i, 700 if i else None, "user", "wide", 1.0) for i in range(50)]
    got = defaultdict(list)
    for x in branch_paths(spark.createDataFrame(rows, SCHEMA), branches).collect():
        got[x["tree"], x["branch"], x["rank"]].append((x["at"], x["node"]))
    want = plain_paths(rows, branches)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(t, leaf, k): p for (t, leaf), (k, p) in want.items()}
    assert all([a for a, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


@pytest.mark.parametrize("part_turns", [256, 2])
def test_formatted_text_reads_back(spark, part_turns):
    roles = ["user", "assistant", "a\nrole", "", None, "<|end|>"]
    rows = [(i % 3, i, i - 3 if i >= 3 else None, roles[i % 6 if i % 2 else (i // 2) % 6], ODD[i % len(ODD)], 1.0) for i in range(60)]
    parts = format_trees(spark.createDataFrame(rows, SCHEMA), 1, part_turns=part_turns).orderBy("tree", "part").collect()
    for tree in range(3):
        mine = [r for r in rows if r[0] == tree]
        turns = [t for p in parts if p["tree"] == tree for t in TEMPLATE.read_back(p["formatted"])]
        assert turns == [(r[3] or "", r[4] or "") for r in mine]
        spans = [TEMPLATE.unescape(p["formatted"][s["start"] : s["end"]]) for p in parts if p["tree"] == tree for s in p["spans"]]
        assert spans == [r[4] or "" for r in mine if r[3] == "assistant"]
    for p in parts:
        bare = p["formatted"].replace(TEMPLATE.before, "", p["n_turns"]).replace(TEMPLATE.after, "", p["n_turns"])
        assert p["formatted"].count(TEMPLATE.before) == p["formatted"].count(TEMPLATE.after) == p["n_turns"]
        assert not any(c in bare for c in TEMPLATE.control)


def plain_digests(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, said in convs.items():
        said.sort()
        learned = "".join(x for _, _, role, x in said if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, _, role, x in said)
        out.append((conv, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHAIN_TURNS", 8)
    rows = [(1, i, "assistant" if i % 2 else "user", ODD[i % len(ODD)]) for i in range(700)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "late"), (None, 1, "assistant", "b"), (None, 0, None, None), (3, 0, "assistant", "alone")]
    clash = "tree string, node string, parent string, branch string, part string, at string, rank string"
    frame = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], f"conv_id bigint, turn bigint, role string, text string, {clash}").repartition(7)
    got = digests(format_trees(chains(frame).withColumn("score", chat_format.F.lit(1.0)), part_turns=64)).drop("formatted_chars")
    assert sorted(map(tuple, got.collect()), key=str) == plain_digests(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert branch_paths(empty).collect() == [] and digests(format_trees(empty)).collect() == []
    assert chains(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
