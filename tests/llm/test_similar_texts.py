"""Near copies by exact similarity of their shingles."""

import numpy as np
import pytest

from loamworks.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def least_ids(texts, similarity=0.8):
    sets, at = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if likeness(sets[a], sets[b]) >= similarity:
                low, high = sorted((at[a], at[b]))
                at = [low if x == high else x for x in at]
    return at


def components(spark, texts):
    got = simhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [c for _, c in sorted((r["doc_id"], r["component_id"]) for r in got)]


def test_texts_that_share_a_half_to_three_quarters_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FAMILY_TILE", 8)
    rng = np.random.default_rng(11)
    texts = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(5000, size=300)]
        for share in (1.0, 0.98, 0.95, 0.92, 0.9, 0.88, 0.86, 0.84, 0.8, 0.7, 0.5):
            keep = int(300 * share)
            texts.append(" ".join(base[:keep] + [f"v{x}" for x in rng.integers(5000, size=300 - keep)]))
    assert components(spark, texts) == least_ids(texts)


def test_a_hot_family_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FAMILY_TILE", 8)
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(5000, size=200)]
    texts = []
    for n in range(80):
        words = list(base)
        for at in rng.choice(200, n % 9, replace=False):
            words[at] = f"v{n}"
        texts.append(" ".join(words))
    assert components(spark, texts) == least_ids(texts)


def test_given_documents_go_by_exact_similarity(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    lower = [t.translate({i: i + 32 for i in range(65, 91)}) for t in texts]
    assert components(spark, texts) == least_ids(lower)


@pytest.mark.parametrize("n", [8, 40, 300])
def test_repeated_passages_are_no_difference(spark, n):
    words = [f"w{i}" for i in range(n)]
    once = " ".join(words)
    texts = [once, once + " " + once, " ".join(words[: n // 2] * 4 + words[n // 2 :]), "another text of more than five words"]
    assert components(spark, texts) == least_ids(texts)


def test_short_texts_of_four_and_five_shingles_link(spark):
    texts = []
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    got = components(spark, texts)
    assert got == least_ids(texts) == [i - i % 2 for i in range(300)]


def test_a_hot_cell_is_split(spark):
    n = 40
    tiles = spark.createDataFrame([(c, k, k // simhash.GROUP, [100 * c + k], [b"x"]) for c, m in ((5, n), (6, 3), (9, 1)) for k in range(m)], "cell bigint, slot int, part bigint, ids array<bigint>, fps array<binary>")
    sizes = spark.createDataFrame([(5, n), (6, 3), (9, 1)], "cell bigint, slots int")
    pairs = simhash.tile_pairs(tiles, sizes, [0, 1])
    got = [tuple(sorted((r["left_ids"][0], r["ids"][0]))) for r in pairs.collect()]
    ids = lambda c, m: [100 * c + k for k in range(m)]
    want = [(a, b) for m in (ids(5, n), ids(6, 3), ids(9, 1)) for a in m for b in m if a <= b] + [(a, b) for a in ids(5, n) for b in ids(6, 3)]
    assert sorted(got) == sorted(want)
    tasks = {(r["cell"], r["part"]): r["n"] for r in pairs.groupBy("cell", "part").count().withColumnRenamed("count", "n").collect()}
    assert len([k for k in tasks if k[0] == 5]) == n // simhash.GROUP and max(tasks.values()) <= n * simhash.GROUP
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.tile_pairs(tiles, sizes, [0, 1])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [cell" in plan and "part" in plan.split("SortMergeJoin [cell", 1)[1].split("\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_limit_what_is_compared():
    sets = [np.arange(10, dtype=np.uint64)] * 4
    assert len(list(simhash.set_links(sets, None, 0.8))) == 3
    assert list(simhash.set_links(sets, None, 0.8, lambda i: np.array([False, False, i == 0, False]))) == [(0, 2)]
