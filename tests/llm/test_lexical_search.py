"""Ranked search against scoring every pair of item and document."""

import random
import re
from collections import Counter
from math import floor, log

import pytest

from loamworks.llm import lexical_search
from loamworks.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, items, k=10):
    """Rows (item, rank, doc, score), scoring all pairs."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n) // total
            s = sum(c * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(found):
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("block_terms", [200_000, 40])
@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, monkeypatch, seed, block_terms):
    monkeypatch.setattr(lexical_search, "AT_ONCE", 500)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "42", "x"]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(r.choice([1, 5, 40, 300]))) for i in range(150)] + [(200 + i, "a much repeated text, word for word") for i in range(40)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w3 w50"), (300, None), (301, ""), (302, "!?")]
    items = [(i, text(r.choice([1, 3, 20]))) for i in range(25)] + [(25, "A much REPEATED text"), (26, None), (27, "nowhere"), (28, ""), (None, "w50 w50 w3"), (3, "w2"), (3, "w1")]
    found = search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_terms=block_terms)
    assert rows(found) == plain(docs, items)


def test_fewer_than_k_documents_and_clashing_columns(spark):
    clash = ", ".join(f"{c} string" for c in ("query", "term", "row", "n", "score", "rank", "item", "unit", "least"))
    docs = spark.createDataFrame([(1, "one two " * 50_000, *["x"] * 9), (2, "two", *["x"] * 9)], f"doc_id bigint, text string, {clash}")
    items = spark.createDataFrame([(9, "one", *["x"] * 9), (8, "two two", *["x"] * 9)], f"item_id bigint, text string, {clash}")
    assert rows(search(docs, items)) == plain([(1, "one two " * 50_000), (2, "two")], [(9, "one"), (8, "two two")])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "one")], "doc_id bigint, text string"), spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == []
    assert len(search(docs, items).collect()) == 1


def test_one_term_in_all_documents(spark):
    docs = [(i, f"the w{i % 7}") for i in range(300)]
    items = [(0, "the"), (1, "the w3")]
    got = rows(search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == plain(docs, items)
