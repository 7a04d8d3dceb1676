"""Importance resampling against a plain version, and crc32 of joined strings."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from loamworks.llm import queries, resampling
from loamworks.llm.resampling import Shifts, gram_hashes, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % 10000 for g in grams)


def plain(docs, target):
    found = [(i, *features(t)) for i, t in docs]
    source, wanted = Counter(), Counter()
    for _, _, c in found:
        source.update(c)
    for t in target:
        wanted.update(features(t)[1])
    all_s, all_t = sum(source.values()), sum(wanted.values())
    gain = lambda b: floor(1000 * log((wanted[b] + 1) * (all_s + 10000) / ((source[b] + 1) * (all_t + 10000))))
    out = []
    for i, words, c in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in c.items())
        out.append([i, sum(c.values()), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(found):
    return sorted(map(tuple, found.collect()), key=str)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(queries.QUERIES["op13_importance_resampling"](spark, sf)) == plain(docs, target)


@pytest.mark.parametrize("block", [100_000, 50])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK_WORDS", block)
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(["Été", "two", "x" * 300, "a", "B-b", "42", "你好"]) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 2, 3, 19, 20, 21, 49, 50, 51, 200]))) for i in range(200)] + [(7, "same " * 30)] * 30 + [(300, None), (301, ""), (None, text(40)), (302, "..."), (303, text(5000))]
    clash = "words string, n_features string, weight string, score string, rank string, ids string, _place string, _null string"
    frame = spark.createDataFrame([(*d, *["x"] * 8) for d in docs], f"doc_id bigint, text string, {clash}")
    target = [text(30), None, "", "two a two"]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    assert rows(resample(frame, wanted)) == plain(docs, target)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string"), spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert resample(docs.limit(0), items).collect() == []
    assert rows(resample(docs, items.limit(0))) == plain([(1, "one two")], [])


def test_hashes_of_joined_words():
    r = np.random.default_rng(0)
    words = [r.bytes(int(n)) for n in r.integers(1, 70, 200)] + [b"x" * 100_000, b"y"]
    got = gram_hashes(words, 4, Shifts())
    for k, crc in enumerate(got, 1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
