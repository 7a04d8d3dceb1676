"""Operators that SQL can't express, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from loamworks.llm import embed_dedup, imatch, langid, lm_scoring, packing, queries, simhash, url_filter
from loamworks.llm.shared import spanning_edges

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def roots(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_simhash(text, width=3):
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    ids = sorted(docs)
    prints = [plain_simhash(docs[i]) for i in ids]
    assert [got[i][0] for i in ids] == [f"{p:016x}" for p in prints]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert [got[i][1] for i in ids] == [ids[r] for r in roots(len(ids), links)]


@pytest.mark.parametrize("words,radius", [(1, 2), (1, 9), (4, 30)])
def test_simhash_links(spark, words, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64 - 1, (300, words), np.uint64)
    near = [base]
    for k in (0, 15, 31, 47, 60):
        moved = base[:100].copy()
        for j in range(max(1, radius // 2)):
            moved[:, j % words] ^= np.uint64(1) << np.uint64((k + 7 * j) % 64)
        near.append(moved)
    values = np.unique(np.concatenate(near), axis=0)
    rows = [(i, v.tobytes(), 100) for i, v in enumerate(values)]
    want = roots(len(values), [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]).sum(1) <= radius)])
    nodes = spark.createDataFrame(rows, "node bigint, fp binary, shingles bigint")
    got = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(nodes, radius, words, tile=16)).collect()}
    assert [got.get(i, i) for i in range(len(values))] == want


def test_simhash_finds_similar_texts(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, truth = [], {}
    for g in range(40):
        words = rng.choice(vocabulary, 60 + 20 * g).tolist()
        for k in range(3):
            copy = list(words)
            for at in rng.choice(len(words), k * len(words) // 100, replace=False):  # each changes five shingles at most
                copy[at] = "changed"
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(truth[i] == truth[c] for i, c in got.items())
    assert sum(c == min(j for j in truth if truth[j] == truth[i]) for i, c in got.items()) >= 0.98 * len(rows)


def test_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(v["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = queries.QUERIES["op7_embedding_near_dedup"](spark, sf).toPandas().sort_values("vec_id")
    ids = v["vec_id"].to_numpy()
    assert (got["n_links"].to_numpy() == near.sum(1)).all()
    assert (got["component_id"].to_numpy() == ids[roots(len(ids), zip(*np.nonzero(near)))]).all()


def test_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 8))
    x = np.concatenate([centers[rng.integers(30, size=900)] + rng.normal(scale=0.25, size=(900, 8)), np.repeat(centers[:2], 40, 0)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_vectors(rows, 0.95, block=100).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == near.sum(1)).all() and (got["component_id"].to_numpy() == roots(len(x), zip(*np.nonzero(near)))).all()


def test_cover_tree_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    place, head, reach = embed_dedup.cover_tree(x)
    for k, r in enumerate(embed_dedup.RADII):
        at = np.flatnonzero(head[:, k])
        at = at[np.argsort(place[at, k])]
        away = np.linalg.norm(x - x[at[place[:, k]]], axis=1)
        assert (away <= r + 1e-9).all() and (away <= reach[:, k] + 1e-7).all()
        assert k == 0 or head[head[:, k - 1], k].all()


def test_spanning_edges():
    rng = np.random.default_rng(2)
    a, b = rng.integers(200, size=(2, 150))
    nodes, low = spanning_edges(a, b, 200)
    assert roots(200, zip(a, b)) == roots(200, zip(nodes, low)) and len(nodes) < 200


class PlainAutomaton:
    """One state at a time, by arcs and failure arcs; states are tuples of tokens, 0 for a text's start and None for its end."""

    def __init__(self, texts, priors):
        self.priors = priors
        self.counts = Counter(t[i : i + k] for t in texts for k in range(1, len(priors) + 2) for i in range(len(t) - k + 1))
        self.total = sum(len(t) - 1 for t in texts)
        self.kinds = len({w for t in texts for w in t[1:]})

    def probability(self, state, w):
        if not state:
            return (self.counts[(w,)] + 0.5) / (self.total + 0.5 * (self.kinds + 1))
        prior, seen = self.priors[len(state) - 1], self.counts[state]
        return (self.counts[(*state, w)] + prior * self.probability(state[1:], w)) / (seen + prior)

    def read(self, state, w):
        """(next state, log-probability)"""
        p, at = 0.0, state
        while at and not self.counts[(*at, w)]:  # failure arc
            prior = self.priors[len(at) - 1]
            p += log10(prior / (self.counts[at] + prior))
            at = at[1:]
        p += log10(self.probability(at, w))
        after = (*state, w)[-len(self.priors) :] if self.priors else ()
        while after and not self.counts[after]:
            after = after[1:]
        return after, p

    def score(self, text):
        state, total = (0,)[: len(self.priors)] if self.counts[(0,)] else (), 0.0
        for w in text[1:]:
            state, p = self.read(state, w)
            total += p
        return total


def lm_tokens(text):
    return (0, *WORD.findall((text or "").translate(LOWER)), None)


def plain_weights(texts):
    """The weights under which the texts are likeliest, each by the counts of all others: one length of context after the other."""
    all_ = PlainAutomaton(texts, (1.0,) * 3)
    likely = [Counter() for _ in range(3)]
    rows = []
    for t in texts:
        own = Counter(t[i : i + k] for k in range(1, 5) for i in range(len(t) - k + 1))
        c = lambda g: all_.counts[g] - own[g]  # noqa: E731, B023
        for i in range(1, len(t)):
            p = (c((t[i],)) + 0.5) / (all_.total - len(t) + 1 + 0.5 * (all_.kinds + 1))
            rows.append((p, [(c(t[i - k : i + 1]), c(t[i - k : i])) if i >= k else (0, 0) for k in (1, 2, 3)]))
    now, best = [p for p, _ in rows], []
    for k in range(3):
        mix = lambda m: [(n[k][0] + m * p) / (n[k][1] + m) if n[k][1] else p for p, (_, n) in zip(now, rows)]  # noqa: E731, B023
        likely[k] = {m: sum(map(log10, mix(m))) for m in lm_scoring.GRID}
        best.append(max(likely[k], key=likely[k].get))
        now = mix(best[-1])
    return tuple(best)


def test_lm_scores(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_lm_scoring"](spark, sf).collect()}
    tokens = {i: lm_tokens(t) for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    taught = [ts for i, ts in tokens.items() if not held[i]]
    weights = plain_weights(taught)  # from training texts alone
    plain = PlainAutomaton(taught, weights)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(ts) - 1, plain.total, sum(plain.counts[(w,)] > 0 for w in ts[1:]))
        assert r["base_score"] == pytest.approx(sum(log10(plain.probability((), w)) for w in ts[1:]), abs=1e-6)
        assert r["score"] == pytest.approx(plain.score(ts), abs=1e-6)
    out = [i for i in docs if held[i]]
    shorter = PlainAutomaton(taught, weights[:1])
    assert sum(got[i]["score"] for i in out) > sum(shorter.score(tokens[i]) for i in out) > sum(got[i]["base_score"] for i in out)


@pytest.mark.parametrize("priors", [(), (3.0,), (3.0, 1.0), (3.0, 1.0, 0.5, 0.25)])
def test_lm_orders_over_many_blocks(spark, priors):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(12)).tolist()) for _ in range(60)] + ["a b c a b c a b"] * 5 + [None, "", "z"]
    held = [i % 3 == 1 for i in range(len(texts))]
    plain = PlainAutomaton([lm_tokens(t) for t, h in zip(texts, held) if not h], priors)
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id bigint, text string, h boolean")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(rows, F.col("h"), priors, block_tokens=40, bucket_tokens=30).collect()}
    assert got == {i: pytest.approx(plain.score(lm_tokens(t)), abs=1e-9) for i, t in enumerate(texts)}


def test_lm_weights_are_fitted_on_all_training_texts(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abc" if i < 120 else "abcdefgh"), rng.integers(1, 14)).tolist()) for i in range(160)] + ["a b c d e f g h"] * 30 + [None, ""]
    held = [i % 4 == 1 for i in range(len(texts))]
    taught = [lm_tokens(t) for t, h in zip(texts, held) if not h]
    plain = PlainAutomaton(taught, plain_weights(taught))
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id bigint, text string, h boolean")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(rows, F.col("h"), block_tokens=16, bucket_tokens=60).collect()}
    assert got == {i: pytest.approx(plain.score(lm_tokens(t)), abs=1e-9) for i, t in enumerate(texts)}


def test_lm_what_follows_a_state_sums_to_one():
    texts = [lm_tokens(t) for t in ("a b c a b", "b a", "c c a b c a", "a b c a b")]
    plain = PlainAutomaton(texts, (3.0, 1.0, 0.5))
    words = [*{w for t in texts for w in t[1:]}, "never seen"]
    for state in [(), ("a",), ("a", "b"), ("b", "c", "a"), (0,), (0, "a")]:
        assert sum(10 ** plain.read(state, w)[1] for w in words) == pytest.approx(1)


def test_pieces(spark, sf, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.QUERIES["op6_piece_codec"](spark, sf).collect():
        ids = library.encode(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.QUERIES["op8_best_fit_packing"](spark, sf).toPandas().sort_values(["doc_id", "piece"])
    total = 0
    for i, pieces in got.groupby("doc_id"):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 0]
        at = 0
        for r in pieces.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (pieces["length"].to_numpy()[1:] == 2048).all() and (len(pieces) == 1 or len(ids) > 2048)
        total += len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-total // 2048) + 2


@pytest.mark.parametrize("text", ["", " ", "a  b", "it's\n\n x ", "  lead", "tab\t x", "nbsp\xa0 x", "你好 世界", "<|endoftext|> x", "\x1c a"])
def test_byte_encoder(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        ours = packing.ByteEncoder(f.read())
    assert np.frombuffer(ours.encode_added(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_language(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op9_language_id"](spark, sf).collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def plain_grams(text):
    """Counts of 1- to 3-grams by their characters; the key orders as the operator's codes do."""
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    found = Counter(clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1))
    return {g: c for g, c in found.items() if not (g.isspace() or (len(g) == 3 and g[1] == " "))}


def plain_order(counts, n):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:n]


@pytest.mark.parametrize("labels", [2000, 2])
def test_language_against_a_plain_version(spark, sf, monkeypatch, labels):
    monkeypatch.setattr(langid, "LABELS", labels)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t, None) for i, t in enumerate(["", None, "123 !", "né ñ", "ß", "the the der"])]
    sums = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            sums.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: {g: k for k, g in enumerate(plain_order(c, 500))} for lang, c in sums.items()}
    most = max(map(len, profiles.values()))
    want = {}
    for i, text, _ in rows:
        own = plain_order(plain_grams(text or ""), 400)
        away = {lang: sum(min(abs(k - p[g]), most) if g in p else most for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        want[i] = (best, pytest.approx(1 - away[best] / (most * len(own)))) if own else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == want


def test_out_of_place_distance():
    ranks = langid.Ranks({"a": langid.top_grams("das ist ein haus und das haus ist alt", 50), "b": langid.top_grams("the house is old and it is the house", 50)})
    for text in ("das haus", "the house", "xyz"):
        own, away = langid.top_grams(text, 400).tolist(), {}
        for label, row in zip(ranks.labels, ranks.rank):
            known = {int(c): int(k) for c, k in zip(ranks.codes, row) if k >= 0}
            away[label] = sum(min(abs(known[g] - i), ranks.most) if g in known else ranks.most for i, g in enumerate(own))
        assert ranks.predict(text)[0] == min(away, key=away.get)


def test_imatch(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_imatch"](spark, sf).collect()}
    order = sorted(docs, reverse=True)
    by_text = {}
    for i, then in zip(order, order[1:] + order[:1]):
        text, r = docs[i], got[i]
        swap = len(text) // 3
        edited = text[: len(text) - swap] + docs[then][:swap]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["near_next"] == imatch.likeness(bytes.fromhex(r["fingerprint"]), bytes.fromhex(got[then]["fingerprint"]))
        assert r["near_edited"] == imatch.likeness(bytes.fromhex(r["fingerprint"]), bytes.fromhex(r["edited_fingerprint"]))
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def plain_imatch(texts):
    """Fingerprints by the lexicons' definition: a lexicon of density d and number k holds the terms of the band whose mixed hash asks for it."""
    words = [{xxhash.xxh64_intdigest(w) for w in t.encode().lower().split()} for t in texts]
    df = Counter(h >> 40 & (imatch.BUCKETS - 1) for w in words for h in w)
    band = {b for b, n in df.items() if max(1, imatch.COMMON * len(texts)) >= n >= imatch.RARE * len(texts)}
    mask = 2**64 - 1
    out = []
    for w in words:
        kept = sorted(h for h in w if h >> 40 & (imatch.BUCKETS - 1) in band)
        slots = [0] * (imatch.LEXICONS * imatch.DENSITIES)
        raw = lambda hs: b"".join(h.to_bytes(8, "little") for h in hs)
        if w and not kept:
            slots = [xxhash.xxh64_intdigest(raw(sorted(w))) % 255 + 1] * len(slots)
        for d in range(imatch.DENSITIES):
            holds = {}
            for h in kept:
                x = (h ^ ((d + 1) * 0x9E3779B97F4A7C15 & mask)) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ x >> 29) * 0x94D049BB133111EB & mask
                x ^= x >> 32
                if x >> 8 & (4**d - 1) == 0:
                    holds.setdefault(x % imatch.LEXICONS, []).append(h)
            for k, hs in holds.items():
                slots[d * imatch.LEXICONS + k] = xxhash.xxh64_intdigest(raw(hs), d) % 255 + 1
        out.append(bytes(slots))
    return out


def plain_likeness(a, b):
    best = 0.0
    for d in range(imatch.DENSITIES):
        x, y = (v[d * imatch.LEXICONS : (d + 1) * imatch.LEXICONS] for v in (a, b))
        best = max(best, sum(p == q > 0 for p, q in zip(x, y)) / max(6, sum(p > 0 or q > 0 for p, q in zip(x, y))))
    return 1.0 if a == b else best


def test_imatch_against_a_plain_version(spark, sf, docs):
    more = {10**6: None, 10**6 + 1: "", 10**6 + 2: "one word", 10**6 + 3: "one word", 10**6 + 4: "einzig " * 2000}
    texts = docs | more
    order = sorted(texts, reverse=True)
    prints = dict(zip(order, plain_imatch([texts[i] or "" for i in order])))
    got = {r["doc_id"]: r for r in imatch.compare_edited(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for i, then in zip(order, order[1:] + order[:1]):
        assert bytes.fromhex(got[i]["fingerprint"]) == prints[i]
        assert got[i]["near_next"] == pytest.approx(plain_likeness(prints[i], prints[then]))
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(prints[i], bytes.fromhex(got[i]["edited_fingerprint"])))


def test_imatch_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BLOCK_DOCS", 3)
    rows = [(i, f"text number {i} " * (i % 4 + 1)) for i in range(0, 60, 2)]
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for (_, then), (i, text) in zip(rows[-1:] + rows[:-1], rows):
        swap = len(text) // 3
        assert got[i] == hashlib.sha256((text[: len(text) - swap] + then[:swap]).encode()).hexdigest()


def test_propagation(spark):
    links = {("a", "b"): 2, ("b", "c"): 1, ("c", "bad"): 1, ("b", "bad"): 3, ("c", "a"): 2}
    chain = {(f"h{i}", f"h{i + 1}"): 1 for i in range(20)}  # further from every seed than any fixed number of steps
    edges = spark.createDataFrame([(s, d, n) for (s, d), n in (links | chain).items()], "src string, dst string, n bigint")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("bad", 0.0, 2.0), ("h20", 0.0, 1.0)], "host string, trusted double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(edges, seeds).collect()}
    arcs = links | chain
    for kind, start, arcs in ((0, {"a": 1.0}, arcs), (1, {"bad": 2.0, "h20": 1.0}, {(d, s): n for (s, d), n in arcs.items()})):
        hosts = {h for pair in arcs for h in pair}
        rank = {h: 0.15 * start.get(h, 0) for h in hosts}
        for _ in range(200):
            after = {h: 0.15 * start.get(h, 0) for h in hosts}
            for (s, d), n in arcs.items():
                after[d] += 0.85 * rank[s] * n / sum(m for (x, _), m in arcs.items() if x == s)
            rank = after
        for h in hosts:
            assert got.get(h, (0.0, 0.0))[kind] == pytest.approx(rank[h], rel=1e-5)
    assert got["h0"][1] > 0


def test_verdicts_do_not_depend_on_what_else_there_is(spark):
    link = lambda h: f'<a href="//{h}/">x</a>'
    pages = [(1, "http://spam.test/bad/1", ""), (2, "http://friend.test/", link("spam.test")), (3, "http://far.test/", link("friend.test"))]
    more = [(100 + i, f"http://s{i}.test/bad/", "") for i in range(50)]
    for rows in (pages, pages + more):
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), [("block", "test", "/bad/")]).collect()}
        assert [got[i] for i in (1, 2, 3)] == ["block"] * 3


def test_links_are_those_of_tags(spark):
    html = """<!-- <a href="http://a.test/"> --><script>x='<a href="http://b.test/">'</script><a class=x HREF='//C.test/p'>y</a><a data-href="http://d.test/">
        href="http://e.test/"<a href=https://f.test>z</a><a href="/own">o</a><style>/* <a href="//g.test"> */</style><area href = " HTTP://h.test?q "><!-- <a href="//i.test/">"""
    pages = spark.createDataFrame([(1, "http://me.test/", html), (2, "http://me.test/2", None)], "page_id bigint, url string, html string")
    assert sorted((r["src"], r["dst"]) for r in url_filter.host_edges(pages).collect()) == [("me.test", f"{h}.test") for h in "cfh"]


def test_url_sql_follows_links(spark, tmp_path):
    from oracle import TABLES, compare

    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://x.example.com/en/1", ""), (2, "http://friend.io/", link("x.example.com")), (3, "http://y.example.net/de/5", link("peer.io") + link("friend.io")), (4, "http://peer.io/", link("far.io")), (5, "http://far.io", None), (6, None, "")]
    for t in TABLES:
        frame = spark.createDataFrame(rows, "page_id bigint, url string, html string") if t == "pages" else spark.range(1)
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    compare(spark, str(tmp_path), queries.QUERIES["op2_url_filter"], queries.ORACLE["op2_url_filter"])
    got = {r["page_id"]: r["verdict"] for r in queries.QUERIES["op2_url_filter"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == "block" and got[3] == got[4] == got[5] == "allow"


def test_linked_hosts_take_their_neighbours_verdict(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = spark.createDataFrame(
        [(1, "http://spam.test/bad/1", ""), (2, "http://friend.test/", link("spam.test")), (3, "http://good.test/ok/1", link("peer.test")), (4, "http://peer.test/", ""), (5, "http://alone.test/", "")],
        "page_id bigint, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [("block", "spam.test", "/bad/"), ("allow", "good.test", "/ok/")]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_pipeline(spark, sf, docs):
    """Stage by stage against plain versions; the packed rows against the tokenizers library."""
    import corpus_pipeline
    from test_similar_texts import least_ids
    from tokenizers import Tokenizer

    packed = corpus_pipeline.run(spark, sf).toPandas().sort_values(["doc_id", "piece"])
    told = {r["doc_id"]: r for r in langid.predict(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    kept = {i: t for i, t in docs.items() if any(map(str.isalpha, t)) and told[i]["score"] >= 0.25}
    assert len(kept) >= 0.99 * sum(any(map(str.isalpha, t)) for t in docs.values())
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = {}
    for i, t in kept.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    kept = {i: "\n".join(x for x in t.split("\n") if common.get(key(x), i) == i) for i, t in kept.items()}
    ids = sorted(kept)
    found = least_ids([" ".join(WORD.findall(kept[i].translate(LOWER))) for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if found[k] == k}
    assert sorted(set(packed["doc_id"])) == sorted(kept)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, pieces in packed.groupby("doc_id"):
        tokens = [*library.encode(kept[i], add_special_tokens=False).ids, 0]
        assert pieces["start"].tolist() == (np.cumsum(pieces["length"]) - pieces["length"]).tolist() and pieces["length"].sum() == len(tokens)
        assert all(r.ids_crc32 == zlib.crc32(np.array(tokens[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces.itertuples())
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 2048
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 2048) + 2


def test_language_stage_rejects_other_languages(spark, sf):
    import corpus_pipeline

    taught = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**9, "这是一个用中文写的文件，里面没有别的语言的字母", None, "x", 20), (10**9 + 1, "the and that with for are was", None, "x", 20), (10**9 + 2, "00 1234 !!", "en", "x", 5)], taught.schema)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_languages(spark, taught.unionByName(odd), "").filter("doc_id >= 1000000000").collect()}
    assert got == {10**9 + 1: "en"}


def test_vectors_of_far_clusters_do_not_meet(spark, monkeypatch):
    """Tight clusters: the same links as by brute force, and few vectors sent to more than their own cell."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=0.03, size=(150, 16)) for c in centers])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    sent = []
    whole = embed_dedup.materialize
    monkeypatch.setattr(embed_dedup, "materialize", lambda df: sent.append(out := whole(df)) or out)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_vectors(rows, 0.95, block=150).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == near.sum(1)).all() and (got["component_id"].to_numpy() == roots(len(x), zip(*np.nonzero(near)))).all()
    trees = next(df for df in sent if "visits" in df.columns)
    assert trees.select(F.sum(F.size("visits"))).first()[0] < 3 * len(x)
