"""Every operator and stage on nulls, empty and long texts, repeats, ties, extra columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loamworks.llm import embed_dedup, html_extract, imatch, langid, line_dedup, lm_scoring, packing, piece_codec, simhash, url_filter

LINE = "this very line is shared by many documents and is long enough"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, n_lines string, score string, root string, id string, block string, length string"
ROWS = [
    (1, "hello world and good morning to you all", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "en", "b"), (None, "a row without an id", "en", "b"),
    (5, "hello world and good morning to you all", "en", "a"), (5, "hello world and good morning to you all", "en", "a"), (6, "12345 !!! ###", "de", "a"), (7, "x" * 5000, None, "c"),
    (8, "guten Morgen und schönen Tag noch " * 3000, "de", "c"), (9, f"{LINE}\nnine", "en", "c"), (10, f"ten\n{LINE}", "en", "c"), (11, f"{LINE}\n{LINE}", "en", "c"), (12, f"  {LINE.upper()} ", "en", "c"),
    (13, f"{LINE}\nthirteen", "en", "c"), (None, f"{LINE}\nnobody", None, "c"), (14, "naïve café — 你好 😀 \x00 end", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1]) if r[1] else None, "x", "x", "x", "x", "x", "x", "x") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def operators():
    bpe, piece = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return {
        "simhash": simhash.classes, "lines": line_dedup.drop_common_lines, "lm": lm_scoring.score, "pieces": lambda d: piece_codec.encode_documents(d, piece), "packing": lambda d: packing.pack(d, bpe),
        "language": langid.predict, "imatch": imatch.compare_edited,
    }


@pytest.mark.parametrize("name", list(operators()))
def test_one_row_for_each_row(docs, name):
    out = operators()[name](docs)
    if name == "packing":
        out = out.filter("piece = 0")
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", list(operators()))
def test_empty_table(docs, name):
    assert operators()[name](docs.limit(0)).collect() == []


def test_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        out = stage(spark, now, "")
        assert last or out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
        now = spark.createDataFrame(out.collect(), out.schema)
    assert now.count() > 0


def test_language_stage(spark, docs):
    """Null texts and those without letters go; a text of x alone, which is like no language, goes for its score unless it has a language."""
    import corpus_pipeline

    stage = lambda d, **more: {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_languages(spark, d, "", **more).collect()}
    lettered = {1, None, 5, 8, 9, 10, 11, 12, 13, 14}
    assert set(stage(docs)) == lettered
    assert set(stage(docs, least_score=0.0)) == lettered | {7}
    given = stage(docs.withColumn("lang", F.when(F.col("doc_id") == 7, "fr").otherwise(F.col("lang"))))
    assert set(given) == lettered | {7} and given[7] == "fr" and given[8] == "de"


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (None, "http://A.B/x?y", "<p>hi"), (3, "https://b.example.com/en/7#q", "<!doctype html>"), (3, "x://", "<p>a<p>b")], "page_id bigint, url string, html string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "a.b", "/x", None, "allow"), (3, "b.example.com", "/en/7", "example.com/en/7", "allow"), (3, "", "", None, "allow")}
    texts = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.main_text(pages).collect())
    assert texts == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("3", "a\n\nb", 4), ("None", "hi", 2)]
    assert html_extract.main_text(pages.limit(0)).count() == 0 and url_filter.judge(pages.limit(0), []).count() == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (None, [3.0, 0.1]), (12, [1e300, 0.0]), (13, [1e-300, 1e-301])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(v, 0.95).collect()}
    assert {k for k, x in got.items() if x[1] == 1} == {1, 2, 3, None, 12, 13}
    assert got[1] == (5, 1, True) and got[2] == (5, 1, False) and got[None] == (5, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11))
    assert embed_dedup.near_vectors(v.limit(0)).count() == 0


def test_line_dedup_keeps_the_last_copy(docs):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_common_lines(docs).filter("doc_id BETWEEN 9 AND 13").collect()}
    assert got[9] == ("nine", 2, 1) and got[10] == ("ten", 2, 1) and got[11] == ("", 2, 2) and got[12] == ("", 1, 1) and got[13] == (f"{LINE}\nthirteen", 2, 0)
    null = line_dedup.drop_common_lines(docs).filter(F.col("doc_id").isNull() & F.contains("text", F.lit("nobody"))).first()
    assert null["text"] == "nobody"


def test_pages_with_clashing_columns(spark):
    clash = ("host", "path", "rule", "verdict", "given", "found", "trust", "text", "n_chars", "src", "dst")
    rows = [(1, "http://a.test/x/1", '<p>one <a href="//b.test/">b</a>', *["x"] * len(clash)), (1, "http://a.test/x/1", '<p>one <a href="//b.test/">b</a>', *["x"] * len(clash)), (2, "http://b.test/", "<p>" + "two " * 300_000, *["x"] * len(clash))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, " + ", ".join(f"{c} string" for c in clash))
    got = sorted((r["page_id"], r["host"], r["verdict"]) for r in url_filter.judge(pages, [("allow", "a.test", "/x")]).collect())
    assert got == [(1, "a.test", "allow"), (1, "a.test", "allow"), (2, "b.test", "allow")]
    texts = sorted((r["page_id"], r["n_chars"]) for r in html_extract.main_text(pages).collect())
    assert texts == [(1, 5), (1, 5), (2, 4 * 300_000 - 1)]


def test_vectors_with_clashing_columns(spark):
    clash = ("node", "n", "least", "dim", "cell", "slot", "root", "id", "kept", "component_id")
    rows = [(i, [1.0, 0.01 * (i % 3)], *["x"] * len(clash)) for i in (1, 2, 3, 3)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, " + ", ".join(f"{c} string" for c in clash))).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1)]


def test_equally_near_languages_go_by_name():
    same = {"b": langid.top_grams("the same text", 50), "a": langid.top_grams("the same text", 50)}
    assert langid.Ranks(same).predict("the same")[0] == "a"
    score = langid.Ranks(same).predict("the same")[1]
    assert langid.Ranks({"b": same["b"]}).predict("the same", best=("a", score)) == ("a", score) and langid.Ranks({"a": same["a"]}).predict("the same", best=("b", score)) == ("a", score)


def test_pieces_of_equal_length_and_content_are_packed_once_each(spark):
    docs = spark.createDataFrame([(i // 2, "the same words again") for i in range(400)], "doc_id bigint, text string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 16).collect()
    assert len(got) == 400 and len({(r["sequence_id"], r["offset"]) for r in got}) == 400


def test_many_common_lines_and_hot_ones(spark, monkeypatch):
    """A line in all documents and many in five each: only the former is sent to all tasks."""
    line = lambda k: f"the line number {k} of those that several documents share"
    rows = [(i, f"{LINE}\n{line(i // 5)}\n{LINE}\nown {i}") for i in range(400)] + [(None, LINE)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.drop_common_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "SENT", 20)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 50)
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.drop_common_lines(docs).collect()) == want
    lines = line_dedup.materialize(line_dedup.long_lines(docs))
    common = line_dedup.materialize(line_dedup.common_lines(lines))
    assert common.count() == 81 and common.filter("lines >= 50").collect()[0]["lines"] == 800
    plan = line_dedup.matched(lines, common, 20, 50)._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=broadcast") == 1
    assert line_dedup.matched(lines, common, 20, 50).count() == 1201
