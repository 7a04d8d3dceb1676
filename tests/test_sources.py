import json

from pyspark.sql import functions as F

from loamworks.sources import feeds, sinks


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def body(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "src string, body string")


def test_releases_keep_the_newest_and_a_stable_one(spark):
    r = [{"tag_name": f"v{i}", "draft": i == 9, "prerelease": i > 1, "published_at": f"2024-01-{i + 1:02d}T00:00:00Z"} for i in range(10)]
    got = rows(feeds.releases(body(spark, json.dumps(r)), "src"), "tag")
    assert got == [("v1",), ("v4",), ("v5",), ("v6",), ("v7",), ("v8",)]


def test_malformed_bodies_give_nothing(spark):
    bad = body(spark, "not json", "", "{}")
    assert feeds.releases(bad, "src").count() == feeds.keyed_releases(bad).count() == feeds.atom_entries(bad).count() == feeds.rss_items(bad).count() == 0


def test_keyed(spark):
    doc = {"550": {"type": "x", "driver_info": [{"release_version": "550.1", "release_date": "2024-05-01"}, {"release_version": "bad", "release_date": "2024-05-01"}, {"release_version": "550.2", "release_date": "soon"}]}}
    assert rows(feeds.keyed_releases(body(spark, json.dumps(doc))), "branch", "version", "released") == [("550", "550.1", "2024-05-01")]


def test_atom_and_rss(spark):
    atom = '<feed><entry><id>1</id><title>A &amp; B</title><link rel="x" href="http://u"/><published>2024-01-02T03:04:05Z</published><content type="html">&lt;p&gt;x</content></entry></feed>'
    assert rows(feeds.atom_entries(body(spark, atom)), "id", "title", "url", "published", "content") == [("1", "A & B", "http://u", "2024-01-02 03:04:05", "<p>x")]
    rss = "<rss><item><title><![CDATA[T]]></title><link>http://l</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><description>&lt;b&gt;d&lt;/b&gt;</description></item></rss>"
    assert rows(feeds.rss_items(body(spark, rss)), "title", "url", "published", "text") == [("T", "http://l", "2024-01-02 03:04:05", "d")]


def test_changelog_and_headings(spark):
    text = "# Log\n### March 5, 2024\n- one\n- two\n### Unsorted\n- x\n### 2024-02-01 (beta)\n* three\n"
    assert rows(feeds.changelog_sections(body(spark, text)), "released", "lines") == [("2024-02-01", "['three']"), ("2024-03-05", "['one', 'two']")]
    assert rows(feeds.heading_versions(body(spark, "v7.12 - March 3 2025\n  + fix\nnot v1 - x")), "version", "released") == [("7.12", "2025-03-03")]


def test_cross_rate(spark):
    xml = "<Cube currency='USD' rate='1.25'/><Cube currency='KRW' rate='1500'/>"
    assert rows(feeds.cross_rate(body(spark, xml, "<x/>"), "USD", "KRW"), "src", "rate") == [("s0", "1200.0"), ("s1", "None")]


def test_benchmark_rules(spark):
    run = lambda scene, score=1.0, device="A", version="4", sockets=1: (scene, score, device, "CUDA", version, sockets)
    good = [run("a"), run("b"), run("c", 2.0)]
    data = [(i, str(i), good) for i in range(3)] + [(3, "0", [run("a", 9.0), *good[1:]]), (4, "x", good[:2]), (5, "y", [*good[:2], run("c", device="B")]), (6, "z", [*good[:2], run("c", version="3")]), (7, "w", [*good[:2], run("c", float("nan"))])]
    df = spark.createDataFrame(data, "position int, id string, data array<struct<scene:string,score:double,device:string,backend:string,version:string,sockets:int>>")
    assert rows(feeds.benchmark_scores(df, ("a", "b", "c"), "4"), "name", "samples", "median") == [("A", "3", "4.0")]


def test_snapshots(spark):
    r = feeds.snapshots(body(spark, "abc")).first()
    assert r["byte_size"] == 3 and r["checksum"].startswith("ba7816bf")


def test_sinks_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("at", F.lit(1_704_067_200_000) + F.col("id"))
    sinks.export_tables({"t": df}, str(tmp_path))
    assert sorted(spark.read.parquet(f"{tmp_path}/t.parquet").collect()) == sorted(df.collect())
    schema = "id int, kind string, status string, visibility string, subject string, subject_version string, target string, target_version string, env string, result string, created_at bigint, user string, comment string"
    report = lambda i, kind="compat", status="published", visibility="public", env="{}", at=1_704_067_200_000: (i, kind, status, visibility, "app:a", "1", "app:b", None, env, "works", at + i, "me", "my words")
    reports = [report(1, env='{"os": "Mac OS X 14", "runtime": "ollama 0.3", "quant": "Q4; call me", "note": "mine"}'), report(2, env='{"os": 7, "runtime": ""}'), report(3, env="not JSON"), report(4, env=None), report(5, kind="issue"), report(6, status="hidden"), report(7, visibility="private"), report(8), report(9), report(10, at=1_706_745_600_000)]
    frame, posts = spark.createDataFrame(reports, schema), spark.createDataFrame([(8, "removed"), (9, "locked"), (77, "removed")], "report int, status string")
    sinks.open_data(frame, posts, str(tmp_path / "open"), most=3)
    out = spark.read.schema("subject string, env map<string, string>, result string, day string").json(str(tmp_path / "open/reports"))
    assert [r["env"] for r in out.filter("day = '2024-01-01'").collect()].count({"runtime": "ollama 0.3", "os": "macos"}) == 1 and set(out.columns) == {"subject", "env", "result", "day", "month"}
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "open/months")).select("month", "reports", "truncated").collect())) == [("2024-01", 3, True), ("2024-02", 1, False)]
    assert sorted(map(tuple, sinks.open_reports(frame, posts, None)[1].collect())) == [("2024-01", 5, False), ("2024-02", 1, False)]
    items = spark.createDataFrame([(1, "a<b", "u1"), (2, "c", "u2")], "at int, title string, url string")
    assert sinks.feed(items, "at", "title", "url").first()["xml"].index("u2") < sinks.feed(items, "at", "title", "url").first()["xml"].index("u1")
    pages = spark.createDataFrame([("/a", "en", True), ("/a", "ko", True), ("/b", "en", False)], "p string, l string, ok boolean")
    assert [(r["p"], r["alternates"]) for r in sinks.sitemap(pages, "p", "l", "ok").collect()] == [("/a", {"en": "/en/a", "ko": "/ko/a"})]
