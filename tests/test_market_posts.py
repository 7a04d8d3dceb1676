"""Balanced elements, and many items from one post."""

import pytest
from pyspark.sql import functions as F

from loamworks.sources import feeds, market_posts

OPEN = r"(?i)<div\b[^>]*class=\"post\"[^>]*>"
MARKUP = [
    ('<div class="post">a<div>b</div>c</div>d</div>', "a<div>b</div>c"), ('<p>x</p><DIV id="1" class="post">a<div><div>b</div></div></DIV><div>reply</div>', "a<div><div>b</div></div>"), ('<div class="post">a<div>b</div>', None), ('<div class="other">a</div>', None),
    ('<div class="post"></div>', ""), ('<div class="post">a<div/>b</div>', "a<div/>b"), ('<div class="post">a<divider>b</divider></div>', "a<divider>b</divider>"), ('<div class="post">a<div title="x>y">b</div>c</div>', 'a<div title="x>y">b</div>c'), (None, None), ("", None),
]


def test_balanced_elements(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKUP)], "i int, h string")
    got = [r["e"] for r in rows.select("i", feeds.balanced(F.col("h"), OPEN, "div").alias("e")).orderBy("i").collect()]
    assert got == [want for _, want in MARKUP]


def test_elements_of_feeds(spark):
    xml = "<entry><content type='xhtml'><div>a <content>inner</content> &amp; b</div></content><title><![CDATA[T & <b>]]></title><link href='x'/><id/><updated></updated></entry>"
    row = spark.createDataFrame([(xml,)], "x string").select(*[feeds.element(F.col("x"), t).alias(t) for t in ("content", "title", "id", "updated", "none")]).first()
    assert row == ("<div>a <content>inner</content> & b</div>", "T & <b>", None, None, None)


def test_elements_without_their_own_name_inside_are_found_by_one_pattern(spark):
    xmls = ["<a>1</a>", "<x><A k='>'> 2 </a ></x>", "<a/><a>3</a>", "<ab>no</ab><a>4</a>", "<a><a>5</a></a>", "<a><a>6</a>", "<a>7<ab></ab></a><a>8</a>", "<a>9<a/></a>", "<a></a><a>x</a>", "a</a>", "<a>" + "<i>y</i>" * 20000 + "</a>", "<i/>" * 20000 + "<a>z</a>", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xmls)], "i int, x string")
    got = [r["e"] for r in rows.select("i", feeds.element(F.col("x"), "a").alias("e")).orderBy("i").collect()]
    assert got == ["1", "2", "3", "4", "<a>5</a>", None, "7<ab></ab>", "9<a/>", None, None, "<i>y</i>" * 20000, "z", None, None]
    assert "(?!/?a[" in rows.select(feeds.element(F.col("x"), "a"))._jdf.queryExecution().optimizedPlan().toString()


def test_post_text(spark):
    html = "<p>One&nbsp;&euro;&#x41;&#66;<br>two <b>bold</b></p><script>x</script><del>900</del><!-- c --><div>\r\n\n three &amp;lt; </div>"
    assert spark.createDataFrame([(html,)], "h string").select(market_posts.post_text(F.col("h"))).first()[0] == "One €AB\ntwo bold\n three &lt;"


#: (title, body, currency, items as (model, capacity, price, shipping, basis), how many are excluded)
POSTS = [
    ("[WTS] cards", "<p>RTX 3080 10GB - $350 shipped</p><p>good card</p><p>RX6600xt $150</p>", "USD", [("RTX 3080", "10", 350.0, 0.0, "asking"), ("RX 6600xt", "", 150.0, None, "asking")], 0),
    ("RTX 3060 12GB", "<div>RTX 3060<div>$200</div></div>", "USD", [("RTX 3060", "12", 200.0, None, "asking")], 0), ("WTB RTX 3060", "RTX 3060 $200", "USD", [], 1), ("cards", "RTX 3060 or RTX 3070 $200", "USD", [], 1), ("cards", "RTX 3060 $200<br>$220", "USD", [], 1),
    ("cards", "RTX 3060 $200<br>RTX 3060 12GB<br>SOLD", "USD", [("RTX 3060", "12", 200.0, None, "sold")], 0), ("cards", "RTX 3060 $200<br>-----<br>$999", "USD", [("RTX 3060", "", 200.0, None, "asking")], 0), ("cards", "RTX 3060 $200<br>RX 580 $90<br>RTX 3060 $210", "USD", [("RTX 3060", "", 200.0, None, "asking"), ("RX 580", "", 90.0, None, "asking")], 1),
    ("판매", "<p>RTX 3060 12기가 27만원 택포</p><p>라이젠 5 5600X 95,000원</p>", "KRW", [("RTX 3060", "12", 270000.0, 0.0, "asking"), ("Ryzen 5 5600X", "", 95000.0, None, "asking")], 0), ("판매", "RTX 3060 2개 27만원", "KRW", [], 1), ("판매", "RTX 3060 20-27만원", "KRW", [], 1), ("판매", "RTX 3060 27만원 판매완료", "KRW", [("RTX 3060", "", 270000.0, None, "sold")], 0),
    ("[VDS] carte", "<p>RTX 3070 8 Go 1 250,50 € </p><p>i5-12400F 90 euros</p>", "EUR", [("RTX 3070", "8", 1250.5, None, "asking"), ("i5-12400F", "", 90.0, None, "asking")], 0), ("[VDS] carte", "RTX 3070 $300", "EUR", [], 1), ("[VDS] carte", "RTX 3070 prix <s>350 €</s> 300 €", "EUR", [("RTX 3070", "", 300.0, None, "asking")], 0),
    ("cards", "RTX 3060 8GB or 12GB $200", "USD", [], 1), ("cards", "nothing here", "USD", [], 0), (None, None, "USD", [], 0), ("cards", "RTX 3060 <s>x</s> CA$200", "USD", [], 1), ("cards", "RTX 3060 $200 laptop", "USD", [], 1), ("cards", "RTX 4070 Ti Super $700", "USD", [("RTX 4070 Ti Super", "", 700.0, None, "asking")], 0),
    ("cards", "RTX 3060 $200" + " word" * 500, "USD", [], 1), ("cards", "Intel Core Ultra 7 265K $250<br>500GB SSD $30<br>more", "USD", [("Core Ultra 7 265K", "", 250.0, None, "asking")], 0),
]


@pytest.mark.parametrize("currency", ["USD", "KRW", "EUR"])
def test_items(spark, currency):
    mine = [(i, t, b, w, n) for i, (t, b, c, w, n) in enumerate(POSTS) if c == currency]
    got = market_posts.items(spark.createDataFrame([r[:3] for r in mine], "post int, title string, body string"), "post", currency).orderBy("post", "place").collect()
    for i, title, body, want, excluded in mine:
        own = [r for r in got if r["post"] == i]
        assert [(r["model"], r["capacity"], r["price"], r["shipping"], r["basis"]) for r in own if not r["excluded"]] == want, (title, body)
        assert sum(r["excluded"] for r in own) == excluded, (title, body)
