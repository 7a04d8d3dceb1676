from math import ceil, exp
from time import perf_counter

import numpy as np
import pytest

from loamworks.llm import html_extract
from loamworks.llm.html_extract import extract

CASES = [
    ('<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy</div><article><h1>Head</h1><p><b>One &amp; two.<br><p>Three\n four.</p></article><footer>&copy; x</footer>', "Head\n\nOne & two.\n\nThree four."),
    ("<body><header>Site</header><main><header><h1>Title</h1></header><p>Body text.</p><aside>more</aside></main>", "Title\n\nBody text."),
    ('<body><article><p>Story.</p><ul><li>a<li>b</ul><div class="comments"><p>First!</p></div><form><p>Mail</p></form></article></body>', "Story.\n\na\n\nb"),
    ('<body><div id="cookie-notice">We use cookies</div><div id="content"><p>A long paragraph of real text that goes on for a while and then some more.</p><p>Short.</p><p>Another long paragraph of real text, with enough words to count.</p></div></body>', "A long paragraph of real text that goes on for a while and then some more.\n\nShort.\n\nAnother long paragraph of real text, with enough words to count."),
    ("<p>a<!-- c -->b</p><style>p{}</style>", "ab"),
    ("plain text only", "plain text only"),
    ("<table><tr><td>x<td>y</table>", "x\n\ny"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_extract(html, want):
    assert extract(html) == want


@pytest.mark.parametrize("html", [None, "", "<", "<![CDATA[", "<!ELEMENT", "&#xZZ;", "<p" * 1000, "</" * 500, "<div>" * 3000 + "x"])
def test_odd_html(html):
    assert isinstance(extract(html), str)


@pytest.mark.parametrize("odd", ["<![endif--]>", "<![foo[>", "<![ CDATA[>", "<![>", "<![foo[ x ]]>"])
def test_text_after_an_unknown_marked_section_survives(odd):
    got = extract(f"<article><p>Before it.</p>{odd}<p>After it, to the end.</p></article>")
    assert got.startswith("Before it.") and got.endswith("After it, to the end.")
    assert extract(f"{odd}<p>After it.</p>").endswith("After it.")


def test_content_outside_the_section_is_kept_in_page_order():
    long = [f"Paragraph {i} of a long article, with many words in it so that it is surely taken as content by its ratio." for i in range(60)]
    lead, end = "A lead paragraph in a division of its own, with many words. " * 3 + "Lead.", "A closing paragraph in another division, with many words. " * 3 + "End."
    short = ["x", "y", "z", "x", "y"]
    html = f"<body><div>{lead}</div><div>{''.join(f'<p>{x}</p>' for x in long + short)}</div><div>{end}</div></body>"
    assert extract(html) == "\n\n".join([lead, *long, *short, end])


UNMARKED = (
    "<body><div><ul>{menu}</ul></div><div><h2>A title</h2>{story}<p>So.</p></div><table><tr>{cells}</tr></table><div>{menu}</div></body>"
).format(
    menu="".join(f"<li><a href=/{i}><b>Item {i}</b></a></li>" for i in range(12)),
    story="".join(f"<p>Paragraph {i} of a story on a page without telling elements or classes, with enough words that its ratio of text to tags is high.</p>" for i in range(8)),
    cells="".join(f"<td><a href=/t{i}>Topic {i}</a></td>" for i in range(12)),
)


def test_clusters_choose_the_region_where_nothing_else_tells(monkeypatch):
    got = extract(UNMARKED).split("\n\n")
    assert got[0] == "A title" and got[-1] == "So." and len(got) == 10 and all(x.startswith("Paragraph") for x in got[1:-1])
    monkeypatch.setattr(html_extract, "_threshold", lambda values: -1.0)
    assert "Item 3" in extract(UNMARKED)  # without the threshold all lines are content


def plain_content(lines, sigma):
    """Ratio, smoothing and two clusters, a line at a time."""
    ratio = [w * c / max(1, t) for c, t, w in lines]
    reach = ceil(2 * sigma)
    score = []
    for i, (_, _, w) in enumerate(lines):
        near = [(exp(-((i - j) ** 2) / (2 * sigma**2)), ratio[j]) for j in range(max(0, i - reach), min(len(lines), i + reach + 1))]
        score.append(w * sum(a * b for a, b in near) / sum(a for a, _ in near))
    low, high = min(score), max(score)
    if high - low <= 1e-9 * high:
        return [True] * len(lines)
    for _ in range(50):
        parts = [[x for x in score if x < (low + high) / 2], [x for x in score if x >= (low + high) / 2]]
        new = tuple(sum(p) / len(p) if p else c for p, c in zip(parts, (low, high)))
        if new == (low, high):
            break
        low, high = new
    return [s >= (low + high) / 2 - 1e-9 for s in score]


@pytest.mark.parametrize("seed", range(30))
def test_ratio_smoothing_and_threshold_against_plain_ones(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    lines = list(zip(rng.integers(1, 400, n).tolist(), rng.integers(0, 9, n).tolist(), rng.choice([1.0, 0.1, 0.01], n).tolist()))
    sigma = float(rng.choice([0.5, 1.0, 2.0]))
    assert html_extract.content_lines(lines, sigma).tolist() == plain_content(lines, sigma)


DEEP = ["<div>x" * 20_000, "<span>" * 30_000 + "</b>" * 3_000 + "x", "<p><div>" + "<span>" * 30_000 + "</p>" * 30_000 + "x", "<b><div>" + "<span>" * 30_000 + "</b>" * 30_000 + "x", "<ul><li>" * 20_000, "<ul>" + "<li>x" * 30_000]


@pytest.mark.parametrize("html", DEEP)
def test_deep_pages_take_linear_time(html):
    began = perf_counter()
    extract(html)
    assert perf_counter() - began < 10
    long = extract(html + "</ul>" * 20_000 + "</div>" * 20_001 + "<article><p>" + "The end of it all. " * 5000 + "</article>")
    assert long.endswith("The end of it all.")


ARTICLE = "".join(f"<p>Paragraph {i} of the article, with enough words in it that its ratio of text to tags is high.</p>" for i in range(5))
TEXT = "\n\n".join(f"Paragraph {i} of the article, with enough words in it that its ratio of text to tags is high." for i in range(5))
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"
WRAPPED = {
    "layout class": f'<body><div class="layout has-sidebar"><article>{ARTICLE}</article><div class="sidebar">{MENU}</div></div></body>',
    "marked wrapper": f'<body><div class="page sidebar-left"><article>{ARTICLE}</article><div class="sidebar">{MENU}</div></div></body>',
    "id, without an article": f'<body><div id="page-with-sidebar"><div class="menu">{MENU}</div>{ARTICLE}</div></body>',
    "marked, without an article": f'<body><div class="promo-page"><div class="menu">{MENU}</div><div>{ARTICLE}</div></div></body>',
    "page in a form": f'<body><form id="aspnetForm"><div class="menu">{MENU}</div><div>{ARTICLE}</div><div class="footer">Imprint</div></form></body>',
    "article in a form": f"<body><form><nav>{MENU}</nav><article>{ARTICLE}</article></form></body>",
    "wrapper in main": f'<body><main><div class="content sidebar"><article>{ARTICLE}</article></div></main><footer>Imprint</footer></body>',
    "longer comments": f'<body><article>{ARTICLE}</article><div class="comments">{"<p>What a reader says at length, and much of it, about everything and more.</p>" * 40}</div></body>',
    "longer comments in the article": f'<body><article>{ARTICLE}<section id="comments">{"<p>What a reader says at length, and much of it, about everything and more.</p>" * 40}</section></article></body>',
    "articles in the sidebar": f'<body><article>{ARTICLE}</article><aside>{"<article><p>Another story, shortly told in a box beside it.</p></article>" * 9}</aside></body>',
    "notice in the article": f'<body><article>{ARTICLE}<div class="cookie-notice"><p>We use cookies, as everybody does, and tell it at length so that it looks like a text.</p></div></article></body>',
    "form in the article": f"<body><article>{ARTICLE}<form><label>Your mail address, so that we may write to you about many things</label><input></form></article></body>",
}


@pytest.mark.parametrize("name", list(WRAPPED))
def test_wrappers_and_furniture(name):
    assert extract(WRAPPED[name]) == TEXT


@pytest.mark.parametrize("inline", ['<span class="legal">the legal text</span>', '<a id="reply">the legal text</a>', '<em class="ad">the <b class="menu">legal</b> text</em>'])
def test_inline_marks_are_text(inline):
    assert extract(f"<article><p>It is {inline} of it.</p></article>") == "It is the legal text of it."


def test_nothing_but_furniture_is_empty():
    assert extract(f"<nav>{MENU}</nav>") == "" and extract(f"<body><footer>{ARTICLE}</footer></body>") == "" and extract(f'<body><div class="comments">{ARTICLE}</div></body>') == ""


def plain_extract(html, sigma=1.0):
    """The operator's decisions over the parser's lines, one line or element at a time."""
    p = html_extract._Events()
    p.feed(html)
    p.finish()
    lines = [{"text": t, "tags": g, "heading": h, "marks": chain(m, lambda k: p.marks[k][0]), "sections": chain(s, lambda k: p.parent[k])} for t, g, h, m, s in p.lines]
    if not lines:
        return ""
    why = lambda k: p.marks[k][1]
    firm = lambda marks: any(why(k) in ("element", "reader") for k in marks)
    bare = [x for x, c in zip(lines, plain_content([(len(x["text"]), x["tags"], 1.0) for x in lines], sigma)) if c and not firm(x["marks"])]
    held = lambda key, k: sum(len(x["text"]) for x in bare if k in x[key])
    mains = [(held("sections", at), chain(mark, lambda k: p.marks[k][0])) for at, mark in p.mains]
    mains = [(n, marks) for n, marks in mains if n and not firm(marks)]
    dead = set()
    if mains:
        for n, marks in mains:
            if 2 * n >= max(n for n, _ in mains):
                dead.update(marks)
    else:
        whole = sum(len(x["text"]) for x in bare)
        dead = {k for k in range(1, len(p.marks)) if whole and 2 * held("marks", k) >= whole and not firm(chain(k, lambda k: p.marks[k][0]))}
    for x in lines:
        x["live"] = len([k for k in x["marks"] if k not in dead])
    if all(x["live"] for x in lines):
        return ""
    content = plain_content([(len(x["text"]), x["tags"], 0.1 ** x["live"]) for x in lines], sigma)
    chosen = [x for x, c in zip(lines, content) if c]
    total = sum(len(x["text"]) for x in chosen)
    section = max(k for k in range(len(p.parent)) if sum(len(x["text"]) for x in chosen if k in x["sections"] or not k) >= 0.9 * total)
    around = chain(section, lambda k: p.parent[k])
    region = next((k for tag in ("article", "main") for k in around if p.kind[k] == tag), 0 if p.kind[section] == "body" else section)
    at = [i for i, c in enumerate(content) if c]
    inside = (lambda i, x: region in x["sections"]) if region else (lambda i, x: at[0] <= i <= at[-1])
    keep = [c or (not x["live"] and inside(i, x)) for i, (x, c) in enumerate(zip(lines, content))]
    first = keep.index(True)
    if first and lines[first - 1]["heading"] and not lines[first - 1]["live"]:
        keep[first - 1] = True
    return "\n\n".join(x["text"] for x, k in zip(lines, keep) if k)


def chain(k, up):
    """A number and those above it, from the inside, without 0."""
    out = []
    while k:
        out.append(k)
        k = up(k)
    return out


def random_page(rng, depth=0):
    tags = ["div", "div", "section", "p", "p", "h2", "article", "main", "ul", "form", "nav", "aside", "header", "table", "span", "a"]
    classes = ["", "", "", "menu", "sidebar", "has-sidebar", "comments", "content", "cookie-notice", "legal", "reply x"]
    out = []
    for _ in range(int(rng.integers(1, 6))):
        if depth > 4 or rng.random() < 0.4:
            out.append("word " * int(rng.choice([1, 2, 5, 20, 60])))
        else:
            tag, mark = rng.choice(tags), rng.choice(classes)
            out.append(f'<{tag} class="{mark}">{random_page(rng, depth + 1)}</{tag}>')
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_whole_pages_against_a_plain_version(seed):
    html = random_page(np.random.default_rng(seed))
    assert extract(html) == plain_extract(html)


def test_given_pages_against_a_plain_version(sf):
    import duckdb

    for (html,) in duckdb.sql(f"SELECT html FROM read_parquet('{sf}/pages.parquet') WHERE html IS NOT NULL").fetchall():
        assert extract(html) == plain_extract(html)


@pytest.mark.parametrize("seed", range(200))
def test_no_page_raises(seed):
    rng = np.random.default_rng(seed)
    pieces = ["<", ">", "!", "[", "]", "CDATA", "-", "?", "/", "p", "div", " ", "&", "#", "x41;", '"', "'", "=", "script", "<!DOCTYPE", "<![if x]>", "<?x", "\x00", "é", "<!--", "-->", "<!ELEMENT", "<textarea>"]
    assert isinstance(extract("".join(rng.choice(pieces, 40))), str)
