"""Main text of web pages: parser events, text-to-tag ratios of lines, smoothing, and clusters of content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by what they mean to a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title select datalist textarea button".split())
CHROME = frozenset("nav footer aside form menu dialog search".split())
MAIN = frozenset("article main".split())
SECTIONS = frozenset("article body center div main section table".split())
CLOSES_P = BLOCK - frozenset("html head body title caption tbody td tfoot th thead tr legend option optgroup summary".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select", "menu")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation navigations menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget pagination pager "
    "copyright legal disclaimer skip tags complementary contentinfo search".split()
)
#: Of these, words of what readers write: where it outweighs the article, it is still none.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words before a mark that tell what a wrapper has beside the article, as in has-sidebar.
BESIDE = frozenset("has have with no without hide show is".split())
SPACE = re.compile(r"\s+")
SIGMA = 1.0
#: What an element's mark leaves of the score of its lines.
MARKED = 0.1


def marks_of(value: str) -> set[str]:
    """The words of ``MARKS`` in a class, id or role attribute, without those that only tell what stands beside."""
    found = set()
    for name in value.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if BESIDE.isdisjoint(words):
            found.update(MARKS.intersection(words))
    return found


class _Events(HTMLParser):
    """Turns a page into lines: (text, tags, heading, mark, section), in page order, without what is never shown as text.

    A line is the text between two block boundaries, tags how many were met since the line before, heading whether it is one, mark the number of the
    innermost marked element around it (0: none), section that of the innermost sectioning element. ``parent`` and ``kind`` tell of each section its parent's
    number and its tag; 0 is the page. ``marks`` holds (the mark around it, why) of each marked element: element, form, class or reader. ``mains`` holds (section, mark) of each
    article and main element. All are numbered as they open. Inline elements aren't marked. Each event costs the same, however deep the page is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, mark, main, hidden
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of block elements
        self.lines: list[tuple[str, int, bool, int, int]] = []
        self.parts: list[str] = []
        self.parent, self.kind, self.path = [0], [""], [0]
        self.marks: list[tuple[int, str]] = [(0, "")]
        self.mains: list[tuple[int, int]] = []
        self.tags = 0

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            mark = self.stack[-1][1] if self.stack else 0
            self.lines.append((text, self.tags, any(e[0] in HEADINGS for e in self.stack[-2:]), mark, self.path[-1]))
            self.tags = 0
        self.parts.clear()

    def _pop(self, n: int) -> None:
        if self.blocks and self.blocks[-1] >= n:
            self._flush()
        while len(self.stack) > n:
            self._close(self.stack.pop()[0])

    def _close(self, tag: str) -> None:
        at = self.open[tag].pop()
        if self.blocks and self.blocks[-1] == at:
            self.blocks.pop()
        if tag in SECTIONS:
            self.path.pop()

    def _last(self, tags) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += not self._hidden()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            return
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self._pop(self.blocks[-1])
        if tag in SELF_CLOSING and (at := self._last(SELF_CLOSING[tag])) > self._last(LISTS):
            self._pop(at)
        _, mark, above_main, above_hidden = self.stack[-1] if self.stack else ("", 0, False, False)
        words, hidden = set(), tag in HIDDEN
        for name, value in attrs:
            if name in ("class", "id", "role"):
                words |= marks_of(value or "")
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
        why = ""
        if tag == "form":
            why = "form"
        elif tag in CHROME or (tag == "header" and not above_main):
            why = "element"
        elif tag == "article" and above_main and not READERS.isdisjoint(words):
            why = "reader"
        elif words and tag in BLOCK and tag not in MAIN and tag not in ("body", "html"):
            why = "class" if READERS.isdisjoint(words) else "reader"
        if why:
            self.marks.append((mark, why))
            mark = len(self.marks) - 1
        at = len(self.stack)
        self.stack.append((tag, mark, above_main or tag in MAIN, above_hidden or hidden))
        self.open.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SECTIONS:
            self.parent.append(self.path[-1])
            self.kind.append(tag)
            self.path.append(len(self.parent) - 1)
            if tag in MAIN:
                self.mains.append((self.path[-1], mark))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self._hidden()
        at = self._last((tag,))
        if at < 0:
            if tag in ("br", "p"):
                self.parts.append(" ")
        elif tag in BLOCK or not self.blocks or at >= self.blocks[-1]:  # an inline end tag does not close a block
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self._hidden():
            self.parts.append(data)

    def _hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][3]

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown marked section: a bogus comment up to the next >
            return self.parse_bogus_comment(i)

    def finish(self) -> None:
        self.close()
        self._flush()
        self.stack.clear()


def _smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; weights are renormalised at the ends."""
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    full = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of a page: its blocks in page order, joined by an empty line.

    Text-to-tag ratios of lines are smoothed with a Gaussian; what an element, class, id or role marks as a menu, page header, footer, sidebar, notice, advert, form or
    reader's comment keeps a tenth of its ratio and of its score, but for marks of elements around the article (``_live_marks``). Lines at the middle between the two
    clusters' centers or above are content. They choose the region: the innermost section that holds nearly all of their text, or the article or main element
    around it. Of it all unmarked lines are taken, and marked ones that are content all the same; so are content lines outside it, in page order, and an unmarked
    heading just before the first. Where only the page itself holds them, the region reaches from the first content line to the last. Null or empty html, and pages of which
    all is marked, give ''.
    """
    if not html:
        return ""
    parser = _Events()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    live = _live_marks(parser, sigma)
    depth = np.zeros(len(live), np.int64)
    for k in range(1, len(live)):  # inner marks have larger numbers
        depth[k] = depth[parser.marks[k][0]] + live[k]
    marked = depth[[x[3] for x in lines]]
    plain = marked == 0
    if not plain.any():
        return ""
    content = content_lines([(len(x[0]), x[1], MARKED**n) for x, n in zip(lines, marked.tolist())], sigma)
    section = _section(parser, content)
    if section:
        inside = np.zeros(len(parser.parent), bool)
        for k in range(section, len(inside)):
            inside[k] = k == section or inside[parser.parent[k]]
        picked = content | (plain & inside[[x[4] for x in lines]])
    else:
        at = np.flatnonzero(content)
        picked = content | (plain & (np.arange(len(lines)) >= at[0]) & (np.arange(len(lines)) <= at[-1]))
    first = int(picked.argmax())
    if first and lines[first - 1][2] and plain[first - 1]:
        picked[first - 1] = True
    return "\n\n".join(x[0] for x, keep in zip(lines, picked) if keep)


def _live_marks(parser: _Events, sigma: float) -> np.ndarray:
    """Which marks count: not those of a class, id, role or form around the article.

    That is each article or main element, outside of elements that are never the article's and of readers' comments, with at least half as much text as the largest in
    lines that are content by their ratios alone; where there is none, what holds at least half of that text, readers' comments left out.
    """
    kinds = [why for _, why in parser.marks]
    live = np.array([bool(why) for why in kinds])
    if not live.any():
        return live
    firm = np.zeros(len(live), bool)  # inside an element that is never the article's, or in comments
    for k in range(1, len(live)):
        firm[k] = kinds[k] in ("element", "reader") or firm[parser.marks[k][0]]
    content = content_lines([(len(x[0]), x[1], 1.0) for x in parser.lines], sigma)
    size, held = np.zeros(len(parser.parent), np.int64), np.zeros(len(live), np.int64)
    for x, is_content in zip(parser.lines, content.tolist()):
        if is_content and not firm[x[3]]:
            size[x[4]] += len(x[0])
            held[x[3]] += len(x[0])
    total = size.sum()
    for k in range(len(size) - 1, 0, -1):
        size[parser.parent[k]] += size[k]
    for k in range(len(held) - 1, 0, -1):
        held[parser.marks[k][0]] += held[k]
    mains = [(int(size[at]), mark) for at, mark in parser.mains if size[at] and not firm[mark]]
    if mains:
        for held_by, mark in mains:
            while mark and 2 * held_by >= max(mains)[0]:
                live[mark] = False
                mark = parser.marks[mark][0]
    elif total:
        live &= firm | (2 * held < total)
    return live


def content_lines(lines: list[tuple[int, int, float]], sigma: float = SIGMA) -> np.ndarray:
    """Which lines (characters, tags, weight) lie in the upper of two clusters of smoothed text-to-tag ratios; at least one."""
    chars, tags, weight = np.array(lines, float).T
    score = weight * _smooth(weight * chars / np.maximum(1, tags), sigma)
    return score >= _threshold(score)


def _section(parser: _Events, content: np.ndarray, share: float = 0.9) -> int:
    """The innermost section with ``share`` of the content lines' text, or the article or else main element around it; 0 if that is the page."""
    size = np.zeros(len(parser.parent), np.int64)
    for x, is_content in zip(parser.lines, content):
        if is_content:
            size[x[4]] += len(x[0])
    total = size.sum()
    for k in range(len(size) - 1, 0, -1):  # inner sections have larger numbers
        size[parser.parent[k]] += size[k]
    found = int(np.flatnonzero(size >= share * total)[-1])
    around: dict[str, int] = {}
    at = found
    while at:
        around.setdefault(parser.kind[at], at)
        at = parser.parent[at]
    return around.get("article") or around.get("main") or (0 if parser.kind[found] == "body" else found)


def _threshold(values: np.ndarray) -> float:
    """Midway between two cluster centers (one-dimensional 2-means from the extremes); the least value if all are equal."""
    low, high = float(values.min()), float(values.max())
    if high - low <= 1e-9 * high:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        a, b = values[values < cut], values[values >= cut]
        new = (float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars bigint) for every row of ``pages``; n_chars counts code points.

    Null ids and urls are passed on; other columns are not read. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind(id_col)}, `{url_col}` {kind(url_col)}, text string, n_chars bigint")
