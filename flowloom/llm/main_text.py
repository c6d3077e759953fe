"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines: a line ends where a
block element begins or ends, and keeps its text, its number of tags, the text of its links
and the elements it is in. The ratio is that of text outside links to tags, to which a
link's text counts as one more for each ``LINK`` characters, so that menus and lists of
links have a low one. It is smoothed with a Gaussian over the neighbouring lines. Two
means of the logarithms of all ratios part the lines in two clusters; where these are less
than a factor ``APART`` from each other, they are one. Lines of the upper cluster are content.

Lines of the upper cluster make regions, which grow over the lines beside them, however short.
One inside an ``article`` or ``main`` takes all lines of it. Elsewhere lines of
the upper cluster make one region if they are in the same container or at most ``NEAR``
lines with text apart; it holds all lines from its first one to the end of the element that
holds them all, and the headings before it. Beside a region inside such an element, one
outside counts only if it is as dense.

Elements, roles, classes and ids only break up regions: no region grows over menus, headers,
and what else is beside an article. They say nothing of whether such a part is
content: lists of links are left out as their ratio is low. Only prose that is
not the article's, which no ratio can tell from it, is no region at all: reader comments,
notices, adverts, sidebars, footers, forms, teasers, and menus and headers of which less
than half is links.

Class, id, role and element are judged after parsing: an element that holds most of the
page's text, or the only ``article`` or ``main``, breaks nothing. Inside an article a class
counts by any word, and an id by all of its words, if the element has less than ``PART`` of the
article's text, else classes by whole names only. Scripts, styles, form fields, hidden elements and the page's head
have no text.

A null or empty page, or one without text, has an empty main text; an empty table stays
empty. Rows that repeat are read each by itself. A long page is read whole; a line's ratio
grows with its text up to ``LONG_LINE`` characters and stays there, and all of its text is
kept. Other columns stay; one called text or n_chars, but the page itself, is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import add_columns, quoted

#: Width of the Gaussian in lines, characters of link text that count as a tag, and the factor between two clusters.
SIGMA, LINK, APART = 1.0, 4, 3.0
#: Characters of a line's text beyond which more do not raise its ratio.
LONG_LINE = 400
#: Lines with text by which lines of a region are apart at most, and the share of a page's text that no class or role breaks off.
NEAR, MOST = 3, 2 / 3
#: The share of an article's text below which an element in it is judged by any word of its class or id.
PART = 1 / 3

#: Elements by what they do to lines.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select button datalist applet map".split())
CONTENT = frozenset(("article", "main"))
#: Elements beside an article, of which SOFT may turn out to hold it, and blocks that hold a line, no region.
BESIDE = frozenset("nav footer menu dialog".split())
SOFT = frozenset("form aside".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dd dt pre blockquote figure figcaption caption address summary table thead tbody tfoot tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name prose that is not the article's, and parts told by their ratio.
PROSE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner "
    "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular more teaser teasers "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "form search share sharing social "
    "comment comments commentlist respond reply replies disqus discussion "
    "footer bottombar colophon copyright".split()
)
MENU_WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar".split()
)
#: Elements and roles that hold such prose.
PROSE_ELEMENTS = frozenset("form aside dialog footer".split())
PROSE_ROLES = frozenset("contentinfo complementary search form dialog alert alertdialog".split())
#: Words that begin a class which only tells of the layout, and those that mean an article's own title inside it.
LAYOUT = frozenset(("has", "with", "no", "without", "is"))
TITLES = frozenset(("header", "banner"))
#: Words of ids that a section of an article may have too.
SECTIONS = frozenset(("discussion", "search", "form", "more", "related", "alert"))
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


#: What an element's names say: nothing, that it is beside an article, and that it holds other prose.
NOTHING, BREAKS, PROSE = 0, 1, 2
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


class LineParser(HTMLParser):
    """Collects (text, tags, characters of links, innermost element, heading) for each line, and the elements.

    Elements are numbered as they begin, so that what is in one has numbers up to its last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # element, silent, content, number
        self.count: Counter[str] = Counter()  # of open elements by name
        self.silent = 0
        self.content = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.names = [""]  # the page itself is element 0
        self.parents = [0]
        self.last = [0]
        self.beside = [NOTHING]
        self.part = [NOTHING]  # what it is if it has little of an article's text
        self.article = [False]

    def close_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text or self.tags:
            heading = any(x[0] in HEADINGS for x in self.open[-3:])
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.open[-1][3] if self.open else 0, heading))
        self.parts.clear()
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br" and not self.silent:
                self.parts.append(" ")
            elif tag == "hr":
                self.close_line()
            self.tags += 1
            return
        if tag in BLOCKS:
            self.close_line()
            if self.open and self.open[-1][0] == tag and tag in ("p", "li", "dd", "dt", "td", "th", "tr", "option"):
                self.drop()
            elif tag not in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self.end_paragraph()
        self.tags += 1
        hidden = any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and v and _HIDDEN.search(v)) for n, v in attrs)
        silent = tag in SILENT or (hidden and tag not in ("html", "body", "main"))
        inside = self.content > 0 or tag in CONTENT
        own = PROSE if tag in PROSE_ELEMENTS else BREAKS if tag in BESIDE or (tag == "header" and not self.content) else NOTHING
        named = attrs if tag not in ("html", "body", "main") else []
        beside = max(own, _named(named, inside))
        content = tag in CONTENT and not silent and not beside
        self.open.append((tag, silent, content, len(self.names)))
        self.count[tag] += 1
        self.names.append(tag)
        self.parents.append(self.open[-2][3] if len(self.open) > 1 else 0)
        self.last.append(len(self.last))
        self.beside.append(beside)
        self.part.append(_named(named, False, True) if self.content and tag not in HEADINGS else NOTHING)
        self.article.append(content)
        self.silent += silent
        self.content += content

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self.close_line()

    def end_paragraph(self) -> None:
        """A block begins: an open paragraph, and the inline elements in it, end."""
        if not self.count["p"]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p":
                while len(self.open) > i:
                    self.drop()
                return
            if name in BLOCKS or self.open[i][1]:
                return

    def drop(self) -> None:
        tag, silent, content, number = self.open.pop()
        self.count[tag] -= 1
        self.last[number] = len(self.names) - 1
        self.silent -= silent
        self.content -= content

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close_line()
        elif tag == "br" and not self.silent:
            self.parts.append(" ")
        self.tags += 1
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.drop()
                return
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data)


def _named(attrs: list[tuple[str, str | None]], whole: bool, part: bool = False) -> int:
    """What class, id and role say of an element; of ``whole`` class names if asked, which leaves ids
    out. The id of a ``part`` of an article must be all such words, and none that a section may have."""
    found = NOTHING
    for name, value in attrs:
        if value and name in ("class", "id"):
            if whole and name == "id":
                continue
            words = set()
            for one in value.split():
                parts = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())
                if parts and parts[0] not in LAYOUT:
                    words.update(parts if not whole or (PROSE_WORDS | MENU_WORDS).issuperset(parts) else ())
            if whole:
                words -= TITLES
            if part and name == "id" and not (words and (PROSE_WORDS | MENU_WORDS) - SECTIONS >= words):
                continue
            found = max(found, NOTHING if words.isdisjoint(PROSE_WORDS | MENU_WORDS) else BREAKS if words.isdisjoint(PROSE_WORDS) else PROSE)
        elif value and name == "role" and value.lower() in ROLES:
            found = max(found, PROSE if value.lower() in PROSE_ROLES else BREAKS)
    return found


def _sums(parser: LineParser, own: list[int]) -> list[int]:
    """Each element's own number and those of all in it."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parser.parents[i]] += out[i]
    return out


def _places(parser: LineParser) -> tuple[list[int], list[int]]:
    """What each element is beside an article, and the outermost article that each is in (0: none)."""
    size = len(parser.names)
    own, links = [0] * size, [0] * size
    for text, _, linked, at, _ in parser.lines:
        own[at] += len(text)
        links[at] += linked
    chars, links = _sums(parser, own), _sums(parser, links)
    beside = [b if parser.names[i] in BESIDE or chars[i] < MOST * chars[0] else NOTHING for i, b in enumerate(parser.beside)]
    beside = [PROSE if b == BREAKS and 2 * links[i] < chars[i] else b for i, b in enumerate(beside)]
    articles = _sums(parser, [int(a and chars[i] > 0) for i, a in enumerate(parser.article)])

    def spread() -> tuple[list[int], list[int]]:
        what, inside = [NOTHING] * size, [0] * size
        for i in range(1, size):
            above = parser.parents[i]
            article = inside[above]
            small = article and parser.names[i] in BLOCKS and chars[i] < PART * chars[article]
            what[i] = max(what[above], beside[i], parser.part[i] if small else NOTHING)
            inside[i] = 0 if what[i] else article or (i if parser.article[i] else 0)
        return what, inside

    what, inside = spread()
    if articles[0] and not any(inside[at] and text for text, _, _, at, _ in parser.lines):
        beside = [b if not articles[i] else NOTHING for i, b in enumerate(beside)]
        what, inside = spread()
    return what, inside


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters of its links
    at: int  # the innermost element
    heading: bool
    beside: int
    article: int  # the outermost article or main, 0 if there is none


def lines_of(html: str) -> tuple[list[Line], LineParser]:
    """The lines with text or tags, and the elements."""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.close_line()
    while parser.open:
        parser.drop()
    parser.last[0] = len(parser.names) - 1
    beside, inside = _places(parser)
    return [Line(text, tags, linked, at, heading, beside[at], inside[at]) for text, tags, linked, at, heading in parser.lines], parser


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weights


def _containers(parser: LineParser) -> list[int]:
    """For a line in each element, the element that holds its paragraph, list or table beside others."""
    names, parents = parser.names, parser.parents
    block, region = [0] * len(names), [0] * len(names)
    for i in range(1, len(names)):
        block[i] = i if names[i] in BLOCKS else block[parents[i]]
        region[i] = i if names[i] in BLOCKS and names[i] not in LINES else region[parents[i]]
    return [region[parents[b] if names[b] in ("td", "th") else b] for b in block]


def ratio(text: int, linked: int, tags: int) -> float:
    """Characters outside links over tags, to which links count by their text."""
    return min(text - linked, LONG_LINE) / (max(tags, 1) + linked / LINK)


def ratios(lines: list[Line]) -> np.ndarray:
    """The smoothed text-to-tag ratio of each line."""
    return smooth(np.array([ratio(len(x.text), x.linked, x.tags) for x in lines], np.float64))


def two_means(values: np.ndarray) -> float:
    """The least value of the upper of two clusters, those with the least squares within."""
    v = np.sort(values)
    n = np.arange(1, len(v))
    sums = np.cumsum(v)
    left, right = sums[:-1], sums[-1] - sums[:-1]
    if not len(n) or v[0] == v[-1]:
        return float(v[0])
    at = int(np.argmax(left**2 / n + right**2 / (len(v) - n))) + 1
    return float(v[at] if v[at:].mean() - v[:at].mean() >= np.log(APART) else v[0])


@dataclass
class Region:
    first: int
    last: int
    held: int  # the element that holds its lines
    article: bool
    heights: list[float]


def content_lines(lines: list[Line], parser: LineParser) -> np.ndarray:
    """Which lines are content: those of the upper cluster, and what their regions grow over."""
    full = np.array([x.text != "" for x in lines])
    beside = np.array([x.beside for x in lines])
    height = np.log1p(ratios(lines))
    high = full & (height >= two_means(height[full])) & (beside != PROSE)
    place = np.cumsum(full)
    containers = _containers(parser)
    regions: list[Region] = []
    for i in np.flatnonzero(high).tolist():
        line, last = lines[i], regions[-1] if regions else None
        own = line.article or containers[line.at]
        if last and last.article == (line.article > 0) and (own == last.held or (not line.article and (place[i] - place[last.last] <= NEAR or line.at <= parser.last[last.held]))):
            while not last.held <= own <= parser.last[last.held]:
                last.held = parser.parents[last.held]
            last.last = i
            last.heights.append(height[i])
        else:
            regions.append(Region(i, i, own, line.article > 0, [height[i]]))
    inside = [h for r in regions if r.article for h in r.heights]
    out = np.zeros(len(lines), bool)
    for r in regions:
        if inside and not r.article and np.mean(r.heights) < np.mean(inside):
            continue
        first, after = r.first, r.last + 1
        while after < len(lines) and r.held <= lines[after].at <= parser.last[r.held]:
            after += 1
        while first and (r.held <= lines[first - 1].at <= parser.last[r.held] if r.article else lines[first - 1].heading or not full[first - 1]):
            first -= 1
        out[first:after] |= high[first:after] | (beside[first:after] == NOTHING)
    return out & full


def main_text(html: str) -> str:
    lines, parser = lines_of(html) if html else ([], None)
    if not any(x.text for x in lines):
        return ""
    return "\n\n".join(lines[i].text for i in np.flatnonzero(content_lines(lines, parser)))


def extract_main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with text, the main text of each page, and n_chars long (its code points)."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (pages,) in batches:
            yield [[main_text(page.as_py() or "") for page in pages]]

    gone = {"text", "n_chars"}
    out = add_columns(df, [html], "text string", run)
    kept = [c for c in out.columns if c.lower() not in gone]
    return out.select(*[F.col(quoted(c)) for c in kept], "text", F.length("text").cast("long").alias("n_chars"))
