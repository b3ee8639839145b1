"""Main text of web pages by text-to-tag ratio (operator 5).

The standard library's parser streams tags and texts of a page.  They are
gathered into lines, one per block element, each with its text, the number of
tags met on the way, the containers it lies in and whether it belongs to
furniture: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, known by element or by a word of class, id or role.

Each line's ratio of text characters to tags is smoothed by a Gaussian over the
lines of the page.  Lines at or above a threshold, a share of the ratios'
standard deviation, form the clusters of content; furniture has ratio 0.  The
clusters choose the content region: the outermost article elements (else main
elements) that hold lines of clusters, if at least half of the clusters' text is in
them, else the smallest container that covers every line of the clusters and
every heading, or the page where none does.  All lines of the region that are no
furniture are the text, short ones too, but for lists of links: containers of
three lines or more that are links throughout and whose own ratios are all below
the threshold.  Articles inside furniture count only where no others are, and then
the one with most text of the clusters.

Character references are decoded as HTML5 does, white space inside a line
becomes one space, lines are trimmed, empty ones left out and the rest joined by
a line feed.  A null or empty page, or one without content, gives an empty text.
Unclosed and stray tags are tolerated: an end tag closes what is open inside it,
and one that matches nothing is ignored; an article that starts inside unclosed
furniture ends it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SIGMA = 1.0
THRESHOLD = 0.5  # standard deviations

BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th wbr img option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("aside button canvas dialog footer form head header iframe input label menu nav noscript object script select style svg template textarea title".split())
_WORDS = ("ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disclaimer|disqus|footer|gdpr|header|masthead|"
          "menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget")
# A name that goes on with a preposition is a phrase about the text ("notice-of-results").
_CLASS = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])(?!(?:about|for|from|in|of|on|to)(?:$|[\s_-]))", re.I)
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
# Elements that a new paragraph or item of the same kind ends.
_ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


class Lines(HTMLParser):
    """Events of one page gathered into lines (text, tags, containers, furniture)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, container number, furniture
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.kinds: list[str] = []  # element of each container
        self.ended: dict[int, list[int]] = {}  # place in ``open`` of furniture that articles ended: those articles
        self.enclosed: set[int] = set()  # articles whose furniture was closed after them
        self.parts: list[str] = []
        self.tags = 0
        self.plain = False  # the line has text outside links
        self.linked: list[bool] = []  # of each line: it is a link throughout

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, tuple(c for _, c, _ in self.open if c >= 0), any(f for *_, f in self.open)))
            self.linked.append(not self.plain)
            self.tags = 0
        self.parts, self.plain = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        if self.open and tag in _ENDED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        elif tag in BLOCKS:
            self._close_paragraph(tag)
        self.tags += 1
        if tag in SPACES:
            self.parts.append(" ")
        if tag in VOID:
            return
        self.ended = {k: a for k, a in self.ended.items() if k < len(self.open)}
        if tag in ("article", "main") and not any(t in ("article", "main") for t, *_ in self.open):
            self.ended |= {k: [] for k, (*_, f) in enumerate(self.open) if f}
            for articles in self.ended.values():
                articles.append(len(self.kinds))
            self.open = [(t, c, False) for t, c, _ in self.open]
        furniture = tag in FURNITURE
        for name, value in attrs:
            if value and tag not in ("body", "html", "article", "main"):
                furniture |= name in ("class", "id") and bool(_CLASS.search(value)) or name == "role" and value.lower() in _ROLES
        if furniture and tag == "header" and any(t == "article" for t, *_ in self.open) and not any(f for *_, f in self.open):
            furniture = False  # the heading of the article itself
        container = -1
        if tag in BLOCKS and tag != "p":
            container = len(self.kinds)
            self.kinds.append(tag)
        self.open.append((tag, container, furniture))

    def _close_paragraph(self, tag: str) -> None:
        """A block ends an open paragraph, with the inline elements left open in it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "p":
                del self.open[k:]
                return
            if self.open[k][0] in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.enclosed.update(self.ended.get(k, ()))
                self.ended = {at: a for at, a in self.ended.items() if at < k}
                del self.open[k:]
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if any(f and t not in BLOCKS for t, _, f in self.open):
            return  # a script, button or the like inside a line
        self.parts.append(data)
        self.plain = self.plain or not (data.isspace() or any(t == "a" for t, *_ in self.open))


def lines_of(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser


def content_lines(ratios: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines are in the clusters of content, from their text-to-tag ratios."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    # The kernel is cut off at the page's ends, so weights are summed as well.
    smooth = np.convolve(ratios, kernel)[reach:reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return smooth >= threshold * ratios.std()


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = lines_of(html)
    lines = page.lines
    if not any(not furniture for *_, furniture in lines):
        return ""
    ratios = np.array([0.0 if furniture else len(text) / max(1, tags) for text, tags, _, furniture in lines])
    content = content_lines(ratios)
    own = [(len(text) * bool(c), containers) for (text, _, containers, furniture), c in zip(lines, content) if not furniture]
    if not any(n for n, _ in own):
        return ""
    region = _named(page, own) or _covering(page, own)
    links = _link_lists(page, ratios)
    return "\n".join(text for text, _, containers, furniture in lines
                     if not furniture and (not region or not region.isdisjoint(containers)) and links.isdisjoint(containers))


def _named(page: Lines, own: list) -> set[int]:
    """The article (else main) elements that hold lines of clusters; none if most of the clusters' text lies outside."""
    for kind in ("article", "main"):
        held: dict[int, int] = {}
        for n, containers in own:
            c = next((c for c in containers if page.kinds[c] == kind), None)
            if c is not None and n:
                held[c] = held.get(c, 0) + n
        chosen = held.keys() - page.enclosed or ({max(held, key=lambda c: (held[c], -c))} if held else set())
        if chosen and 2 * sum(held.values()) >= sum(n for n, _ in own):
            return set(chosen)
    return set()


def _covering(page: Lines, own: list) -> set[int]:
    """The smallest container of all lines of clusters and all headings; containers are numbered from the outside in."""
    must = [set(containers) for n, containers in own if n or any(page.kinds[c] in HEADINGS for c in containers)]
    shared = [c for c in set.intersection(*must) if page.kinds[c] not in HEADINGS and page.kinds[c] != "li"] if must else []
    return {max(shared)} if shared else set()


def _link_lists(page: Lines, ratios: np.ndarray, threshold: float = THRESHOLD) -> set[int]:
    """Containers of links alone, three lines or more, without a line of a high ratio of its own."""
    low = ratios < threshold * ratios.std()
    lines: dict[int, int] = {}
    other: set[int] = set()
    for (_, _, containers, furniture), linked, below in zip(page.lines, page.linked, low):
        for c in containers:
            if linked and below and not furniture:
                lines[c] = lines.get(c, 0) + 1
            elif not furniture:
                other.add(c)
    return {c for c, n in lines.items() if n >= 3 and c not in other}


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text): one row per page."""
    def run(_, htmls: pa.Array) -> dict:
        return {"text": pa.array([extract(h) for h in htmls.to_pylist()], pa.string())}

    return map_texts(pages, run, "text string", id_col, html_col, {url_col: F.col(url_col)})
