"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser sends its events into a list of lines: a line is the text between two
block-level tags, with the number of tags met on the way.  A line's ratio of characters to tags,
smoothed over its neighbours with Gaussian weights, is high inside running text; lines over a threshold
are the content cluster.  The article is the part of the page that holds that cluster: its element, and
in it every line that is not inside a menu, notice, advert, form or the like.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import map_texts

#: Fixed values of HTML: elements without an end, elements that end a line, elements that are no text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NO_TEXT = set(
    "aside button canvas dialog footer form head iframe input label legend math menu nav noscript "
    "object optgroup option script select style svg template textarea title".split()
)
#: Words of a class, id or role that mark what does not belong to an article.
NO_ARTICLE = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies dialog disqus footer form gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pagination popup promo "
    "promoted promotion recommended related replies search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription teaser toolbar tooltip widget widgets".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Gaussian weights of a line and its two neighbours on either side.
SIGMA = 1.0
WEIGHTS = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(3)]
#: An article that holds less than this share of the largest one's text is a teaser.
LEAST_ARTICLE = 0.25
MOST_LINKS = 0.5


class Line:
    __slots__ = ("parts", "tags", "linked", "place", "article", "main", "dropped", "text")

    def __init__(self):
        self.parts, self.tags, self.linked, self.text = [], 0, 0, ""


class Lines(HTMLParser):
    """Collects the lines of a page and the element that each one stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.line = Line()
        self.open: list[tuple[str, bool]] = []  # name, and whether its text is dropped
        self.counts: dict[str, int] = {}
        self.dropping = 0
        self.places = [(0, "")]  # parent and name of every block element
        self.place = [0]
        self.article = self.main = 0

    def handle_starttag(self, tag, attrs):
        self.line.tags += 1
        if tag in BLOCK:
            if self.counts.get("p") and tag != "br":
                self._close("p")
            if tag == "li" and self.counts.get("li"):
                self._close_sibling("li", ("ul", "ol", "menu"))
            self._end_line()
        if tag in VOID:
            return
        # A header inside an article holds its title.
        drop = tag in NO_TEXT or (tag == "header" and not (self.article or self.main))
        if tag == "article" and self.article:
            drop = True  # an article inside an article is a reader's comment
        if attrs and not drop:
            drop = tag not in ("html", "body") and self._unwanted(attrs)
        self.open.append((tag, drop))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.dropping += drop
        if tag in BLOCK:
            self.places.append((self.place[-1], tag))
            self.place.append(len(self.places) - 1)
            if tag == "article" and not self.article:
                self.article = self.place[-1]
            elif tag == "main" and not self.main:
                self.main = self.place[-1]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.line.tags += 1
        if self.counts.get(tag):
            self._close(tag)
        elif tag in BLOCK:
            self._end_line()

    def handle_data(self, data):
        if not self.dropping:
            self.line.parts.append(data)
            if self.counts.get("a"):
                self.line.linked += len(data)

    def _unwanted(self, attrs) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role"):
                if value and any(w.lower() in NO_ARTICLE for w in WORDS.findall(value)):
                    return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            elif name == "style" and value and HIDDEN.search(value):
                return True
        return False

    def _close(self, tag):
        """End the innermost open ``tag`` and what was left open inside it."""
        if tag in BLOCK or any(t in BLOCK for t, _ in self._above(tag)):
            self._end_line()
        while True:
            name, drop = self.open.pop()
            self.counts[name] -= 1
            self.dropping -= drop
            if name in BLOCK:
                at = self.place.pop()
                self.article = 0 if at == self.article else self.article
                self.main = 0 if at == self.main else self.main
            if name == tag:
                return

    def _above(self, tag):
        for entry in reversed(self.open):
            if entry[0] == tag:
                return
            yield entry

    def _close_sibling(self, tag, stops):
        for name, _ in reversed(self.open):
            if name in stops:
                return
            if name == tag:
                self._close(tag)
                return

    def _end_line(self):
        line = self.line
        if line.parts:
            line.text = " ".join("".join(line.parts).split())
            if line.text:
                line.parts = []
                line.place, line.article, line.main = self.place[-1], self.article, self.main
                self.lines.append(line)
        self.line = Line()

    def close(self):
        super().close()
        self._end_line()


def _content(lines: list[Line]) -> list[Line]:
    """The lines whose smoothed ratio reaches the spread of all of them (or their mean, if less)."""
    ratios = [len(x.text) / max(1, x.tags) for x in lines]
    n, smooth = len(lines), []
    for i in range(n):
        near = [(abs(k), ratios[i + k]) for k in range(-2, 3) if 0 <= i + k < n]
        weights = sum(WEIGHTS[k] for k, _ in near)
        smooth.append(sum(WEIGHTS[k] * r for k, r in near) / weights)
    mean = sum(smooth) / n
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / n)
    threshold = min(mean, spread)
    return [x for x, s in zip(lines, smooth) if s >= threshold]


def _sizes(lines: list[Line], of) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in lines:
        out[of(x)] = out.get(of(x), 0) + len(x.text)
    return out


def _article(lines: list[Line], content: list[Line], places) -> list[Line]:
    """All lines of the elements that hold the content."""
    total = sum(len(x.text) for x in content)
    for of in (lambda x: x.article, lambda x: x.main):
        sizes = _sizes(content, of)
        if 2 * sum(n for k, n in sizes.items() if k) >= total:
            largest = max(n for k, n in sizes.items() if k)
            chosen = {k for k, n in sizes.items() if k and n >= LEAST_ARTICLE * largest}
            return [x for x in lines if of(x) in chosen]
    # No such element: the innermost one that holds most of the content.
    held: dict[int, int] = {}
    for x in content:
        at = x.place
        while True:
            held[at] = held.get(at, 0) + len(x.text)
            if not at:
                break
            at = places[at][0]
    at = max((k for k, n in held.items() if 10 * n >= 8 * total), default=0)
    inside = {at}
    for k in range(at + 1, len(places)):
        if places[k][0] in inside:
            inside.add(k)
    kept = [x for x in lines if x.place in inside and x.linked <= MOST_LINKS * len(x.text)]
    return kept or content


def main_text(html: str | None) -> str:
    """The article of a page: one space inside and between its lines; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    return " ".join(x.text for x in _article(lines, _content(lines), parser.places))


def extracted(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: its id and url, text and n_chars (code points of the text).

    Null, empty and text-free pages have an empty text. Null ids and urls and repeated rows come back
    as they are; broken markup is read as far as it goes. Other columns are not read.
    """

    def make():
        def one(value):
            text = main_text(value)
            return text, len(text)

        return one

    return map_texts(pages, [F.col(page_id), F.col(url)], html, make, "text string, n_chars bigint")
