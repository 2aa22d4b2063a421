"""Operator 1: main text of HTML pages from parser events and smoothed text-to-tag ratios.

The standard library's streaming parser reports tags and text. Block elements cut a page
into lines; a line's ratio is its characters over its tags. Ratios are smoothed by a
Gaussian over neighbouring lines, a threshold clusters them into content and the rest,
and regions (the lines of one sectioning element) with content lines are selected.
Elements that say what they are take part in two ways: navigation, forms and the like
are never content, and lines of an article or main element need a smaller ratio. The
ratios decide between all other regions, inside an article and outside.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .shared import small_batches

SIGMA = 1.0
REACH = 3
LINKED = 0.6
# Content lines of an article or main element need a ratio so many times smaller.
WEIGHT = 2.0
# Kinds of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
SPACED = frozenset("br td th img wbr".split())
REGIONS = frozenset("article body div main section table ul ol dl".split())
ARTICLES = frozenset(("article", "main"))
UNREAD = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input menu nav noframes noscript object script search select style svg template textarea title video".split()
)
UNREAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
UNREAD_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|sidebar|side|aside|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|comments?|commentlist|disqus|respond|replies|reader-comments|related|recommend\w*|shar(?:e|ing)|social"
    r"|newsletter|subscribe|signup|login|search\w*|widgets?|pagination|pager|form)(?:$|[-_\s\d])",
    re.I,
)
# An open element of the key ends where one of these starts.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())


class _Line:
    __slots__ = ("parts", "tags", "linked", "region", "article", "unread")

    def __init__(self, region: int, article: bool, unread: bool):
        self.parts, self.tags, self.linked = [], 0, 0
        self.region, self.article, self.unread = region, article, unread


class PageEvents(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Per open element: tag, unread, region, inside an article, inside a link.
        self.open = [("", False, 0, False, False)]
        self.regions, self.lines = 0, []
        self._new_line()

    def _new_line(self):
        _, unread, region, article, _ = self.open[-1]
        self.lines.append(_Line(region, article, unread))

    def handle_starttag(self, tag, attrs):
        for name, enders in ENDED_BY.items():
            if tag in enders:
                self._close(name, within=True)
        _, unread, region, article, linked = self.open[-1]
        if tag == "br" or tag in SPACED:
            self.lines[-1].parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._new_line()
            self.lines[-1].tags += 1
            return
        if not unread:
            # The names of a whole page or article tell what it has beside the text; an article in an article is a part.
            whole = tag in ("html", "body", "main") or tag == "article" and all(e[0] != "article" for e in self.open)
            unread = tag in UNREAD or tag == "header" and not article or self._says_unread(attrs, whole)
        if tag in REGIONS:
            self.regions += 1
            region = self.regions
        self.open.append((tag, unread, region, article or tag in ARTICLES and not unread, linked or tag == "a"))
        if tag in BLOCKS or unread != self.open[-2][1]:
            self._new_line()
        self.lines[-1].tags += 1

    @staticmethod
    def _says_unread(attrs, whole) -> bool:
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in UNREAD_ROLES:
                return True
            if name in ("class", "id") and not whole and UNREAD_NAME.search(value):
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use"):
            self._close(tag)

    def _close(self, tag, within=False):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                before = self.open[-1][1]
                blocks = any(e[0] in BLOCKS for e in self.open[at:])
                del self.open[at:]
                if blocks or before != self.open[-1][1]:
                    self._new_line()
                return
            if within and self.open[at][0] in SCOPES:
                return

    def handle_endtag(self, tag):
        self.lines[-1].tags += 1
        if tag not in VOID:
            self._close(tag)
        elif tag == "br":
            self.lines[-1].parts.append(" ")

    def handle_data(self, data):
        _, unread, _, _, linked = self.open[-1]
        line = self.lines[-1]
        line.parts.append(data)
        if linked:
            line.linked += len(data)


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing over neighbouring lines, normalised at the ends."""
    weights = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in range(REACH + 1)]
    out = []
    for i in range(len(ratios)):
        total = mass = 0.0
        for j in range(max(0, i - REACH), min(len(ratios), i + REACH + 1)):
            w = weights[abs(i - j)]
            total += w * ratios[j]
            mass += w
        out.append(total / mass)
    return out


def threshold(values: list[float]) -> float:
    """Border between two clusters of values: the means of both sides are equally far."""
    low, high = min(values), max(values)
    border = (low + high) / 2
    for _ in range(20):
        below, above = [v for v in values if v < border], [v for v in values if v >= border]
        if not below or not above:
            break
        moved = (sum(below) / len(below) + sum(above) / len(above)) / 2
        if abs(moved - border) < 1e-9:
            break
        border = moved
    return border if low < high else low


def main_text(html: str | None) -> str:
    """Main text of one page: blocks in page order, one per line."""
    if not html:
        return ""
    events = PageEvents()
    events.feed(html)
    events.close()
    lines = []
    for line in events.lines:
        text = " ".join("".join(line.parts).split())
        if text:
            lines.append((line, text))
    readable = [x for x in lines if not x[0].unread]
    if not readable:
        return ""
    # Logarithms, so that one very long line does not make all others look short.
    levels = smoothed([math.log1p(len(text) / (1 + line.tags)) for line, text in lines])
    border = threshold([level for (line, _), level in zip(lines, levels) if not line.unread])
    # Characters, linked ones, content lines and place in an article by region.
    regions: dict[int, list] = {}
    for (line, text), level in zip(lines, levels):
        if not line.unread:
            sums = regions.setdefault(line.region, [0, 0, False, line.article])
            sums[0] += len(text)
            sums[1] += line.linked
            sums[2] |= level + (math.log(WEIGHT) if line.article else 0) >= border
    chosen = {r for r, (size, linked, content, article) in regions.items() if content and (article or linked <= LINKED * size)}
    return "\n".join(text for line, text in readable if line.region in chosen)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page row.

    Null, empty and unreadable pages have an empty text. Rows are handled one by one, so
    repeated rows give repeated results; other columns do not take part.
    """
    small_batches(pages.sparkSession)
    source = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"), pages[html_column].alias("html"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
