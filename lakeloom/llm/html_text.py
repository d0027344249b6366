"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element; scripts, styles, forms, navigation and other
parts that the markup itself names as boilerplate leave empty lines. A line weighs as many characters as it
has outside links. Weights are summed over sliding windows of lines: a dive is where a whole window weighs
nothing, and a surge where a window reaches the level of running text. The lines between two dives are kept if
there is a surge among them, but for weightless lines at their ends.

The level is ``surge`` characters, or the highest sum of the page where that is lower, so a page of only short
lines is not emptied. Lines inside an article or main element have a bonus of that many characters, which
is a surge of its own, and lines inside and outside are apart as if there were a dive. A dropped landmark
(navigation, header, footer) is a dive, any other dropped block is one empty line. A class or id drops its
element only where all words of a name are boilerplate or say nothing, and no other name says content.

Time is linear in the page: tags that never end and elements that never close end with the page.

Cases: null or empty html gives the empty text; unclosed elements, comments, tags and quotes end with the page;
very long pages are read whole; repeated rows each get a row; an empty table gives no rows; extra columns are
ignored, and a column to keep may not be named ``text``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.common import pieces_of, ship

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|=|"|')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")

#: Elements of HTML by role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noframes", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "select", "button", "svg", "canvas", "object", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Elements, roles and names of the parts of a page around its content.
LANDMARKS = {"nav", "navbar", "navigation", "menu", "header", "masthead", "topbar", "banner", "footer", "contentinfo", "aside", "sidebar", "complementary"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "comment", "comments", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "widget", "skip", "toolbar", "tags"}
#: Words in names of classes and ids that say nothing of what is inside, and those that say content.
NEUTRAL = {"area", "bar", "block", "bottom", "box", "button", "buttons", "card", "center", "col", "column", "container", "fixed", "global", "group", "header", "icon", "icons", "inline", "inner", "item", "items", "layout", "left", "link", "links", "list", "media", "middle", "mobile", "module", "outer", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "super", "text", "thread", "top", "unit", "wrap", "wrapper"}
CONTENT = {"article", "body", "content", "entry", "main", "post", "story"}
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "head", "caption", "tbody", "tfoot", "thead", "tr", "option", "optgroup", "legend"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}


_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass
class Line:
    text: str
    weight: int
    inside: bool


def _named(value: str) -> set[str]:
    """Words by which a class or id names boilerplate: of a name of only such words and neutral ones, if no other
    name says content."""
    words = [{w for w in _TOKEN.findall(name) if not w.isdigit()} for name in value.split()]
    if any(w and w <= CONTENT for w in words):
        return set()
    return set().union(*(w & NAMES for w in words if w <= NAMES | NEUTRAL))


def _boilerplate(name: str, attrs: str, inside: bool) -> str:
    """The element, role or word that says an element is boilerplate, or nothing."""
    if name in BOILERPLATE or name == "header" and not inside:
        return name
    if not attrs or not attrs.strip():
        return ""
    for key, value in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "hidden"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if key == "role" and value in ROLES:
            return value
        if key in ("class", "id") and name not in ("html", "body", "main") and (words := _named(value)):
            return min(words & LANDMARKS or words)
    return ""


class _Reader:
    """The open elements of a page, and its lines so far. Every step takes constant time but for what it closes."""

    def __init__(self, window: int):
        self.window = window
        self.out: list[Line] = []
        self.stack: list[tuple[str, bool, bool]] = []  # name, drops its text, is an article or main
        self.blocks: list[int] = []  # places of block elements in the stack
        self.open: dict[str, list[int]] = {}  # places of each element
        self.parts: list[str] = []
        self.linked = self.dropped = self.articles = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(Line(text, max(len(text) - self.linked, 1 if self.articles else 0), self.articles > 0))
        self.parts.clear()
        self.linked = 0

    def gap(self, lines: int) -> None:
        if self.out:
            self.out.extend([Line("", 0, self.out[-1].inside)] * lines)

    def say(self, raw: str) -> None:
        if raw and not self.dropped:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.open.get("a"):
                self.linked += len(text)

    def push(self, name: str, reason: str, article: bool) -> None:
        drops = bool(reason)
        if drops and not self.dropped and name in BLOCKS:
            self.flush()
            self.gap(self.window if reason in LANDMARKS else 1)
        self.open.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, drops, article))
        self.dropped += drops
        self.articles += article

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, drops, article = self.stack.pop()
            self.open[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.dropped -= drops
            self.articles -= article

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        places = self.open.get(name)
        if places and (name in BLOCKS or not self.blocks or self.blocks[-1] < places[-1]):
            self.pop_to(places[-1])

    def make_way(self, name: str) -> None:
        """Closes the elements that end where this one starts."""
        while self.blocks and name in CLOSED_BY.get(self.stack[self.blocks[-1]][0], ()):
            self.pop_to(self.blocks[-1])


def lines_of(page: str, window: int = 3) -> list[Line]:
    """The page's blocks in order; parts that are boilerplate by their markup are lines without text."""
    reader = _Reader(window)
    at = 0
    while m := _TAG.search(page, at):
        reader.say(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"] or ""
        if m["close"]:
            reader.close(name)
            continue
        if name in RAW:
            closer = _CLOSERS[name].search(page, at)
            at = closer.end() if closer else len(page)
            continue
        if name in BLOCKS:
            reader.flush()
        elif name in ("br", "td", "th", "img"):
            reader.parts.append(" ")
        reader.make_way(name)
        if name not in VOID:
            reason = _boilerplate(name, attrs, reader.articles > 0)
            reader.push(name, reason, name in ("article", "main") and not reason)
    reader.say(page[at:])
    reader.flush()
    return reader.out


def _passages(lines: list[Line], window: int) -> Iterator[tuple[int, int]]:
    """[start, end) of the lines between dives, without weightless lines at the ends."""
    start = last = None
    for k, line in enumerate(lines):
        if not line.weight:
            continue
        if start is not None and (k - last > window or line.inside != lines[last].inside):
            yield start, last + 1
            start = None
        start, last = k if start is None else start, k
    if start is not None:
        yield start, last + 1


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The text between surges and dives, blocks joined by an empty line."""
    if not page:
        return ""
    lines = lines_of(page, window)
    weights = [line.weight + surge if line.inside else line.weight for line in lines]
    for k, line in enumerate(lines):
        if not line.text:
            weights[k] = 0
    found = []
    for start, end in _passages(lines, window):
        total = [0]
        for w in weights[start:end]:
            total.append(total[-1] + w)
        peak = max(total[min(k + window, end - start)] - total[k] for k in range(end - start))
        found.append((start, end, peak))
    level = min(surge, max((peak for _, _, peak in found), default=0))
    return "\n\n".join(line.text for start, end, peak in found if peak >= level for line in lines[start:end] if line.text)


def extract_pages(pages: DataFrame, window: int = 3, surge: int = 80, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the main ``text`` of every page."""
    ship(pages.sparkSession)
    if "text" in keep:
        raise ValueError("the column text is added here and cannot be kept")
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 512):
            texts = [main_text(h, window, surge) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return pages.select(*keep, html_col).toDF(*(f"c{k}" for k in range(len(keep) + 1))).mapInArrow(run, schema)
