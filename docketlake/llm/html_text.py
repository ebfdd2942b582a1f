"""Layout-aware text of HTML pages.

A tree builder turns tags into balanced open and close events, adding the end
tags that HTML implies; a renderer drops what isn't visible and lays out the
rest: white space collapses outside preformatted text, blocks start new lines,
paragraphs and their like are set off by a blank line, list items get a bullet
or a number and are indented by depth, and table cells are padded so that columns
line up, also below cells that span rows. All visible text comes out, whole;
that of formulas and drawings too, but for their metadata.

Null or empty html gives empty text; rows are kept as they are, repeated or
not; columns other than the id and the html are ignored; an empty table gives
an empty result. Pages are scanned once, whatever they leave open: a tag or
comment that isn't closed takes the rest of the page, as in browsers. Depth of
nesting doesn't use the interpreter's stack.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_BEFORE_ATTR = re.compile(r"[\s/]*+")
_ATTR_NAME = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE_VALUE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe object noembed noframes datalist audio video canvas annotation annotation-xml desc defs metadata symbol clippath mask marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address li dt dd details summary figcaption form legend optgroup option caption center dir hgroup search textarea".split())
TABLE_PARTS = frozenset("thead tbody tfoot tr td th caption colgroup".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
CLOSES_P = (BLOCK | TABLE_PARTS) - frozenset("option optgroup html body legend summary caption textarea".split()) - TABLE_PARTS

#: An opening tag on the left ends open elements on the right, up to a barrier.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "td", "th", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th", "caption", "colgroup"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "caption", "colgroup"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"td", "th", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
}
_P_BARRIER = frozenset({"td", "th", "table", "button", "caption", "object", "template"})
_END_BARRIER = frozenset({"td", "th", "table", "template"})

#: Padding of a table may take so many times the characters of its cells; a column is padded to 80 in any case.
PADDING, ALWAYS_PADDED = 8, 80


def tag_end(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether the tag closes itself, place after it) of the tag whose name ends at ``at``; the place is -1 if the page ends first."""
    attrs: dict[str, str] = {}
    while True:
        at = _BEFORE_ATTR.match(page, at).end()
        if at >= len(page):
            return attrs, False, -1
        if page[at] == ">":
            return attrs, page[at - 1] == "/", at + 1
        name = _ATTR_NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return attrs, False, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE_VALUE.match(page, at)
                value, at = bare[0], bare.end()
        attrs.setdefault(name[0].lower(), entities.unescape(value))


class Tree:
    """Tree builder: calls ``enter(tag, attrs)``, ``leave(tag)`` and ``text(string)`` in document order, balanced."""

    def __init__(self, enter: Callable[[str, dict[str, str]], None], leave: Callable[[str], None], text: Callable[[str], None]):
        self.enter, self.leave, self.text = enter, leave, text
        self.open: list[str] = []
        self.count: dict[str, int] = {}

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.enter(tag, attrs)

    def _pop(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        self.leave(tag)
        return tag

    def _close(self, tags: frozenset[str], barrier: frozenset[str], furthest: bool) -> None:
        """End the nearest (or furthest) open element of ``tags`` above the barrier, and all within it."""
        if not any(self.count.get(t) for t in tags):
            return
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in tags:
                at = i
                if not furthest:
                    break
            elif self.open[i] in barrier:
                break
        while at is not None and len(self.open) > at:
            self._pop()

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.open and self.open[-1] == "head" and tag not in HEAD_ONLY and tag != "head":
            self._pop()
        if tag in ("html", "body") and self.count.get(tag):
            return
        if tag in CLOSES_P:
            self._close(frozenset({"p"}), _P_BARRIER, False)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag], True)
        if tag in ("td", "th") and self.count.get("table") and not self._within("tr"):
            self._push("tr", {})
        if tag in VOID:
            self.enter(tag, attrs)
            self.leave(tag)
        elif closed and (tag in ("svg", "math") or self.foreign()):
            self.enter(tag, attrs)
            self.leave(tag)
        else:
            self._push(tag, attrs)

    def foreign(self) -> bool:
        """Whether a drawing or formula is open."""
        return bool(self.count.get("svg") or self.count.get("math"))

    def _within(self, tag: str) -> bool:
        for t in reversed(self.open):
            if t == tag:
                return True
            if t == "table":
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, True)
        elif tag not in ("html", "body"):
            self._close(frozenset({tag}), _END_BARRIER - {tag} if tag not in TABLE_PARTS | {"table"} else frozenset({"table"}) - {tag}, False)

    def data(self, text: str) -> None:
        if self.open and self.open[-1] == "head" and text.strip():
            self._pop()
        self.text(text)

    def _markup(self, page: str, at: int) -> int:
        """Take in the markup at the ``<`` at ``at``; returns the place after it, -1 if it takes the rest of the page, or ``at`` if the ``<`` is text."""
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                return page.index(">", at) + 1
            end = _COMMENT_END.search(page, at + 4)
            return end.end() if end else -1
        if page.startswith("<![CDATA[", at) and self.foreign():
            end = page.find("]]>", at)
            self.data(page[at + 9 : end if end >= 0 else len(page)])
            return end + 3 if end >= 0 else -1
        close = page.startswith("</", at)
        name = _TAG_NAME.match(page, at + 1 + close)
        if name is None:
            if close or page.startswith(("<!", "<?"), at):  # not markup of a page; hidden up to its end
                return page.find(">", at) + 1 or -1
            return at
        tag = name[0].lower()
        attrs, closed, end = tag_end(page, name.end())
        if end < 0:
            return -1
        if close:
            self.end(tag)
            return end
        self.start(tag, attrs, closed)
        if tag in RAW and not self.foreign():
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, end)
            until = stop.start() if stop else len(page)
            self.text(entities.unescape(page[end:until]) if tag in ("textarea", "title") else page[end:until])
            return until
        return end

    def feed(self, page: str) -> None:
        at = begin = 0  # text from begin on is still to be passed on
        while (mark := page.find("<", at)) >= 0:
            # What isn't markup stays in the text; what is, ends it.
            if not (page[mark + 1 : mark + 2].isascii() and page[mark + 1 : mark + 2].isalpha()) and page[mark + 1 : mark + 2] not in ("/", "!", "?"):
                at = mark + 1
                continue
            if mark > begin:
                self.data(entities.unescape(page[begin:mark]))
            at = begin = self._markup(page, mark)
            if at < 0:
                begin = len(page)
                break
        if begin < len(page):
            self.data(entities.unescape(page[begin:]))
        while self.open:
            self._pop()


class _Flow:
    """Lines of one block container: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent: list[str] = []
        self.marker = ""
        self.gap = 0
        self.after_blank = True
        self.verbatim = False

    def inline(self, text: str) -> None:
        """Text in which white space collapses."""
        text = _BLANKS.sub(" ", text)
        if self.after_blank and text.startswith(" "):
            text = text[1:]
        if text:
            self.parts.append(text)
            self.after_blank = text.endswith(" ")

    def preformatted(self, text: str) -> None:
        self.verbatim = True
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.line(keep=True)
            self.verbatim = True
            self.parts.append(line)
        self.after_blank = False

    def line(self, keep: bool = False) -> None:
        """End the line; an empty one counts only if ``keep``."""
        text = "".join(self.parts)
        text = text.rstrip() if keep or self.verbatim else text.strip()
        self.parts, self.after_blank, self.verbatim = [], True, False
        if not text and not keep:
            return
        if self.lines and self.gap and (text or keep):
            self.lines += [""] * (self.gap - 1)
        self.gap = 1
        prefix = "".join(self.indent)
        if self.marker:
            prefix = prefix[: len(prefix) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((prefix + text).rstrip())

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced:
            self.gap = 2

    def finish(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.captions: list[str] = []

    def placed(self) -> list[list[tuple[list[str], int, int]]]:
        """Rows of (lines, first column, column after the last): a cell takes the next column that no cell above reaches into."""
        out, taken = [], {}  # column: first row that doesn't have it taken
        for number, row in enumerate(self.rows):
            column, cells = 0, []
            for lines, columns, rows in row:
                while taken.get(column, 0) > number:
                    column += 1
                if rows != 1:
                    taken |= dict.fromkeys(range(column, column + columns), number + rows if rows else len(self.rows))
                cells.append((lines, column, column + columns))
                column += columns
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        """Rows with their cells padded to the width of their columns."""
        rows = self.placed()
        chars = sum(len(line) for row in rows for lines, _, _ in row for line in lines)
        limit = max(ALWAYS_PADDED, PADDING * chars // max(1, len(rows)))
        widths: dict[int, int] = {}
        for row in rows:
            for lines, first, until in row:
                wide = max(map(len, lines), default=0) if until == first + 1 else 0
                widths[first] = max(widths.get(first, 0), min(limit, wide))
        # Columns in which no cell starts take no room.
        starts = sorted(widths)
        left = [0]
        for c in starts:
            left.append(left[-1] + widths[c] + 2)
        out = list(self.captions)
        for row in rows:
            for i in range(max((len(lines) for lines, _, _ in row), default=0)):
                line = ""
                for lines, first, _ in row:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(left[bisect.bisect_left(starts, first)])
                        line += ("  " if line and not line.endswith("  ") else "") + lines[i]
                out.append(line.rstrip())
        return out


def _number(value: str | None, most: int) -> int:
    """A span as HTML reads it: 1 if it isn't a number, at most ``most``."""
    value = (value or "").strip()
    return min(most, int(value)) if value.isascii() and value.isdigit() and len(value) < 9 else 1


class _Renderer:
    def __init__(self) -> None:
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        self.hidden = 0
        self.stack: list[tuple[bool, int]] = []  # per open element: it hides, indents it has added
        self.pre = 0
        self.lists: list[tuple[str, int]] = []
        self.spans: list[tuple[int, int]] = []

    def enter(self, tag: str, attrs: dict[str, str]) -> None:
        hides = tag in UNSEEN or "hidden" in attrs or ("style" in attrs and bool(_HIDING.search(attrs["style"]))) or (tag == "dialog" and "open" not in attrs)
        self.hidden += hides
        added, flow = 0, self.flows[-1]
        if not self.hidden:
            if tag == "br":
                flow.line(keep=True)
            elif tag == "table":
                flow.block(True)
                self.tables.append(_Table())
            elif tag == "tr" and self.tables:
                self.tables[-1].rows.append([])
            elif tag in ("td", "th", "caption") and self.tables:
                self.flows.append(_Flow())
                self.spans.append((max(1, _number(attrs.get("colspan"), 1000)), _number(attrs.get("rowspan"), 65534)))
            elif tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists))
            if tag in ("ul", "ol", "menu", "dir"):
                start = attrs.get("start", "1")
                self.lists.append((tag, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1))
            elif tag == "li":
                kind, number = self.lists[-1] if self.lists else ("ul", 1)
                value = attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value, re.A) else number
                marker = f"{number}. " if kind == "ol" else "- "
                if self.lists:
                    self.lists[-1] = (kind, number + 1)
                flow.indent.append(" " * len(marker))
                flow.marker, added = marker, 1
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
                added = 1
            elif tag in ("pre", "xmp", "textarea"):
                self.pre += 1
        self.stack.append((hides, added))

    def leave(self, tag: str) -> None:
        hides, added = self.stack.pop()
        if not self.hidden:
            flow = self.flows[-1]
            if tag in ("td", "th", "caption") and self.tables and len(self.flows) > 1:
                lines, span = self.flows.pop().finish(), self.spans.pop()
                if tag == "caption":
                    self.tables[-1].captions += lines
                else:
                    if not self.tables[-1].rows:
                        self.tables[-1].rows.append([])
                    self.tables[-1].rows[-1].append((lines, *span))
            elif tag == "table" and self.tables:
                flow.line()
                for line in self.tables.pop().lines():
                    flow.parts.append(line)
                    flow.line(keep=True)
                flow.gap = 2
            elif tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(self.lists) > 1))
            if tag in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
            elif tag in ("pre", "xmp", "textarea"):
                self.pre -= 1
            if added:
                flow.indent.pop()
                flow.marker = "" if tag == "li" else flow.marker
        self.hidden -= hides

    def text(self, text: str) -> None:
        if self.hidden:
            return
        if self.pre:
            self.flows[-1].preformatted(text)
        else:
            self.flows[-1].inline(text)


def render(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    out = _Renderer()
    Tree(out.enter, out.leave, out.text).feed(page.replace("\x00", "�"))
    return "\n".join(out.flows[0].finish()).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``key``, text, n_chars and n_lines of every row of ``pages``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [render(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(extract, f"key {kind}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return made.select(F.col("key").alias(key), "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))
