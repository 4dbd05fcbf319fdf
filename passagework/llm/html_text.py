"""Layout-aware HTML rendering: a tree with implied tags, visibility rules, and all visible text.

A tolerant tokenizer feeds a tree builder that opens and closes the tags that HTML implies
(paragraphs, list items, table rows and cells, options, definitions). The tree is rendered with
spacing between blocks, bullets or numbers for list items, preformatted text as it is, and table
cells aligned in columns. MathML and the text elements of SVG are rendered as running text, each SVG
text and each row of a formula on its own line; what browsers don't render in them is not (SVG title,
desc, defs, metadata; MathML annotations). SVG text drawn by reference (use) is not followed.

Nothing recurses, so depth is bounded by memory only.

Defined results. Null html: null text. Empty html, or html without visible text: the empty
text. Very long pages: time and memory in proportion to the page, whatever its markup. To that end no text is
searched twice for the end of a tag, open elements are found by name, lines are indented by at most ``INDENTED``
levels, tables nested more than ``NESTED`` deep are laid out as blocks, and cells that span rows are followed in
the first ``COLUMNS`` columns. Where a table's padding would make it
over eight times as long (and 4,096 characters), its longest cells don't count for the columns' widths, as
few as suffice, and stand out of their column; the others stay aligned. Repeated rows
and ties: each row is rendered by itself. Empty table: no rows. Extra columns are ignored; the
result's names are fixed.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object datalist title audio video canvas".split())
#: Not rendered inside svg and math; text in svg is drawn inside the elements of SVG_TEXT only.
UNSEEN_IN = {
    "svg": frozenset("desc defs metadata symbol clippath mask pattern marker filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
SVG_TEXT = frozenset("text tspan textpath a".split())
#: Elements of svg and math whose content is HTML again, and HTML tags that end svg and math.
HTML_IN = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup "
    "html legend li main menu nav optgroup option section summary tbody td tfoot th thead tr search".split()
)
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag doesn't reach beyond these, unless it names one.
WALLS = frozenset("table td th caption template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Levels of indentation, depth of tables in tables, columns in which spanning cells are followed.
INDENTED, NESTED, COLUMNS = 32, 16, 256
ENDS_PARAGRAPH = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup".split())

COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
OPENING = re.compile(r"<(?:!--|[!?]|/?(?P<tag>[A-Za-z][^\s/>]*+)?)")
#: The rest of a tag that holds no other bracket, up to its end: what is searched ends at the next bracket.
TAIL = re.compile(r"(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+>")
UNQUOTED = re.compile(r"[^>\"']*+")
#: Character references whose number no character has; the standard library would convert all their digits.
HUGE = re.compile(r"&#(?:0*+[0-9]{9,}|[xX]0*+[0-9a-fA-F]{9,});?")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SHOWS = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible\b", re.I)
#: What HTML collapses; no-break and other spaces stay as they are.
BLANK = " \t\n\r\f"
WORDS = re.compile(r"[^ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)
    space: str = ""  # svg or math, for an element of theirs

    def inside(self) -> str:
        """The space of its children."""
        return "" if self.space and self.tag in HTML_IN[self.space] else self.space


def unescaped(text: str) -> str:
    return html.unescape(HUGE.sub("\ufffd", text) if "&#" in text else text)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescaped(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """Keeps the path of open elements and applies the implied tags."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.path = [self.root]
        self.open: dict[str, list[int]] = {}  # the depths of the open elements of each name

    def _pop(self, n: int) -> None:
        for node in self.path[n:]:
            self.open[node.tag].pop()
        del self.path[n:]

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, space=tag if tag in UNSEEN_IN else self.path[-1].inside())
        self.path[-1].children.append(node)
        self.open.setdefault(tag, []).append(len(self.path))
        self.path.append(node)

    def _deepest(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _close(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of ``tags`` below the nearest of ``walls``."""
        wall, found = self._deepest(walls - tags), []
        for t in tags:
            if at := self.open.get(t):
                found += at[bisect_left(at, wall) :][:1]
        if found:
            self._pop(min(found))

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.path[-1].inside():
            if tag not in BREAKS_OUT:
                self._push(tag, attrs)
                if closed:
                    self._pop(len(self.path) - 1)
                return
            while self.path[-1].inside():
                self._pop(len(self.path) - 1)
        if tag == "body" and self.open.get("body") or tag == "html" and self.open.get("html"):
            return
        if self.path[-1].tag == "head" and tag in BLOCK:
            self._pop(len(self.path) - 1)
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, WALLS)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("td", "th") and self.open.get("table") and self.path[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, attrs)
        if tag in VOID or closed and tag not in BLOCK and tag not in RAW:
            self._pop(len(self.path) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", {}, True)
        if tag == "p" and not self.open.get("p"):
            return self.start("p", {}, False) or self.end("p")
        if tag in ("body", "html") or not self.open.get(tag):
            return None
        at = self._deepest(HEADINGS if tag in HEADINGS else (tag,))
        if at >= self._deepest(("table",) if tag in ("table", "tr", "tbody", "thead", "tfoot") else WALLS):
            self._pop(at)
        return None

    def text(self, data: str) -> None:
        if self.path[-1].tag == "head" and data.strip(BLANK):
            self._pop(len(self.path) - 1)
        self.path[-1].children.append(data)


class Tags:
    """Finds the ends of tags; every part of the page is searched once."""

    def __init__(self, source: str) -> None:
        self.source, self.last = source, {c: source.rfind(c) for c in ">\"'"}
        self.unclosed: set[int] = set()  # quotes from which on a tag would never end

    def end(self, at: int) -> int:
        """The place of the ``>`` outside quotes, or of the next one if a quote isn't closed; the page has one."""
        i, met = at, []
        while True:
            i = UNQUOTED.match(self.source, i).end()
            if i < len(self.source) and self.source[i] == ">":
                return i
            if i == len(self.source) or i in self.unclosed or i >= self.last[self.source[i]]:
                self.unclosed.update(met, (i,))
                return self.source.find(">", at)
            met.append(i)
            i = self.source.find(self.source[i], i + 1) + 1


def parse(source: str) -> Node:
    b, at, done, tags = Builder(), 0, 0, Tags(source)
    closing: dict[str, re.Pattern] = {}
    while m := OPENING.search(source, at):
        comment = m[0] == "<!--"
        if not comment and m.end() > tags.last[">"]:  # no tag ends any more
            at = source.find("<!--", m.start())
            if at < 0:
                break
            continue
        if m[0] == "<":
            at = m.end()
            continue
        if m.start() > done:
            b.text(unescaped(source[done : m.start()]))
        if comment:
            at = done = COMMENT.match(source, m.start()).end()
            continue
        tag, start = (m["tag"] or "").lower(), m.end()
        if not tag:
            if b.path[-1].inside() and source.startswith("<![CDATA[", m.start()):
                stop = source.find("]]>", m.start())
                b.text(source[m.start() + 9 : stop if stop >= 0 else len(source)])
                at = done = stop + 3 if stop >= 0 else len(source)
            else:
                at = done = source.find(">", start) + 1
            continue
        plain = TAIL.match(source, start)
        stop = plain.end() - 1 if plain else tags.end(start)
        at = done = stop + 1
        if source[m.start() + 1] == "/":
            b.end(tag)
            continue
        raw = source[start:stop]
        b.start(tag, attributes(raw) if raw.strip() else {}, raw.rstrip().endswith("/"))
        if (tag in RAW or tag in ("title", "textarea")) and not b.path[-1].space:
            close = closing.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)).search(source, at)
            body = source[at : close.start() if close else len(source)]
            b.path[-1].children.append(body if tag in RAW else unescaped(body))
            b.end(tag)
            at = done = close.end() if close else len(source)
    if done < len(source):
        b.text(unescaped(source[done:]))
    return b.root


class Flow:
    """Lines of running text with the gaps between blocks."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap, self.fresh, self.blank = 0, True, False
        self.indent: list[str] = []
        self.bullet = ""

    def block(self, gap: int) -> None:
        self.gap, self.fresh, self.blank = max(self.gap, gap), True, False

    def _lead(self) -> None:
        if self.fresh:
            if self.out:
                self.out.append("\n" * max(1, self.gap))
            lead = "".join(self.indent[: min(INDENTED, len(self.indent) - bool(self.bullet))])
            self.out.append(lead + self.bullet)
            self.bullet, self.fresh, self.gap, self.blank = "", False, 0, False
        elif self.blank:
            self.out.append(" ")
        self.blank = False

    def text(self, data: str) -> None:
        parts = WORDS.findall(data)
        if data and data[0] in BLANK and not self.fresh:
            self.blank = True
        if parts:
            self._lead()
            self.out.append(" ".join(parts))
            self.blank = data[-1] in BLANK

    def literal(self, line: str) -> None:
        if line:
            self._lead()
            self.out.append(line)

    def line_break(self) -> None:
        self.gap, self.fresh, self.blank = min(2, self.gap + 1), True, False

    def finish(self) -> str:
        return "".join(self.out)


class Grid:
    """A table's rows of rendered cells."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int]]] = []
        self.held: dict[int, int] = {}  # column -> rows that a cell above still takes

    def row(self) -> None:
        self.rows.append([])
        self.column, self.taken = 0, {c: n for c, n in self.held.items() if n > 0}
        self.held = {c: n - 1 for c, n in self.taken.items()}

    def cell(self, text: str, span: int, down: int) -> None:
        if not self.rows:
            self.row()
        first = self.column
        while self.taken.get(self.column):
            self.column += 1
        if self.column > first:
            self.rows[-1].append(("", self.column - first))
        self.rows[-1].append((text, span))
        if down > 1:
            self.held |= {c: down - 1 for c in range(self.column, min(self.column + span, COLUMNS))}
        self.column += span

    def lines(self) -> list[str]:
        laid = []  # rows of (column, span, lines, longest line)
        for r in self.rows:
            if any(t for t, _ in r):
                laid.append([])
                c = 0
                for t, span in r:
                    laid[-1].append((c, span, parts := t.split("\n"), max(map(len, parts))))
                    c += span
        plain = sum(len(x) + 1 for r in laid for _, _, parts, _ in r for x in parts)

        def sized(most: int) -> list[list[int]]:
            """The width of each cell, when columns are as wide as their widest cell of at most ``most``."""
            width: dict[int, int] = {}
            for r in laid:
                for c, span, _, n in r:
                    if span == 1 and n <= most:
                        width[c] = max(width.get(c, 0), n)
            columns = sorted(width)
            upto = list(accumulate((width[c] for c in columns), initial=0))
            return [
                [upto[bisect_left(columns, c + span)] - upto[bisect_left(columns, c)] + 2 * (span - 1) for c, span, _, _ in r]
                for r in laid
            ]

        def fits(sizes: list[list[int]]) -> bool:
            """The last cell of a row isn't padded."""
            return sum(sum(s[:-1]) * max(len(x[2]) for x in r) for r, s in zip(laid, sizes, strict=True)) <= 8 * plain + 4096

        lengths = sorted({n for r in laid for _, span, _, n in r if span == 1} | {0})
        sizes = sized(lengths[-1])
        if not fits(sizes):
            sizes = sized(lengths[max(0, bisect_left(lengths, True, key=lambda n: not fits(sized(n))) - 1)])
        out = []
        for r, s in zip(laid, sizes, strict=True):
            for k in range(max(len(x[2]) for x in r)):
                out.append("  ".join((x[2][k] if k < len(x[2]) else "").ljust(n) for x, n in zip(r, s, strict=True)).rstrip())
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return max(1, min(most, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def _visible(node: Node, seen: bool) -> tuple[bool, bool]:
    """(shown, its descendants may be shown)."""
    if node.tag in UNSEEN or "hidden" in node.attrs or node.tag == "input":
        return False, False
    if node.tag == "dialog" and "open" not in node.attrs or "popover" in node.attrs:
        return False, False
    if node.tag in UNSEEN_IN.get(node.space, ()):
        return False, False
    style = node.attrs.get("style", "")
    if node.space == "svg":
        style = ";".join(f"{k}:{node.attrs[k]}" for k in ("display", "visibility") if k in node.attrs and k not in style) + ";" + style
    if style:
        if re.search(r"(?:^|;)\s*display\s*:\s*none\b", style, re.I):
            return False, False
        if SHOWS.search(style):
            return True, True
        if HIDES.search(style):
            return False, True
    return seen, True


def render(root: Node) -> str:
    flows, grids = [Flow()], []
    lists: list[list[int]] = []  # [next number, or 0 for bullets]
    pre = 0
    stack: list[tuple] = [("enter", root, True)]
    while stack:
        what, node, seen = stack.pop()
        flow = flows[-1]
        if what == "text":
            if not seen:
                continue
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                flow.literal(first)
                for line in rest:
                    if flow.fresh and flow.out:
                        flow.gap += 1
                    flow.block(max(1, flow.gap))
                    flow.literal(line)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if what == "enter":
            shown, below = _visible(node, seen)
            if not below:
                continue
            if tag == "br":
                if shown:
                    flow.line_break()
                continue
            if tag == "wbr":
                continue
            if tag == "table":
                flow.block(2)
                grids.append(Grid() if len(grids) < NESTED else None)
            elif tag in ("tr", "td", "th", "caption") and grids and grids[-1] is None:
                flow.block(1)
            elif tag == "tr" and grids:
                grids[-1].row()
            elif tag in ("td", "th") and grids or tag == "caption" and grids:
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.block(1 if lists else 2)
                start = node.attrs.get("start", "1").strip()
                number = int(start) if re.fullmatch(r"-?[0-9]{1,8}", start) else 1
                lists.append([tag == "ol", number])
            elif tag == "li":
                flow.block(1)
                ordered, number = lists[-1] if lists else (False, 0)
                mark = f"{number}. " if ordered else "- "
                if lists:
                    lists[-1][1] += 1
                flow.indent.append(" " * len(mark))
                flow.bullet = mark
            elif tag == "dd":
                flow.block(1)
                flow.indent.append("  ")
            elif tag == "blockquote":
                flow.block(2)
                flow.indent.append("> ")
            elif node.space:
                if tag in ("text", "mtr") or tag == "tspan" and ("x" in node.attrs or "y" in node.attrs):
                    flow.block(1)
            elif tag in BLOCK:
                flow.block(2 if tag in SPACED else 1)
            pre += tag in ("pre", "textarea", "listing")
            stack.append(("leave", node, shown))
            drawn = node.space != "svg" or tag in SVG_TEXT or not node.inside()
            apart = tag in ("mfrac", "mtr") and node.space == "math"
            children = node.children
            if tag == "details" and "open" not in node.attrs and not node.space:  # closed: its summary only
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            for c in reversed(children):
                if isinstance(c, Node):
                    stack.append(("enter", c, shown))
                    if apart:
                        stack.append(("text", " ", shown))
                elif drawn:
                    stack.append(("text", c, shown))
            continue
        pre -= tag in ("pre", "textarea", "listing")
        if tag == "table":
            grid = grids.pop()
            for line in grid.lines() if grid else ():
                flow.block(1)
                flow.literal(line)
            flow.block(2)
        elif tag in ("tr", "td", "th", "caption") and grids and grids[-1] is None:
            flow.block(1)
        elif tag in ("td", "th") and grids:
            text = flows.pop().finish()
            grids[-1].cell(text, _span(node, "colspan", 1000), _span(node, "rowspan", 65534))
        elif tag == "caption" and grids:
            text = flows.pop().finish()
            for line in text.split("\n"):
                flows[-1].block(1)
                flows[-1].literal(line)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.block(1 if lists else 2)
        elif tag in ("li", "dd", "blockquote"):
            flow.indent.pop()
            flow.bullet = ""
            flow.block(2 if tag == "blockquote" else 1)
        elif node.space:
            if tag in ("text", "mtr"):
                flow.block(1)
        elif tag in BLOCK:
            flow.block(2 if tag in SPACED else 1)
    return flows[0].finish()


def html_to_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_to_text(t.as_py()) for t in b.column(1)], pa.string())], ["page_id", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines: one row per page."""
    out = mapped(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(source)), _render, "page_id long, text string")
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text").isNotNull(), lines).cast("long").alias("n_lines"))
