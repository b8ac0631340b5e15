"""HTML to text by layout: what a reader would see, with its blocks, lists and tables.

A tree builder turns tags into well nested openings and closings: void and raw
elements, implied end tags, stray and misnested end tags. A renderer follows
them with a stack of flows (the page, a list item, a cell), collapses blanks as
inline layout does, and keeps paragraphs, line breaks, preformatted text, list
markers and columns of tables apart. The texts of svg and math and all options
of select are set too. Elements that are never or not now shown are left out
with all inside them; visibility is inherited and can be reset.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded

#: A quote opens a string only right after = (and blanks); a value without quotes runs to a blank or >.
_VALUE = r"(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?"
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*){_VALUE}")
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]|[^\s/>][^\s/>=]*{_VALUE.replace('([^', '(?:[^')})*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Elements without content, with raw content, never shown, and blocks by the lines they leave free around them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist".split())
_BLOCKS = {n: 1 for n in "html body div section article header footer nav aside main address form fieldset legend figcaption li dt dd tr caption summary details center hgroup option dir menu search thead tbody tfoot td th".split()}
_BLOCKS |= {n: 2 for n in "p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr xmp".split()}
#: An opening tag ends these if they are open, up to a boundary.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul xmp li dt dd summary".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",)}
_BOUNDS = {"li": frozenset(("ul", "ol", "menu", "dir", "table")), "dt": frozenset(("dl", "table")), "dd": frozenset(("dl", "table"))}
_TABLE, _CELL, _CELLS = frozenset(("table",)), frozenset(("td", "th", "table")), frozenset("td th tr thead tbody tfoot caption".split())
#: Foreign content: where HTML resumes in it, what HTML ends it, and what is not shown in it.
_ROOTS, _RESUMES = ("svg", "math"), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_FOREIGN_UNSEEN = frozenset("annotation annotation-xml mphantom defs symbol clippath mask marker pattern lineargradient radialgradient filter desc metadata title style script".split())
#: What is set between the parts of a formula; a blank between those of others.
_BETWEEN = {"mfrac": "/", "msup": "^", "msub": "_", "mover": " ", "munder": " ", "msubsup": " ", "munderover": " ", "mroot": " ", "mtr": " "}
_VISIBILITY = re.compile(r"(?:^|;)visibility:([a-z]+)")
_HEAD = frozenset("base link meta title style script noscript template head html".split())


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hidden(name: str, attrs: dict[str, str]) -> bool:
    if name in _UNSEEN or "hidden" in attrs or (name == "dialog" and "open" not in attrs):
        return True
    return "display:none" in _style(attrs)


def _style(attrs: dict[str, str]) -> str:
    return _SPACE.sub("", attrs.get("style", "")).lower()


def _visible(attrs: dict[str, str], inherited: bool) -> bool:
    """Whether an element's own text shows; a child of a hidden element can show again."""
    said = _VISIBILITY.findall(_style(attrs)) if "style" in attrs else []
    return inherited if not said or said[-1] == "inherit" else said[-1] not in ("hidden", "collapse")


def _closes_itself(raw: str) -> bool:
    """Whether the / at the end of a tag is no part of a value."""
    end = 0
    for m in _ATTR.finditer(raw):
        end = m.end()
    return raw.endswith("/") and end < len(raw)


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open" or "close", name, attributes) and ("text", text, {}), well nested."""
    stack: list[str] = []
    count: dict[str, int] = {}

    def pop() -> tuple[str, str, dict[str, str]]:
        name = stack.pop()
        count[name] -= 1
        return "close", name, {}

    def close_to(names: tuple[str, ...] | frozenset[str], bounds: frozenset[str]) -> Iterator[tuple[str, str, dict[str, str]]]:
        """Ends the outermost of the names above the nearest boundary, and all inside it."""
        if not any(count.get(n) for n in names):
            return
        at = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                at = i
            elif stack[i] in bounds:
                break
        while at is not None and len(stack) > at:
            yield pop()

    def foreign() -> int:
        """The place of the svg or math that the next tag is directly part of, or -1."""
        if count.get("svg") or count.get("math"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in _ROOTS:
                    return i
                if stack[i] in _RESUMES:
                    return -1
        return -1

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            yield "text", html.unescape(page[pos:]), {}
            break
        if m.start() > pos:
            text = page[pos : m.start()]
            if stack and stack[-1] == "head" and text.strip():
                yield pop()
            yield "text", html.unescape(text), {}
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not count.get("p"):
                yield "open", "p", {}
                yield "close", "p", {}
            elif name == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            elif count.get(name):
                bounds = frozenset() if name in ("table", "body", "html") else _TABLE if name in _CELLS or name not in _BLOCKS else _CELL
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == name or stack[i] in bounds), None)
                if at is not None and stack[at] == name and (name in _BLOCKS or name in _UNSEEN or name in _ROOTS or name == "select" or not any(s in _BLOCKS for s in stack[at + 1 :])):
                    while len(stack) > at:
                        yield pop()
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        if stack and stack[-1] == "head" and name not in _HEAD:
            yield pop()
        if name in _ENDS_P and count.get("p"):
            yield from close_to(("p",), frozenset(("td", "th", "table", "button")))
        if name in _ENDS:
            yield from close_to(_ENDS[name], _BOUNDS.get(name, _TABLE))
        at = foreign()
        if at >= 0 and name in _BREAKS:
            while len(stack) > at:
                yield pop()
            at = -1
        yield "open", name, attrs
        if (at >= 0 or name in _ROOTS) and m[3] and _closes_itself(m[3]):
            yield "close", name, {}
        elif name in _VOID:
            yield "close", name, {}
        elif name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, pos)
            yield "text", page[pos : end.start() if end else n] if name in ("script", "style") else html.unescape(page[pos : end.start() if end else n]), {}
            yield "close", name, {}
            pos = end.end() if end else n
        else:
            stack.append(name)
            count[name] = count.get(name, 0) + 1
    while stack:
        yield pop()


class _Flow:
    """Lines of text that blocks, breaks and inline text are set into."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap = 0  # line ends wanted before the next text
        self.blank = False  # a blank wanted before it
        self.fresh = True  # at the start of a line

    def block(self, lines: int) -> None:
        if self.out:
            self.gap = max(self.gap, lines)
        self.blank = False

    def line(self) -> None:
        self.gap = max(1, self.gap + 1 if self.fresh or self.gap else 1) if self.out else 0
        self.fresh, self.blank = True, False

    def put(self, text: str) -> None:
        if self.gap:
            self.out.append("\n" * self.gap)
            self.gap, self.blank = 0, False
        elif self.blank:
            self.out.append(" ")
        self.blank = False
        self.out.append(text)
        self.fresh = False

    def text(self, raw: str) -> None:
        text = _SPACE.sub(" ", raw)
        core = text.strip(" ")
        if text[:1] == " " and self.out and not self.fresh and not self.gap:
            self.blank = True
        if core:
            self.put(core)
            if text[-1] == " ":
                self.blank = True

    def done(self) -> str:
        return "".join(self.out)


def _spread(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Cells (text, columns, rows) as (text, columns) in every row, with empty cells where one from above reaches down."""
    held: dict[int, int] = {}  # columns that a cell above covers, and for how many rows yet
    out = []
    for row in rows:
        line, col, more = [], 0, {}
        for text, span, down in row:
            while held.get(col):
                line.append(("", 1))
                col += 1
            line.append((text, span))
            if down > 1:
                more |= dict.fromkeys(range(col, col + span), down - 1)
            col += span
        held = {c: n - 1 for c, n in held.items() if n > 1} | more
        out.append(line)
    return out


def _table(rows: list[list[tuple[str, int]]]) -> str:
    """Cells in columns: each as wide as its widest line, two blanks between."""
    widths: dict[int, int] = {}
    for row in rows:
        col = 0
        for text, span in row:
            if span == 1:
                widths[col] = max(widths.get(col, 0), max((len(x) for x in text.split("\n")), default=0))
            col += span
    lines = []
    for row in rows:
        cells = [(t.split("\n"), s) for t, s in row]
        for k in range(max((len(c) for c, _ in cells), default=0)):
            line, col = "", 0
            for cell, span in cells:
                room = sum(widths.get(col + i, 0) for i in range(span)) + 2 * (span - 1)
                line += (cell[k] if k < len(cell) else "").ljust(room) + "  "
                col += span
            lines.append(line.rstrip())
    return "\n".join(lines)


def _number(text: str | None, default: int, most: int) -> int:
    return min(most, int(text)) if text and re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def render(page: str | None) -> str | None:
    """The visible text of a page; None of None."""
    if page is None:
        return None
    flows: list[_Flow] = [_Flow()]
    tables: list[tuple[list[list[tuple[str, int, int]]], list[str]]] = []
    lists: list[list] = []  # [ordered, next number]
    frames: list[tuple[str, object]] = []  # what each open element needs at its end
    shown: list[bool] = [True]
    inside: list[list] = []  # of each open element in svg or math: its name, its parts so far, whether svg text shows
    dark = pre = 0
    begun = False  # right after <pre>, where a line end does not count
    for kind, name, attrs in events(page):
        flow = flows[-1]
        if kind == "text":
            if dark or not shown[-1] or (inside and not inside[-1][2]):
                continue
            if pre:
                name = name.replace("\r\n", "\n")
                parts = (name[1:] if begun and name[:1] == "\n" else name).split("\n")
                begun = False
                for i, part in enumerate(parts):
                    if i:
                        flow.line()
                    if part:
                        flow.put(part)
            else:
                flow.text(name)
            continue
        begun = False
        if kind == "open":
            if dark or _hidden(name, attrs) or (inside and name in _FOREIGN_UNSEEN):
                dark += 1
                frames.append(("dark", None))
                continue
            frame: tuple[str, object] = ("", None)
            shown.append(_visible(attrs, shown[-1]))
            if inside or name in _ROOTS:
                if inside:
                    inside[-1][1] += 1
                    if inside[-1][1] > 1 and (between := _BETWEEN.get(inside[-1][0])) and shown[-1]:
                        flow.text(between)
                inside.append([name, 0, name in ("text", "foreignobject", "math") or (name != "svg" and inside[-1][2])])
                frame = ("inside", None)
                if name in ("text", "foreignobject", "mtr"):
                    flow.block(1)
                    frame = ("inside", 1)
                if name in ("text", "foreignobject", "mtr") or name not in _BLOCKS and name != "br":
                    frames.append(frame)
                    continue
                inside.pop()
                frame = ("", None)
            if name == "optgroup" or (name == "option" and attrs.get("label")):
                flow.block(1)
                if shown[-1]:
                    flow.text(attrs.get("label", ""))
                flow.block(1)
                if name == "option":
                    shown[-1] = False  # the label stands for the text
                frame = ("block", 1)
            elif not shown[-1] and name in ("br", "hr"):
                pass
            elif name == "br":
                flow.line()
            elif name == "hr":
                flow.block(2)
                flow.put("---")
                flow.block(2)
            elif name in ("ul", "ol", "menu", "dir"):
                flow.block(1 if lists else 2)
                lists.append([name == "ol", _number(attrs.get("start"), 1, 1 << 30)])
                frame = ("list", None)
            elif name == "li":
                flow.block(1)
                mark = "- "
                if lists and lists[-1][0]:
                    lists[-1][1] = _number(attrs.get("value"), lists[-1][1], 1 << 30)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flows.append(_Flow())
                frame = ("item", mark)
            elif name == "table":
                flow.block(2)
                tables.append(([], []))
                frame = ("table", None)
            elif name == "tr" and tables:
                tables[-1][0].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1][0]:
                    tables[-1][0].append([])
                flows.append(_Flow())
                down = _number(attrs.get("rowspan"), 1, 1 << 16)
                frame = ("cell", (max(1, _number(attrs.get("colspan"), 1, 1000)), 1 << 16 if down == 0 else max(1, down)))  # 0: all rows below
            elif name == "caption" and tables:
                flows.append(_Flow())
                frame = ("caption", None)
            elif name == "details" and "open" not in attrs:
                flow.block(1)
                frame = ("block", 1)
            elif name in _BLOCKS:
                flow.block(_BLOCKS[name])
                if name in ("pre", "xmp"):
                    pre, begun = pre + 1, True
                    frame = ("pre", None)
                else:
                    frame = ("block", _BLOCKS[name])
            frames.append(frame)
            continue
        end, value = frames.pop()
        if end == "dark":
            dark -= 1
            continue
        shown.pop()
        if end == "inside":
            inside.pop()
            if value:
                flow.block(value)
        elif end == "block":
            flow.block(value)
        elif end == "pre":
            pre -= 1
            flow.gap = 0
            flow.block(2)
        elif end == "list":
            lists.pop()
            flow.block(1 if lists else 2)
        elif end == "item":
            text = flows.pop().done()
            if text:
                flows[-1].put(value + text.replace("\n", "\n" + " " * len(value)))
            flows[-1].block(1)
        elif end == "cell":
            tables[-1][0][-1].append((flows.pop().done(), *value))
        elif end == "caption":
            tables[-1][1].append(flows.pop().done())
        elif end == "table":
            rows, captions = tables.pop()
            whole = "\n".join([*filter(None, captions), *filter(None, [_table([r for r in _spread(rows) if any(t for t, _ in r)])])])
            if whole:
                flow.block(2)
                flow.put(whole)
            flow.block(2)
    return flows[0].done()


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keep columns and text of every page.

    A null page has null text; an empty one, or one without visible text, has
    the empty text. Broken markup never fails: an unended tag or comment runs
    to the end of the page. Repeated rows stay; an empty table gives no rows.
    Columns not in keep are ignored; the result's text column is named text.
    """
    src = bounded(pages.select(*keep, F.col(html_col).alias("_html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([render(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, text string")
