"""HTML extraction by layout-aware rendering.

A tree builder with the implied tags of HTML (a paragraph ends at a block, an
item at the next item, a cell at the next cell, ...) makes a tree of each page; a
renderer writes all visible text of it. Blocks begin on lines of their own,
paragraphs and the like are set apart by an empty line, items have a bullet or
their number and the depth of their list, preformatted text keeps its spaces and
a table's cells stand in aligned columns, those that span several among them.
Every step is linear in the page, but for tables in tables: each of up to NEST
levels is laid out by itself, what is nested deeper is written as plain blocks.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas desc defs metadata symbol annotation annotation-xml datalist map".split())
SPACED = frozenset("p blockquote pre ul ol dl table h1 h2 h3 h4 h5 h6 figure hr".split())
BLOCKS = SPACED | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section select summary tr thead tbody tfoot caption".split())
_ENDS_P = (BLOCKS - frozenset("html body tr thead tbody tfoot caption option optgroup select".split())) | {"hr"}
#: What a start tag closes, and what it does not look beyond.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
_FENCE = frozenset("table td th caption html".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
#: What follows a tag's name; a quote opens a value only after an equals sign and if it is closed.
_REST = re.compile(r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_SEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
_USED = re.compile(r"hidden|style|start|span", re.IGNORECASE)
#: Levels of tables in tables that are laid out, and columns of a table that spans are counted for.
NEST, COLUMNS = 32, 1000


class Node:
    """start: a list's first number; across, down: the columns and rows that a cell spans."""

    __slots__ = ("across", "down", "kids", "start", "tag")

    def __init__(self, tag: str, start: int | None = None, across: int = 1, down: int = 1):
        self.tag, self.kids, self.start, self.across, self.down = tag, [], start, across, down


def _number(text: str | None, least: int, most: int, other: int | None) -> int | None:
    """The whole number that a value begins with, if it has at most nine digits."""
    m = _NUMBER.match(text or "")
    return min(max(int(m[1]), least), most) if m else other


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTR.finditer(text)}


def parse(source: str) -> Node:
    """The tree of a page; elements without a box are left out with all they hold, invisible ones without their text."""
    root = Node("#root")
    stack, hidden = [root], 0  # hidden: how many of the stack from its first hidden element on
    seen = [True]  # of each element on the stack
    at = 0

    def close(k: int) -> None:
        nonlocal hidden
        gone = len(stack) - k
        del stack[k:], seen[k:]
        hidden = max(0, hidden - gone)

    def add(text: str) -> None:
        if text and not hidden and seen[-1]:
            stack[-1].kids.append(_html.unescape(text) if "&" in text else text)

    for m in iter(lambda: _OPEN.search(source, at), None):
        add(source[at : m.start()])
        at = m.start()
        if m[0] == "<!--":
            end = source.find("-->", m.end() - 2)
            at = end + 3 if end >= 0 else len(source)
            continue
        if not m[2]:
            end = source.find(">", m.end())
            if end < 0:  # a tag without end: the rest is text
                break
            at = end + 1
            continue
        rest = _REST.match(source, m.end())
        if not rest:
            break
        at = rest.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add("\n") if not hidden else None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in _FENCE and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                    break
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _FENCE or stack[k].tag in BLOCKS:
                    break
        if tag in _CLOSES:
            ends, fence = _CLOSES[tag]
            least = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in fence:
                    break
                if stack[k].tag in ends:
                    least = k
            if least is not None:
                close(least)
        extra = _attributes(rest[1]) if _USED.search(rest[1]) else {}
        node = Node(tag, _number(extra.get("start"), -(10**9), 10**9, None), _number(extra.get("colspan"), 1, COLUMNS, 1), _number(extra.get("rowspan"), 0, 1 << 16, 1) or 1 << 16)
        gone = tag in HIDDEN or "hidden" in extra or bool(_GONE.search(extra.get("style", "")))
        shown = _SEEN.findall(extra.get("style", ""))
        shown = shown[-1].lower() == "visible" if shown else seen[-1]
        if tag in VOID:
            if not hidden and not gone:
                stack[-1].kids.append(node)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?:[\\s/][^>]*)?>", re.IGNORECASE).search(source, at)
            if not hidden and not gone and shown:
                node.kids.append(_html.unescape(source[at : end.start() if end else len(source)]))
                stack[-1].kids.append(node)
            at = end.end() if end else len(source)
            continue
        if not hidden and not gone:
            stack[-1].kids.append(node)
        stack.append(node), seen.append(shown)
        if hidden or gone:
            hidden += 1
    add(source[at:])
    return root


class _Writer:
    def __init__(self):
        self.out: list[str] = []
        self.line, self.lead, self.gap = "", "", 0

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            self._put(first, True)
            for x in rest:
                self.end(True)
                self._put(x, True)
            return
        self._put(_SPACE.sub(" ", s), False)

    def _put(self, s: str, keep: bool) -> None:
        if not keep and (not self.line or self.line[-1] == " "):
            s = s.lstrip(" ")
        self.line += s

    def end(self, always: bool = False) -> None:
        line = self.line.rstrip(" ")
        if line or always:
            if self.gap and self.out:
                self.out.append("")
            self.gap = 0
            self.out.append(self.lead + line if line else "")
            self.lead = " " * len(self.lead)
        self.line = ""

    def space(self) -> None:
        self.end()
        self.gap = 1


def _table(node: Node, depth: int) -> list[str]:
    """The lines of a table: each column as wide as its widest cell, spanned ones as wide as they need to be together."""
    rows, captions, todo = [], [], [node]
    while todo:
        n = todo.pop()
        cells = [k for k in n.kids if isinstance(k, Node) and k.tag in ("td", "th")]
        if n.tag == "tr" or cells:
            rows.append([(render(c, depth + 1).split("\n"), c) for c in cells])
        todo += [k for k in reversed(n.kids) if isinstance(k, Node) and k.tag in ("tr", "thead", "tbody", "tfoot")]
        captions += [render(k, depth + 1) for k in n.kids if isinstance(k, Node) and k.tag not in ("tr", "thead", "tbody", "tfoot", "td", "th", "col", "colgroup")]
        captions += [_SPACE.sub(" ", k).strip() for k in n.kids if isinstance(k, str)]
    most = max((len(r) for r in rows), default=0)
    placed, taken = [], {}  # taken: columns that cells above still span, and for how many rows
    for r in rows:
        column, own = 0, []
        for text, cell in r:
            while taken.get(column):
                column += 1
            across = min(cell.across, most, max(1, COLUMNS - column))
            own.append((column, across, text))
            if cell.down > 1:
                taken |= {c: cell.down for c in range(column, column + across)}
            column += across
        placed.append(own)
        taken = {c: k - 1 for c, k in taken.items() if k > 1}
    begun = {c for r in placed for c, _, _ in r}  # a column in which no cell begins has no gap before it
    wide = [0] * max((c + n for r in placed for c, n, _ in r), default=0)
    for spans in (False, True):
        for c, n, text in (x for r in placed for x in r):
            need = max(map(len, text))
            if n == 1 and not spans:
                wide[c] = max(wide[c], need)
            elif n > 1 and spans:
                wide[c + n - 1] += max(0, need - sum(wide[c : c + n]) - 2 * sum(k in begun for k in range(c + 1, c + n)))
    first = [0]
    for c, w in enumerate(wide):
        first.append(first[-1] + w + 2 * (c + 1 in begun))
    lines = [x for c in captions if c for x in c.split("\n")]
    for r in placed:
        for k in range(max((len(t) for _, _, t in r), default=0)):
            line = ""
            for c, _, text in r:
                line = line.ljust(first[c]) + (text[k] if k < len(text) else "")
            lines.append(line.rstrip())
    return [x for x in lines if x]


def render(root: Node, depth: int = 0) -> str:
    """All visible text below a node; depth: tables around it."""
    w, lists = _Writer(), []
    todo: list = [(root, False)] if root.tag not in ("td", "th", "caption") else [(k, False) for k in reversed(root.kids)]
    while todo:
        node, keep = todo.pop()
        if isinstance(node, str):
            w.text(node, keep)
        elif callable(node):
            node()
        elif node.tag == "br":
            w.end(True)
        elif node.tag == "table" and depth < NEST:
            w.space()
            for x in _table(node, depth):
                w.line = x
                w.end()
            w.space()
        elif node.tag in BLOCKS:
            step = w.space if node.tag in SPACED and not (lists and node.tag in ("ul", "ol", "p")) else w.end
            step()
            after = [step]
            if node.tag in ("ul", "ol", "menu", "dir"):
                lists.append(node.start if node.start is not None else 1) if node.tag == "ol" else lists.append(None)
                before = w.lead
                after = [lambda before=before: (step(), lists.pop(), setattr(w, "lead", before))]
            elif node.tag == "li":
                number = lists[-1] if lists else None
                if number is not None:
                    lists[-1] = number + 1
                before = w.lead
                w.lead = "  " * max(0, len(lists) - 1) + ("- " if number is None else f"{number}. ")
                after = [lambda before=before: (step(), setattr(w, "lead", before))]
            elif node.tag in ("dd", "blockquote"):
                before = w.lead
                w.lead = before + "  "
                after = [lambda before=before: (step(), setattr(w, "lead", before))]
            todo += [(a, False) for a in after]
            todo += [(k, keep or node.tag == "pre") for k in reversed(node.kids)]
        else:
            if node.tag in ("td", "th"):
                w.text(" ", False)
            todo += [(k, keep) for k in reversed(node.kids)]
    w.end()
    return "\n".join(w.out).strip("\n")


def html_to_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def _run(batches):
    for batch in batches:
        got = [html_to_text(None if x is None else x.decode("utf-8", "replace")) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(got, pa.string())], names=["page_id", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text for each row of pages(page_id, html, ...).

    A null page has a null text, an empty or wholly hidden one an empty text.
    Broken markup is read as far as it goes; a tag that never ends makes the rest
    text. Pages may be of any length and depth (see NEST for tables in tables).
    Bytes that are no UTF-8 are read as U+FFFD. Repeated rows are each extracted; other columns are ignored. An empty table
    gives an empty result.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("binary").alias("html")).mapInArrow(_run, "page_id long, text string")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
