"""HTML extraction: layout-aware rendering of all visible text.

A tokenizer reads the page in one pass: a quote that is never closed is no quote,
a tag that is never closed is text from there on, and comments and raw elements that
aren't closed reach to the end; so no part of a page is scanned again and again.
A tree builder supplies implied tags (an opening block closes a paragraph, <li>, <td>, <tr>, <option> and
the like close their predecessors, stray end tags are ignored, open elements
are closed at the end). Visibility: head, script, style, template and similar
elements, hidden attributes, what a closed <details> holds beside its summary, and display:none hide all within;
visibility is inherited, so a visible child of a hidden parent shows. Both come from inline
styles and from rules of <style> sheets whose selector is a tag, a class, an id, or a tag with one of these; other selectors and
@-rules are not read. Buttons' and filled fields' values are text.
Rendering: white space collapses outside <pre>; blocks, by tag or by an inline display, start new lines and
paragraph-like blocks stand apart by an empty line; list items carry
their bullet or number (start, value, reversed and type as HTML has them), indented by depth; the cells of a table are padded
to their columns' widths, which takes a cell's lines and its row and column spans into account.

Trees are walked with a stack of their own, so depth costs no recursion. Bounds of layout, none of
text: the white space of an indent ends at ``MAX_INDENT`` steps, tables more than ``MAX_NESTED`` deep are plain blocks, row
spans end at column ``MAX_COLSPAN``. Time and memory grow with the page's length. A null
or empty page gives an empty text; broken markup is read as text, never an error. Rows that repeat a page give it again; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_INDENT, MAX_NESTED = 512, 64
#: As HTML has them.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template title meta link iframe audio video canvas datalist desc metadata annotation annotation-xml".split())
#: Blocks; the value is the number of line breaks around them.
BLOCKS = dict.fromkeys("address article aside body center dd details dialog dir div dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option search section summary tbody tfoot thead tr ul caption".split(), 1)
BLOCKS |= dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre dl table hr".split(), 2)
CLOSES_P = frozenset(set(BLOCKS) - {"tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body", "legend"})
#: An opening tag closes open elements of these names, up to a boundary.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SPACE = re.compile(r"[ \t\n\r\f]+")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: Elements whose content is text up to their own end tag; of the second kind, references are read.
RAW, RAW_WITH_REFERENCES = frozenset("script style xmp iframe noembed noframes".split()), frozenset("textarea title".split())
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW | RAW_WITH_REFERENCES}
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]+|=)(?:\s*(=)\s*)?)")
UNQUOTED = re.compile(r"[^\s>]*")
LONG_REFERENCE = re.compile(r"&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])(-?[_a-zA-Z][\w-]*))?")


def references(text: str) -> str:
    """Character references as characters; numbers beyond all characters as the replacement character."""
    if "&" not in text:
        return text
    return html.unescape(LONG_REFERENCE.sub(lambda m: m[0] if len(m[1] or m[2]) < 8 else "\ufffd", text))


def tokens(page: str):
    """("text", data), ("start", tag, attributes, closed at once) and ("end", tag), in one pass."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    foreign = 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            break
        if lt > at:
            yield "text", references(page[at:lt])
        at = lt
        after = page[lt + 1 : lt + 2]
        if after == "!":
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    at = page.index(">", lt) + 1
                    continue
                ends = [(i, k) for mark, k in (("-->", 3), ("--!>", 4)) if (i := page.find(mark, lt + 4)) >= 0] if last[">"] > lt else []
                at = sum(min(ends)) if ends else n
            elif foreign > 0 and page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                yield "text", page[lt + 9 : end if end >= 0 else n]
                at = end + 3 if end >= 0 else n
            else:
                at = page.find(">", lt) + 1 or n
        elif after == "?" or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
            if last[">"] < lt:
                break
            at = page.find(">", lt) + 1
        elif after == "/":
            if last[">"] < lt:
                break
            name = TAG_NAME.match(page, lt + 2)
            at = page.find(">", lt) + 1
            if name:
                tag = name[0].lower()
                foreign -= tag in ("svg", "math") and foreign > 0
                yield "end", tag
        elif name := TAG_NAME.match(page, lt + 1):
            tag, i, attrs, closed = name[0].lower(), name.end(), {}, False
            while last[">"] >= i:
                m = ATTRIBUTE.match(page, i)
                if not m:
                    i = n
                    break
                i = m.end()
                if m[1]:
                    closed = page[i - 2] == "/"
                    break
                value = None
                if m[3]:
                    quote = page[i : i + 1]
                    if quote and quote in "\"'" and last[quote] > i:
                        end = page.find(quote, i + 1)
                        value, i = page[i + 1 : end], end + 1
                    else:
                        value = UNQUOTED.match(page, i)[0]
                        i += len(value)
                    value = references(value)
                attrs.setdefault(m[2].lower(), value)
            else:
                i = n + 1
            if i > n or page[i - 1] != ">":
                break  # the tag isn't closed
            at = i
            foreign += tag in ("svg", "math") and not closed
            yield "start", tag, attrs, closed
            if tag == "plaintext":
                yield "text", page[at:]
                at = n
            elif tag in RAW_END and not foreign:
                end = RAW_END[tag].search(page, at)
                data = page[at : end.start() if end else n]
                yield "text", references(data) if tag in RAW_WITH_REFERENCES else data
                at = end.start() if end else n
                if not end:
                    break
        else:
            yield "text", "<"
            at = lt + 1
    if at < n:
        yield "text", references(page[at:])


def declared(css: str) -> dict:
    return {k.lower(): x.lower() for k, x in STYLE.findall(css)}


def sheet_rules(css: str, rules: dict) -> None:
    """Adds {(tag, kind, name): declarations} of the rules that say something of display or visibility; later ones win."""
    parts, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        parts.append(css[at:start])
        end = css.find("*/", start + 2)
        at = end + 2 if end >= 0 else len(css)
    css, at = "".join([*parts, css[at:]]), 0
    while (brace := css.find("{", at)) >= 0:
        said = css[at:brace].rpartition(";")[2].rpartition("}")[2].strip()
        if said.startswith("@"):
            depth, i = 1, brace + 1
            for m in re.compile(r"[{}]").finditer(css, i):
                depth += 1 if m[0] == "{" else -1
                i = m.end()
                if not depth:
                    break
            at = i if not depth else len(css)
            continue
        end = css.find("}", brace)
        end = len(css) if end < 0 else end
        found = declared(css[brace + 1 : end])
        if found:
            for one in said.split(","):
                m = SELECTOR.fullmatch(one.strip())
                if m and m[0]:
                    key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                    rules.setdefault(key, {}).update(found)
        at = end + 1


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class Tree:
    def __init__(self, page: str):
        self.root, self.rules = Node("#root"), {}
        self.open, self.at = [self.root], defaultdict(list)  # at: where elements of a name are open
        for kind, *what in tokens(page):
            if kind == "text":
                self.handle_data(*what)
            elif kind == "end":
                self.handle_endtag(*what)
            elif what[2]:
                self.handle_startendtag(*what[:2])
            else:
                self.handle_starttag(*what[:2])

    def _cut(self, i: int) -> None:
        for n in reversed(self.open[i:]):
            self.at[n.tag].pop()
        del self.open[i:]

    def _close_to(self, names, stops) -> None:
        """Close the innermost open element of these names and all in it, unless a stop comes first."""
        last = lambda tags: max((self.at[t][-1] for t in tags if self.at[t]), default=0)
        i = last(names)
        if i and i >= last(stops):
            self._cut(i)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.at[tag]:
            return
        if self.open[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
            self._cut(len(self.open) - 1)  # anything visible ends the head
        if tag in CLOSES_P:
            self._close_to({"p"}, {"td", "th", "table", "button", "caption", "object", "template"})
        if tag in SIBLINGS:
            self._close_to(*SIBLINGS[tag])
        if tag in ("tr", "tbody", "thead", "tfoot"):
            self._close_to({"tr"}, {"table"})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._cut(len(self.open) - 1)
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        foreign = self.at["svg"] or self.at["math"] or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)
        if foreign and self.open[-1].tag == tag and tag not in VOID:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].kids.append(Node("br"))
        elif tag == "p" and not self.at["p"]:
            self.open[-1].kids.append(Node("p"))
        elif tag not in VOID:
            stops = () if tag in ("table", "body", "html") else {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"td", "th", "table"}
            self._close_to({tag}, stops)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._cut(len(self.open) - 1)
        if self.open[-1].tag == "style":
            sheet_rules(data, self.rules)
        self.open[-1].kids.append(data)

    def styles(self, node: Node) -> dict:
        """display and visibility of an element: of its tag, its classes, its id, and inline, the later over the earlier."""
        out = {}
        if self.rules:
            marks = [("", ""), *[(".", c) for c in (node.attrs.get("class") or "").split()], *([("#", node.attrs["id"])] if node.attrs.get("id") else [])]
            for mark in marks:
                for tag in ("", node.tag):
                    out |= self.rules.get((tag, *mark), {})
        return out | declared(node.attrs.get("style") or "")


def hidden(node: Node, style: dict) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or style.get("display") == "none"


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines, self.line, self.breaks, self.space, self.indent, self.mark = [], [], 0, False, 0, ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for i, piece in enumerate(data.replace("\r\n", "\n").split("\n")):
                if i:
                    self.newline()
                if piece:
                    self._put(piece)
            return
        words = SPACE.split(data)
        for i, word in enumerate(words):
            if i and (self.line or not self.lines or self.breaks):
                self.space = True
            if word:
                self._put(word)

    def _put(self, piece: str) -> None:
        if not self.line:
            if self.lines and self.breaks > 1 and self.lines[-1]:
                self.lines.append("")
            indent = min(self.indent, MAX_INDENT)
            pad = "  " * max(indent - 1, 0)
            self.line.append(pad + self.mark if self.mark else "  " * indent)
            self.mark, self.breaks, self.space = "", 0, False
        if self.space:
            self.line.append(" ")
            self.space = False
        self.line.append(piece)

    def newline(self) -> None:
        """A line break that stands even on an empty line."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif self.lines and not self.breaks:
            self.lines.append("")
        self.space = False

    def block(self, breaks: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.breaks = max(self.breaks, breaks)
        self.space = False

    def rows(self, lines: list[str], breaks: int = 2) -> None:
        self.block(breaks)
        for x in lines:
            self._put(x)
            self.block(1)

    def done(self) -> list[str]:
        self.block(1)
        out = self.lines
        while out and not out[-1]:
            out.pop()
        return out


def _number(text, usual: int) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return usual


def align(rows: list[tuple[dict, int]]) -> list[str]:
    """Rows of ({column: lines}, columns) -> lines with the cells padded to their columns. Columns that no cell begins in, in a run, are shown as one."""
    starts = sorted({c for cells, _ in rows for c in cells})
    shown, place = [], {}
    for c in starts:
        if c > (shown[-1] + 1 if shown else 0):
            shown.append(c - 1)
        place[c] = len(shown)
        shown.append(c)
    widths = [0] * len(shown)
    for cells, _ in rows:
        for c, lines in cells.items():
            widths[place[c]] = max(widths[place[c]], max(map(width, lines), default=0))
    out = []
    for cells, n in rows:
        count = bisect_left(shown, n) + (n > 0 and (not shown or n - 1 > shown[-1]))
        for k in range(max((len(x) for x in cells.values()), default=0)):
            line = [" " * w for w in widths[:count]] + [""] * (count - len(widths))
            for c, lines in cells.items():
                if k < len(lines):
                    line[place[c]] = lines[k] + " " * (widths[place[c]] - width(lines[k]))
            out.append(" | ".join(line).rstrip())
    return out


class Grid:
    """Rows of a table's cells; covered places of a span stay empty."""

    def __init__(self):
        self.rows, self.until = [], {}  # until: the last row that a cell above covers, by column

    def row(self) -> None:
        self.rows.append([{}, 0])

    def cell(self, lines: list[str], attrs: dict) -> None:
        row, now = self.rows[-1], len(self.rows) - 1
        at = row[1]
        while self.until.get(at, -1) >= now:
            at += 1
        across = min(max(_number(attrs.get("colspan"), 1), 1), MAX_COLSPAN)
        down = min(max(_number(attrs.get("rowspan"), 1), 0), MAX_ROWSPAN) or MAX_ROWSPAN
        if down > 1:
            self.until |= dict.fromkeys(range(at, min(at + across, MAX_COLSPAN)), now + down - 1)
        row[0][at], row[1] = lines, at + across

    def lines(self) -> list[str]:
        return align([(cells, n) for cells, n in self.rows if any(cells.values())])


def list_mark(number: int, kind: str | None) -> str:
    """The number of an ordered list's item, by the list's type."""
    if kind in ("a", "A") and number > 0:
        said = ""
        while number:
            number, k = divmod(number - 1, 26)
            said = chr(97 + k) + said
    elif kind in ("i", "I") and 0 < number < 4000:
        said, left = "", number
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            said += letters * (left // value)
            left %= value
    else:
        return f"{number}. "
    return f"{said if kind in 'ai' else said.upper()}. "


def field_text(attrs: dict) -> str:
    """What an <input> shows: its value, or a text field's placeholder."""
    kind = (attrs.get("type") or "text").lower()
    if kind in ("hidden", "checkbox", "radio", "password", "file", "range", "color"):
        return ""
    if kind == "image":
        return attrs.get("alt") or ""
    return attrs.get("value") or ("" if kind in ("submit", "reset", "button") else attrs.get("placeholder") or "")


#: Values of display that make any element a block, and those that make a block run in its line.
AS_BLOCK = frozenset("block flex grid list-item table flow-root".split())
IN_LINE = frozenset("inline inline-block inline-flex inline-grid contents".split())
#: Blocks whose layout an inline display doesn't undo here.
KEPT = frozenset("table tr td th tbody thead tfoot caption ul ol menu dir li dd blockquote hr br".split())


def breaks_of(node: Node, style: dict) -> int:
    """Line breaks around an element; 0 if it runs in its line."""
    own, display = BLOCKS.get(node.tag, 0), style.get("display")
    if display in AS_BLOCK:
        return max(own, 1)
    return 0 if display in IN_LINE and node.tag not in KEPT else own


def render(tree: Tree) -> str:
    """Walks the tree with a stack of (action, node); tables and cells collect into flows of their own."""
    flow, flows, lists, grids, pre, seen, deep, around = Flow(), [], [], [], 0, [True], 0, []
    stack = [("in", tree.root)]
    while stack:
        what, node = stack.pop()
        if what == "text":
            if seen[-1]:
                flow.text(node, pre > 0)
            continue
        tag = node.tag
        if what == "in":
            style = tree.styles(node)
            if hidden(node, style):
                continue
            shown = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility"), seen[-1])
            if tag == "br":
                if shown:
                    flow.newline()
                continue
            if tag == "hr":
                flow.block(2)
                continue
            if tag == "img":
                if shown and node.attrs.get("alt"):
                    flow.text(node.attrs["alt"], False)
                continue
            if tag == "input":
                if shown and (said := field_text(node.attrs)):
                    flow.text(said, False)
                continue
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
            around.append(breaks_of(node, style))
            if tag == "table":
                deep += 1
            flat = deep > MAX_NESTED
            if flat and tag in ("table", "tr", "td", "th"):
                flow.block(1)
            elif tag == "table":
                flow.block(2)
                flows.append(flow)
                grids.append(Grid())
                flow = Flow()
            elif tag == "tr" and grids:
                grids[-1].row()
            elif tag in ("td", "th") and grids:
                if not grids[-1].rows:
                    grids[-1].row()
                flows.append(flow)
                flow = Flow()
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.block(1 if lists else 2)
                back = tag == "ol" and "reversed" in node.attrs
                first = sum(isinstance(k, Node) and k.tag == "li" for k in kids) if back else 1
                lists.append([tag == "ol", _number(node.attrs.get("start"), first), -1 if back else 1, node.attrs.get("type")])
                flow.indent += 1
            elif tag == "li":
                flow.block(1)
                if lists:
                    if lists[-1][0]:
                        lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1])
                        flow.mark = list_mark(lists[-1][1], lists[-1][3])
                        lists[-1][1] += lists[-1][2]
                    else:
                        flow.mark = "- "
                else:
                    flow.mark = "- "
                if not shown:
                    flow.mark = ""
            elif tag in ("dd", "blockquote"):
                flow.block(BLOCKS[tag])
                flow.indent += 1
            elif around[-1]:
                flow.block(around[-1])
            pre += tag in ("pre", "textarea", "listing", "xmp", "plaintext")
            seen.append(shown)
            stack.append(("out", node))
            stack.extend(("text", k) if isinstance(k, str) else ("in", k) for k in reversed(kids))
        else:
            seen.pop()
            pre -= tag in ("pre", "textarea", "listing", "xmp", "plaintext")
            breaks, flat = around.pop(), deep > MAX_NESTED
            if tag == "table":
                deep -= 1
            if flat and tag in ("table", "tr", "td", "th"):
                flow.block(1)
            elif tag == "table":
                # What stands in a table outside its cells (captions, stray text) comes first.
                loose, grid = flow.done(), grids.pop()
                flow = flows.pop()
                flow.rows([*loose, *grid.lines()])
                flow.block(2)
            elif tag in ("td", "th") and grids:
                lines = flow.done()
                flow = flows.pop()
                grids[-1].cell(lines, node.attrs)
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.indent -= 1
                lists.pop()
                flow.mark = ""
                flow.block(1 if lists else 2)
            elif tag in ("dd", "blockquote"):
                flow.block(BLOCKS[tag])
                flow.indent -= 1
            elif breaks:
                flow.block(breaks)
                if tag == "li":
                    flow.mark = ""
    return "\n".join(flow.done())


def extract_text(page: str | None) -> str:
    return render(Tree(page or ""))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, text)."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract_text(h) for h in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
