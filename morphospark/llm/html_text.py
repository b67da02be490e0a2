"""Visible text of HTML pages with their layout.

A tokeniser of one regular expression feeds a tree builder that closes and
opens implied tags; a renderer then walks the tree, leaves out what a browser
does not show, and keeps block spacing, list markers and table columns.  Cells
stand in a grid that follows colspan and rowspan; a cell of several lines makes
its row as high, and lines too long for a column are wrapped inside it.

Pages are independent rows: no shuffle.  Edge cases: a null or empty page has
empty text; unclosed, misnested and unknown tags and broken entities never
fail; elements nested deeper than ``MAX_DEPTH`` become children of the one at
that depth, as in browsers, and what is hidden there stays hidden; pages of any length are read whole; repeated rows
are each rendered; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 200
#: Lines of a cell longer than this are wrapped at blanks, but for those of a table's last column.
CELL_WIDTH = 80
#: The standard's limits of spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: Inputs that show no value.
WORDLESS = frozenset("hidden password checkbox radio file image color range".split())

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg "
                   "math datalist meta link base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
                  "section summary table ul tr td th caption thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu dir".split())
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption".split())
#: Opening the key closes an open element of the value, unless one of the fences lies between.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ("body",)),
}

_TOKEN = re.compile(
    r"[^<]++|<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"?|'[^']*+'?)*+)>?|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_INTERESTING = re.compile(r"hidden|style|colspan|rowspan|start|type|value|open", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(raw):
    if not raw or not _INTERESTING.search(raw):
        return None
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def parse(page: str) -> Node:
    root = Node("html")
    stack = [root]

    def close(tags, fences):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in fences:
                return
            if stack[i].tag in tags:
                outer = next((j for j in range(1, i) if stack[j].tag in tags
                              and not any(s.tag in fences for s in stack[j:i])), i)
                del stack[outer:]
                return

    def open_(tag, attrs):
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        rule = IMPLIED_END.get(tag)
        if rule:
            close(*rule)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_("tr", None)  # a cell outside a row
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        # Beyond the limit only hidden elements go on the stack, with what they hold.
        if tag not in VOID and (len(stack) < MAX_DEPTH or len(stack) < 2 * MAX_DEPTH and (
                _hidden(node) or any(_hidden(x) for x in stack[MAX_DEPTH:]))):
            stack.append(node)
        return node

    at, lowered = 0, None
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "p" and not any(s.tag == "p" for s in stack):
                open_("p", None)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("tr", "table", "thead", "tbody", "tfoot",
                                                                         "body", "html"):
                    break  # an end tag does not reach out of its cell
            continue
        if tag in ("html", "body") and any(s.tag == tag for s in stack):
            continue
        node = open_(tag, _attributes(m["attrs"]))
        if tag in RAW and not m["attrs"].endswith("/"):
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find("</" + tag, at) if len(lowered) == len(page) else -1
            if end < 0:
                found = re.compile("</" + re.escape(tag), re.I).search(page, at)
                end = found.start() if found else len(page)
            body = page[at:end]
            node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = end
            if stack[-1] is node:
                stack.pop()
    return root


def _hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or (a and ("hidden" in a or _HIDING.search(a.get("style", "")))):
        return True
    return node.tag == "input" and a.get("type", "text").lower() in WORDLESS


class _Lines:
    """Text under construction: inline text joins the last line, blocks start new ones."""

    def __init__(self):
        self.lines, self.line, self.gap, self.prefix = [], "", 0, ""

    def inline(self, text):
        text = _BLANKS.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def flush(self):
        done = self.line.rstrip(" ")
        self.line = ""
        if done:
            if self.lines:
                self.lines += [""] * max(0, self.gap)
            self.lines.append(self.prefix + done if self.prefix else done)
            self.prefix = re.sub(r"\S", " ", self.prefix)
            self.gap = 0

    def block(self, gap):
        self.flush()
        self.gap = max(self.gap, gap)


def _number(value, default):
    return int(value) if re.fullmatch(r"-?\d{1,6}", value.strip()) else default


def _render(node: Node, out: _Lines, depth: int) -> None:
    """Appends the visible text of the children of ``node``."""
    count = _number(node.attrs.get("start", ""), 1) if node.tag == "ol" else 0
    for child in node.children:
        if isinstance(child, str):
            out.inline(child)
            continue
        tag = child.tag
        if _hidden(child):
            continue
        if tag == "br":
            if not out.line:
                out.gap = max(out.gap, 1 if out.lines else 0)
            out.flush()
        elif tag == "pre":
            out.block(1)
            text = "".join(_plain(child))
            for line in text.strip("\n").split("\n"):
                out.lines += [""] * out.gap if out.lines else []
                out.gap = 0
                out.lines.append(out.prefix + line.rstrip())
            out.block(1)
        elif tag == "table":
            out.block(1)
            _table(child, out, depth)
            out.block(1)
        elif tag == "details" and "open" not in child.attrs:  # closed: its summary shows
            out.block(0)
            first = next((x for x in child.children if isinstance(x, Node) and x.tag == "summary"), None)
            if first is not None and not _hidden(first):
                _render(first, out, depth + 1)
            out.block(0)
        elif tag == "input":
            out.inline(" " + child.attrs.get("value", "") + " ")
        elif tag == "li":
            out.block(0)
            saved = out.prefix
            mark = f"{count}. " if node.tag == "ol" else "- "
            count += 1
            out.prefix = re.sub(r"\S", " ", saved) + mark
            _render(child, out, depth + 1)
            out.block(0)
            out.prefix = re.sub(r"\S", " ", saved)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag == "li"
            out.block(1 if tag in SPACED and not nested else 0)
            _render(child, out, depth + 1)
            out.block(1 if tag in SPACED and not nested else 0)
        else:
            if tag in ("option", "button"):
                out.inline(" ")
            _render(child, out, depth + 1)


def _plain(node):
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif not _hidden(child):
            if child.tag == "br":
                yield "\n"
            yield from _plain(child)


def _span(cell, name, most):
    return max(1, min(most, _number(cell.attrs.get(name, ""), 1))) if isinstance(cell, Node) else 1


def _rows(node):
    """Rows of a table in order, captions and stray content as rows of one cell; a cell is (node, columns, rows)."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield [(child, 1, 1)]
        elif _hidden(child):
            continue
        elif child.tag == "tr":
            yield [(c, _span(c, "colspan", MAX_COLSPAN),
                    MAX_ROWSPAN if isinstance(c, Node) and c.attrs.get("rowspan", "").strip() == "0"
                    else _span(c, "rowspan", MAX_ROWSPAN))
                   for c in child.children if (c.strip() if isinstance(c, str) else not _hidden(c))]
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child)
        elif child.tag not in ("colgroup", "col"):
            yield [(child, 1, 1)]


def _wrapped(lines):
    """The lines, those beyond ``CELL_WIDTH`` cut at blanks; a longer word stays whole."""
    out = []
    for line in lines:
        while len(line) > CELL_WIDTH:
            cut = line.rfind(" ", 1, CELL_WIDTH + 1)
            cut = cut if cut > 0 and line[:cut].strip() else line.find(" ", CELL_WIDTH)
            if cut < 0:
                break
            out.append(line[:cut].rstrip())
            line = line[cut:].lstrip()
        out.append(line)
    return out


def _grid(node, depth):
    """Rows of (first column, columns, lines), each cell below and beside the spans of those before it."""
    rows, busy = [], {}
    for row in _rows(node):
        placed, at, begun = [], 0, {}
        for cell, columns, down in row:
            while busy.get(at, 0) > 0:
                at += 1
            own = _Lines()
            holder = cell
            if isinstance(cell, str):
                holder = Node("td")
                holder.children.append(cell)
            _render(holder, own, depth + 1)
            own.flush()
            placed.append((at, columns, own.lines))
            if down > 1:
                begun |= {at + k: down for k in range(columns)}
            at += columns
        busy = {k: n - 1 for k, n in (busy | begun).items() if n > 1}
        rows.append(placed)
    return rows


def _table(node, out, depth):
    rows = _grid(node, depth)
    last = max((at + columns for row in rows for at, columns, _ in row), default=0)
    rows = [[(at, columns, lines if at + columns >= last else _wrapped(lines)) for at, columns, lines in row] for row in rows]
    widths: dict[int, int] = {}
    for row in rows:
        for at, columns, lines in row:
            if columns == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
    for row in rows:  # a cell over several columns widens the last of them if it needs more
        for at, columns, lines in row:
            if columns > 1 and at + columns < last:
                lacking = max(map(len, lines), default=0) - sum(widths.get(at + k, 0) + 2 for k in range(columns)) + 2
                if lacking > 0:
                    widths[at + columns - 1] = widths.get(at + columns - 1, 0) + lacking
    starts, left = [], 0
    for k in range(last):
        starts.append(left)
        left += widths.get(k, 0) + 2
    for row in rows:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            text = ""
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    text = text.ljust(starts[at]) + lines[i] if len(text) <= starts[at] else f"{text}  {lines[i]}"
            out.line = text
            out.flush()


def page_text(page: str) -> str:
    out = _Lines()
    _render(parse(page), out, 0)
    out.flush()
    return "\n".join(out.lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines of every page."""
    def run(batches):
        for batch in batches:
            texts = [page_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_lines"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_lines bigint")
