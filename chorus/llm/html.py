"""Operator 2, HTML extraction: all visible text of a page, laid out as lines.

``parse`` builds a tree with implied end tags (paragraphs, list items, definition terms, options, table
parts) and implied rows; ``render`` walks it without recursion and writes what a reader would see:

* hidden: head, script, style, template and other unrendered elements, the ``hidden`` attribute, ``display:none``,
  ``visibility:hidden`` (a visible descendant shows again; other values inherit), ``content-visibility:hidden``, closed ``details``
  except their summary, options other than the selected one; only style attributes are read, not the page's style sheets;
* the text of formulas and drawings, ``xmp`` and the value of text inputs are visible;
* blocks start on a new line; paragraphs, headings, lists and tables are set off by one blank line;
* list items begin with ``- `` or their number and are indented, to a depth of ``DEEPEST``; quotes begin with ``> ``;
* table cells are padded to the width of their column (cells beyond ``WIDEST`` characters do not count for
  the width, columns beyond ``WIDEST_TABLE`` are not aligned), rows and columns that span keep their place; ``pre`` keeps its spaces and breaks.

Defined results: null and empty pages give the empty text; text outside any element counts; unclosed,
crossed and unknown tags are repaired as above; a tag without its closing ``>`` is text; very long and
deeply nested pages are read whole; repeated rows are rendered alike; an empty table gives an empty
result. Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.textarrays import fresh, quoted

WIDEST = 80
WIDEST_TABLE = 10_000               # columns beyond this one follow the cell before them, two blanks apart
DEEPEST = 64                        # nested lists, definitions and quotes beyond this depth are not indented further

# Element classes of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("""head script style template noscript noembed noframes iframe title meta link base object audio video canvas datalist area param source track
annotation annotation-xml desc metadata defs symbol clippath""".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption option optgroup xmp""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp table figure hr fieldset".split())
CLOSE_P = BLOCKS - frozenset("dd dt li body html caption option optgroup legend summary".split()) | frozenset(["dd", "dt", "li", "summary"])
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript head html".split())
# start tag -> (open elements that it ends, elements beyond which it does not look)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}), "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "caption": ({"caption"}, {"table"}), "colgroup": ({"caption", "colgroup"}, {"table"}),
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>
|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*+)(?P<loose>[^>]*+)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NO_TEXT = frozenset("hidden checkbox radio file image range color password".split())     # inputs that show no text of their own
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), entities.unescape(value))
    return out


class Builder:
    """Tree from tokens; ``open`` is the path from the root to the current element."""

    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def pop_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.count[node.tag] -= 1
        del self.open[depth:]

    def nearest(self, tags: set[str], stop: set[str]) -> int:
        """Depth of the outermost open element of ``tags`` inside the nearest one of ``stop``; 0 if none."""
        if not any(self.count.get(t) for t in tags):
            return 0
        best = 0
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in stop:
                break
            if tag in tags:
                best = depth
        return best

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if self.count.get("head") and tag not in HEAD_ONLY:
            self.pop_to(next(d for d, n in enumerate(self.open) if n.tag == "head"))
        if tag in ("html", "body") and self.count.get(tag):
            return
        if tag in CLOSE_P and self.count.get("p") and (depth := self.nearest({"p"}, {"table", "td", "th", "caption", "button", "object"})):
            self.pop_to(depth)
        if tag in ENDS and (depth := self.nearest(*ENDS[tag])):
            self.pop_to(depth)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.push(Node("tr", {}))
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.pop_to(len(self.open) - 1)
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        if not self.count.get(tag):
            return
        stop = {"table"} if tag in TABLE_PARTS else set() if tag in ("table", "html", "body") else {"td", "th", "caption", "table"}
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.pop_to(depth)
                return
            if self.open[depth].tag in stop:
                return

    def text(self, raw: str) -> None:
        if raw:
            if self.count.get("head") and not raw.isspace():
                self.pop_to(next(d for d, n in enumerate(self.open) if n.tag == "head"))
            self.open[-1].children.append(entities.unescape(raw) if "&" in raw else raw)


def parse(page: str) -> Node:
    builder, at = Builder(), 0
    while m := _TOKEN.search(page, at):
        builder.text(page[at : m.start()])
        at = m.end()
        if m["end"]:
            builder.end(m["end"].lower())
        elif tag := m["start"] or m["odd"]:
            tag = tag.lower()
            attrs = attributes(m["attrs"] or m["loose"] or "")
            if tag in RAW:
                stop = _RAW_END[tag].search(page, at)
                raw = page[at : stop.start()] if stop else page[at:]
                at = stop.end() if stop else len(page)
                builder.start(tag, attrs)
                if tag in ("textarea", "xmp"):
                    builder.text(raw if tag == "textarea" else raw.replace("&", "&amp;"))
                builder.end(tag)
            else:
                builder.start(tag, attrs)
        elif m[0].startswith("<![CDATA["):
            builder.text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
    builder.text(page[at:])
    return builder.root


class Flow:
    """Lines of one block container."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0

    def put(self, text: str) -> None:
        """A whole line or several, as they are."""
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(text)

    def flush(self) -> None:
        if self.line:
            text = "".join(self.line).rstrip(" ")
            self.line = []
            if text:
                self.put(text)

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def keep(self, text: str) -> None:
        """Preformatted text: its breaks are line breaks."""
        first, *more = text.replace("\r\n", "\n").split("\n")
        if first:
            self.line.append(first)
        for part in more:
            self.put("".join(self.line))
            self.line = [part] if part else []

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def embed(self, lines: list[str], first: str, rest: str) -> None:
        for k, x in enumerate(lines):
            self.put((first if k == 0 else rest) + x if x or k == 0 else "")

    def done(self) -> list[str]:
        self.flush()
        return self.lines


class Grid:
    """Cells of one table in reading order: (row, column, columns spanned, lines)."""

    def __init__(self):
        self.cells: list[tuple[int, int, int, list[str]]] = []
        self.row, self.column = -1, 0
        self.taken: dict[int, int] = {}      # column -> rows still covered from above
        self.caption: list[str] = []

    def next_row(self) -> None:
        self.row += 1
        self.column = 0
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def add(self, lines: list[str], across: int, down: int) -> None:
        if self.row < 0:
            self.next_row()
        while self.column in self.taken:
            self.column += 1
        self.cells.append((self.row, self.column, across, lines))
        if down > 1:
            self.taken |= {self.column + k: down for k in range(across)}
        self.column += across

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for _, column, across, lines in self.cells:
            wide = [len(x) for x in lines if len(x) <= WIDEST]
            if across == 1:
                width[column] = max([width.get(column, 0), *wide])
        out = list(self.caption)
        known = sorted(width)
        upto = list(accumulate((width[c] for c in known), initial=0))
        at = 0
        while at < len(self.cells):
            row = []
            while at < len(self.cells) and (not row or self.cells[at][0] == row[0][0]):
                row.append(self.cells[at])
                at += 1
            for k in range(max(len(c[3]) for c in row) if row else 0):
                text, place = "", 0
                for _, column, _, lines in row:
                    start = upto[bisect_left(known, column)] + 2 * column if column <= WIDEST_TABLE else place
                    piece = lines[k] if k < len(lines) else ""
                    if piece:
                        text = text.ljust(start) if len(text) < start else text + "  " if text else text
                        text += piece
                    place = start
                out.append(text.rstrip(" "))
            if row and not any(c[3] for c in row):
                continue
        return out


def _seen(node: Node, shown: bool) -> tuple[bool, bool]:
    """(rendered at all, visible) of an element."""
    attrs = node.attrs
    if node.tag in UNSEEN or "hidden" in attrs:
        return False, False
    if "style" in attrs:
        style = _declarations(attrs["style"])
        if style.get("display") == "none":
            return False, False
        if style.get("visibility") in ("hidden", "collapse"):
            shown = False
        elif style.get("visibility") in ("visible", "initial"):
            shown = True
        elif style.get("content-visibility") == "hidden":
            return False, False
    return True, shown


def _declarations(style: str) -> dict[str, str]:
    """Property names and values of a style attribute, lower-cased; the last of equal names counts, ``!important`` ones before others."""
    out: dict[str, str] = {}
    fixed: dict[str, str] = {}
    for part in _COMMENT.sub("", style).split(";"):
        name, colon, value = part.partition(":")
        if colon:
            value = value.strip().lower()
            plain = value.removesuffix("important").rstrip()
            if plain != value and plain.endswith("!"):
                fixed[name.strip().lower()] = plain[:-1].rstrip()
            else:
                out[name.strip().lower()] = value
    return out | fixed


def _number(value: str | None, most: int) -> int:
    m = re.match(r"\s*(\d+)", value or "")
    return max(1, min(int(m[1]), most)) if m else 1


def _mark(node: Node, lists: list) -> str:
    """The mark of a list item; numbered lists go on counting."""
    if not lists or lists[-1][0] != "ol":
        return "- "
    here = _number(node.attrs.get("value"), 10**9) if "value" in node.attrs else lists[-1][1]
    lists[-1][1] = here + 1
    return f"{here}. "


def render(root: Node) -> str:
    """Lines of the visible text of a tree."""
    flat: set[int] = set()               # items too deep to be indented
    flows, grids, lists, pre = [Flow()], [], [], 0
    work: list[tuple] = [("in", root, True)]
    while work:
        step, node, shown = work.pop()
        if step == "text":
            if shown:
                if pre:
                    flows[-1].keep(node)
                else:
                    flows[-1].inline(node)
            continue
        tag = node.tag
        if step == "in":
            here, shown = _seen(node, shown)
            if not here:
                continue
            if tag == "br":
                if flows[-1].line:
                    flows[-1].flush()
                elif flows[-1].lines and not flows[-1].gap:
                    flows[-1].gap = 1
                continue
            if tag == "input":
                if shown and node.attrs.get("type", "").strip().lower() not in _NO_TEXT:
                    flows[-1].inline(node.attrs.get("value", ""))
                continue
            if tag in VOID and tag != "hr":
                continue
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif tag == "select":
                options = [c for g in children if isinstance(g, Node) for c in ([g] if g.tag == "option" else g.children) if isinstance(c, Node)]
                children = [next((o for o in options if "selected" in o.attrs), options[0])] if options else []
            if tag == "table":
                flows[-1].block(1)
                grids.append(Grid())
                flows.append(Flow())
            elif tag == "tr" and grids:
                grids[-1].next_row()
            elif tag in ("li", "blockquote", "dd") and len(flows) > DEEPEST:
                flows[-1].block(1 if tag == "blockquote" else 0)
                flat.add(id(node))
                if tag == "li":
                    flows[-1].inline(_mark(node, lists))
            elif tag in ("li", "blockquote", "caption", "dd") or tag in ("td", "th") and grids:
                flows[-1].block(1 if tag == "blockquote" else 0)
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                flows[-1].block(0 if lists else 1)
                lists.append([tag, _number(node.attrs.get("start"), 10**9) if tag == "ol" else 0])
            elif tag == "option":
                flows[-1].inline(" ")
            elif tag in BLOCKS:
                flows[-1].block(1 if tag in SPACED else 0)
            if tag in ("pre", "xmp"):
                pre += 1
            work.append(("out", node, shown))
            work += [("in" if isinstance(c, Node) else "text", c, shown) for c in reversed(children)]
            continue
        if tag in ("pre", "xmp"):
            pre -= 1
        if tag == "table":
            stray, grid = flows.pop().done(), grids.pop()
            flows[-1].embed(stray, "", "")
            flows[-1].embed(grid.lines(), "", "")
            flows[-1].block(1)
        elif tag in ("td", "th") and grids:
            lines = flows.pop().done()
            grids[-1].add(lines, _number(node.attrs.get("colspan"), 1000), _number(node.attrs.get("rowspan"), 65534))
        elif tag == "caption":
            lines = flows.pop().done()
            if grids:
                grids[-1].caption += lines
            else:
                flows[-1].embed(lines, "", "")
        elif id(node) in flat:
            flows[-1].block(1 if tag == "blockquote" else 0)
        elif tag == "li":
            lines = flows.pop().done()
            mark = _mark(node, lists)
            if lines:
                flows[-1].embed(lines, mark, " " * len(mark))
        elif tag == "dd":
            flows_lines = flows.pop().done()
            flows[-1].embed(flows_lines, "  ", "  ")
        elif tag == "blockquote":
            lines = flows.pop().done()
            flows[-1].embed(lines, "> ", "> ")
            flows[-1].block(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flows[-1].block(0 if lists else 1)
        elif tag in BLOCKS:
            flows[-1].block(1 if tag in SPACED else 0)
    return "\n".join(flows[0].done())


def visible_text(page: str | None) -> str:
    return render(parse(page or ""))


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with ``text``, ``n_lines`` and ``n_words`` of every page's visible text; a name that ``keep`` has as well gets a
    trailing underscore."""
    given = pages.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(html)).cast("string").alias("page_html"))
    own = pages.select(*[F.col(quoted(c)) for c in keep])
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(fresh(own, "text"), T.StringType()), T.StructField(fresh(own, "n_lines"), T.LongType()), T.StructField(fresh(own, "n_words"), T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [visible_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                counts = [[x.count("\n") + 1 if x else 0 for x in texts], [len(x.split()) for x in texts]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], schema.names)

    return given.mapInArrow(run, schema)
