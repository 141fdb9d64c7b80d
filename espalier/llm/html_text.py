"""Visible text of web pages, laid out as a reader sees it.

Each page is read once: a scanner cuts it into tags and text, tags become open
and close events, with the closings that HTML implies; a stack of open elements
decides what is visible; blocks, lists and tables are laid out as they close.
Every step looks things up instead of walking the stack, so that a page takes
time in proportion to its length, however deeply it is nested or broken. Spark
deals the pages out, this file holds the rules for one page.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from espalier.llm.common import q, small_batches, text_of

# Element names of the HTML standard, by the rule they follow.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set(
    "head script style template noscript noframes noembed iframe datalist object audio video canvas "
    "title annotation annotation-xml".split()
)
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure form fieldset hr".split())
BLOCKS = PARAGRAPHS | set(
    "html body address article aside dd details dialog div dt figcaption footer header hgroup legend li main menu nav "
    "optgroup option search section summary textarea tr td th thead tbody tfoot caption xmp".split()
)
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
# An opening tag (key) closes these elements if they are open, but looks no
# further out than the elements that bound them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPES = {"table", "td", "th", "button", "object", "template", "html", "caption", "svg", "math"}
# What an end tag inside a cell can't reach past, unless it ends a part of the table.
CELLS = {"td", "th", "caption", "object", "template"}
TABLE = set("table thead tbody tfoot tr td th caption colgroup html body".split())
HEAD = set("base link meta title style script noscript template html head".split())
FOREIGN = {"svg", "math"}
# Inside a drawing only these show their text, unless they are only defined there.
DRAWN, DEFINED = {"text", "foreignobject"}, {"defs", "symbol", "clippath", "mask", "pattern", "marker", "metadata"}

# A column is as wide as its widest cell, and wider cells than this are wrapped
# within it: else one long cell would be padded in every row.
WIDEST = 200
_MOST_SPAN = 1000  # fixed by the HTML standard

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
_COMMENT_END = re.compile(r"--!?>")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_CSS_PART = re.compile(r"[{};]")
_WIDTHS = re.compile(r"\(\s*(min-width|[a-z-]+)\s*(?::\s*([0-9.]+)(px|em|rem)?[^)]*)?[^)]*\)")
_SCREEN = 1280  # pixels; a page is read as on a common screen
_SPACE = re.compile(r"[ \t\n\r\f]+")


# --- the scanner -----------------------------------------------------------------


def tokens(source: str):
    """`(None, text, "")` or `(slash or "", name, attributes)` in order, with the
    place that the token ends at. A caller may send a place to go on from.

    Each search that can fail is given up for the rest of the page once it has
    failed, so the whole page is passed over a bounded number of times."""
    at, start, size = 0, 0, len(source)
    closed = comments = True
    quoted = True  # a tag's end is looked for outside quotes
    while True:
        at = source.find("<", at)
        if at < 0 or not closed:
            break
        name = _NAME.match(source, at + 2 if source.startswith("/", at + 1) else at + 1)
        if name is None and source[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if name is None:
            end = -1
            if source.startswith("<!--", at):
                found = _COMMENT_END.search(source, at + 4) if comments else None
                comments = comments and found is not None
                # A comment that isn't ended hides the rest; a dash or two may end it at once.
                end = at + 5 if source.startswith("<!-->", at) else found.end() if found else size
            elif source[at + 1] == "/" and at + 2 >= size:
                break
            else:
                end = source.find(">", at) + 1 or -1
            if end < 0:
                closed = False
                break
            if start < at:
                yield None, source[start:at], "", at
            at = start = end
            continue
        end = _tag_end(source, name.end()) if quoted else None
        if end is None:
            quoted = False
            end = source.find(">", name.end())
            if end < 0:
                closed = False
                break
        if start < at:
            yield None, source[start:at], "", at
        slash = "/" if source[at + 1] == "/" else ""
        told = yield slash, name[0].lower(), source[name.end() : end], end + 1
        at = start = end + 1 if told is None else told
    if start < size:
        yield None, source[start:], "", size


def _tag_end(source: str, at: int) -> int | None:
    """The place of the `>` that ends a tag, outside quotes; None if there is none."""
    while True:
        at = _PLAIN.match(source, at).end()
        if at >= len(source):
            return None
        if source[at] == ">":
            return at
        at = source.find(source[at], at + 1) + 1
        if not at:
            return None


# --- style sheets ----------------------------------------------------------------


def screen_rules(sheet: str):
    """`(selectors, declarations)` of the rules that apply to a screen."""
    sheet = _CSS_COMMENT.sub(" ", sheet)
    at, applies, opened = 0, [True], []
    for part in _CSS_PART.finditer(sheet):
        before, at = sheet[at : part.start()], part.end()
        if part[0] == "{":
            prelude = before.strip()
            if prelude.startswith("@"):
                opened.append(None)
                applies.append(applies[-1] and _at_rule_applies(prelude.lower()))
            else:
                opened.append([prelude])
                applies.append(applies[-1])
        elif opened:
            if opened[-1] is not None:
                opened[-1].append(before)
            if part[0] == "}":
                rule = opened.pop()
                if applies.pop() and rule is not None:
                    yield rule[0], ";".join(rule[1:])


def _at_rule_applies(prelude: str) -> bool:
    name, _, rest = prelude.partition(" ")
    if name.startswith("@media"):
        return any(_on_screen(q.strip()) for q in prelude[len("@media") :].split(","))
    return name in ("@supports", "@layer", "@container", "@scope")


def _on_screen(query: str) -> bool:
    kind = query.removeprefix("only ").split("(")[0].split(" and")[0].strip()
    if kind not in ("", "all", "screen"):
        return False
    for feature, size, unit in _WIDTHS.findall(query):
        wide = float(size or 0) * (1 if unit in ("", "px") else 16)
        if feature != "min-width" or wide > _SCREEN:
            return False
    return True


# --- the page --------------------------------------------------------------------


@dataclass
class Box:
    """A block: what it holds so far, as finished lines and a line in the making."""

    name: str
    hidden: bool = False
    keep_space: bool = False
    lines: deque = field(default_factory=deque)
    line: list[str] = field(default_factory=list)
    gap: bool = False  # a blank line is due before the next text
    number: int = 0
    span: tuple[int, int] = (1, 1)
    rows: list[list[tuple[str, int, int]]] = field(default_factory=list)

    def end_line(self) -> None:
        if not self.line:
            return
        text = "".join(self.line)
        self.line = []
        if not self.keep_space:
            text = _SPACE.sub(" ", text).strip(" ")
        if text.strip():
            self.add(deque(text.split("\n") if self.keep_space else [text]))

    def add(self, lines: deque, apart: bool = False) -> None:
        if not any(x.strip() for x in lines):
            return
        if (self.gap or apart) and self.lines:
            self.lines.append("")
        self.gap = apart
        if len(lines) > len(self.lines):  # the shorter side moves
            lines.extendleft(reversed(self.lines))
            self.lines = lines
        else:
            self.lines.extend(lines)


@dataclass
class Element:
    """An open element: its box, if it is a block, and whether its text is seen."""

    name: str
    box: Box | None
    seen: bool  # not taken out by itself or what it lies in
    shown: bool  # visibility, which what it holds may set anew
    outside: bool = True  # of a drawing: whether its texts are seen


class Page:
    def __init__(self, source: str):
        self.title = ""
        # Names of tags, classes and ids that the page's own rules take out or hide.
        self.gone: set[str] = set()
        self.unshown: dict[str, bool] = {}
        self.boxes = [Box("#page")]
        self.open: list[Element | None] = []  # None once an end tag has taken it out of the middle
        self.places: dict[str, list[int]] = {}  # of every name, where it is open
        self.blocks: list[int] = []  # places of the elements with a box
        self.tables: list[Box] = []
        self.drawings = 0
        self.read(source)

    # --- reading -----------------------------------------------------------

    def read(self, source: str) -> None:
        stream, told = tokens(source), None
        while True:
            try:
                slash, name, rest, at = stream.send(told)
            except StopIteration:
                break
            told = None
            if slash is None:
                self.text(name)
            elif slash:
                self.close(name)
            else:
                attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest else {}
                self.start(name, attributes, rest.endswith("/"))
                if name in RAW and not self.drawings:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    told = end.start() if end else len(source)
                    self.raw(name, source[at:told])
        while self.open:
            self.pop()
        self.boxes[0].end_line()

    def raw(self, name: str, inside: str) -> None:
        if name == "title" and not self.title:
            self.title = _SPACE.sub(" ", html.unescape(inside)).strip()
        elif name == "style":
            for selectors, body in screen_rules(inside):
                names = [s.strip().lower() for s in selectors.split(",")]
                names = [s for s in names if re.fullmatch(r"[.#]?[\w-]+", s)]
                if _GONE.search(body):
                    self.gone.update(names)
                if found := _VISIBILITY.search(body):
                    self.unshown.update(dict.fromkeys(names, found[1].lower() == "visible"))
        elif name in ("textarea", "xmp") and self.visible:
            self.boxes[-1].line.append(html.unescape(inside) if name == "textarea" else inside)

    # --- the tree ------------------------------------------------------------

    @property
    def inner(self) -> Element | None:
        return self.open[-1] if self.open else None

    @property
    def visible(self) -> bool:
        return self.inner is None or self.inner.seen and self.inner.shown

    def last(self, names: set[str]) -> int:
        """The innermost place at which one of `names` is open, -1 for none."""
        found, places = -1, self.places
        for name in names:
            at = places.get(name)
            if at and at[-1] > found:
                found = at[-1]
        return found

    def start(self, name: str, attributes: dict[str, str], ends: bool) -> None:
        if self.inner and self.inner.name == "head" and name not in HEAD:
            self.pop()
        if name in BLOCKS and name not in ("td", "th", "tr", "option", "optgroup", "html", "body"):
            if self.places.get("p") and (at := self.places["p"][-1]) > self.last(SCOPES):
                self.pop_to(at)
        if name in CLOSES:
            gone, bounds = CLOSES[name]
            bound = self.last(bounds)
            outermost = min((self.first_after(n, bound) for n in gone), default=len(self.open))
            if outermost < len(self.open):
                self.pop_to(outermost)
        if name in VOID:
            self.void(name, attributes)
            return
        if ends and (name in FOREIGN or self.drawings):
            return
        self.push(name, attributes)

    def first_after(self, name: str, bound: int) -> int:
        """The outermost place beyond `bound` at which `name` is open."""
        places = self.places.get(name)
        if not places or places[-1] <= bound:
            return len(self.open)
        k = len(places)
        while k and places[k - 1] > bound:  # all of these are closed next
            k -= 1
        return places[k]

    def push(self, name: str, attributes: dict[str, str]) -> None:
        outer = self.inner
        seen, shown = (outer.seen, outer.shown) if outer else (True, True)
        outside = outer.outside if outer else True
        drawn = self.drawings and name in DRAWN
        if drawn:
            seen = outside
        takes_out = name in UNSEEN
        if attributes or self.gone or self.unshown:
            hides, shown = self.styled(name, attributes, shown)
            takes_out = takes_out or hides
        seen = seen and not takes_out
        if name == "svg":
            outside, seen = seen, False
        elif self.drawings and (name in DEFINED or takes_out):
            outside = False
        box = None
        if name in BLOCKS or drawn:
            self.boxes[-1].end_line()
            keep = name in ("pre", "textarea", "xmp") or self.boxes[-1].keep_space
            box = Box(name, hidden=not seen, keep_space=keep, span=_spans(attributes) if attributes else (1, 1))
            if name == "ol" and attributes.get("start", "").isdecimal():
                box.number = int(attributes["start"]) - 1
            self.boxes.append(box)
            self.blocks.append(len(self.open))
            if name == "table":
                self.tables.append(box)
        self.drawings += name == "svg"
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(Element(name, box, seen, shown, outside))

    def styled(self, name: str, attributes: dict[str, str], shown: bool) -> tuple[bool, bool]:
        """Whether attributes or rules take the element out, and whether it shows."""
        own = {name}
        if "id" in attributes:
            own.add("#" + attributes["id"].lower())
        if "class" in attributes:
            own.update("." + c for c in attributes["class"].lower().split())
        if self.unshown:
            for selector in own & self.unshown.keys():
                shown = self.unshown[selector]
        style = attributes.get("style")
        if style and (found := _VISIBILITY.search(style)):
            shown = found[1].lower() == "visible"
        hides = (
            "hidden" in attributes
            or attributes.get("aria-hidden", "").lower() == "true"
            or bool(style and _GONE.search(style))
            or not own.isdisjoint(self.gone)
        )
        return hides, shown

    def void(self, name: str, attributes: dict[str, str]) -> None:
        box = self.boxes[-1]
        if not self.visible:
            return
        if name == "br":
            if box.keep_space:
                box.line.append("\n")
            else:
                box.end_line()
        elif name == "hr":
            box.end_line()
            box.gap = True
        elif name == "input" and attributes.get("type", "").lower() in ("submit", "button", "reset"):
            box.line.append(attributes.get("value", ""))

    def text(self, data: str) -> None:
        if self.inner and self.inner.name == "head" and data.strip():
            self.pop()
        if self.visible:
            self.boxes[-1].line.append(html.unescape(data) if "&" in data else data)

    def close(self, name: str) -> None:
        places = self.places.get(name)
        if not places:
            return  # a closing tag without an opening one
        at = places[-1]
        if name not in TABLE and at < self.last(CELLS):
            return  # what lies around a cell isn't ended from within
        if name not in BLOCKS and name not in FOREIGN and self.blocks and self.blocks[-1] > at:
            # Blocks opened since stay open. An element of formatting ends all the
            # same; another end tag doesn't end what lies around the block.
            if name in FORMATTING:
                self.places[name].pop()
                self.open[at] = None
            return
        self.pop_to(at)

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()

    def pop(self) -> None:
        element = self.open.pop()
        while self.open and self.open[-1] is None:
            self.open.pop()
        if element is None:
            return
        self.places[element.name].pop()
        self.drawings -= element.name == "svg"
        box = element.box
        if box is not None:
            self.boxes.pop()
            self.blocks.pop()
            box.end_line()
            if box.name == "table":
                self.tables.pop()
            if not box.hidden or box.lines or box.rows:
                self.lay_out(box, self.boxes[-1])

    # --- layout ----------------------------------------------------------------

    def lay_out(self, box: Box, outer: Box) -> None:
        name = box.name
        if name == "li":
            outer.number += 1
            mark = f"{outer.number}. " if outer.name == "ol" else "- "
            indent = " " * len(mark)
            outer.add(deque((mark if i == 0 else indent) + x if x else x for i, x in enumerate(box.lines)))
        elif name in ("td", "th"):
            cell = " ".join(x.strip() for x in box.lines if x.strip())
            if outer.name == "tr":
                outer.rows.append([(cell, *box.span)])
            else:
                outer.add(deque([cell]))
        elif name == "tr":
            cells = [c for row in box.rows for c in row]
            outer.add(box.lines)
            if not self.tables:
                outer.add(deque([" | ".join(c[0] for c in cells)]))
            elif any(c[0] for c in cells):
                self.tables[-1].rows.append(cells)
        elif name == "table":
            box.gap = False
            box.add(deque(aligned(box.rows)))
            outer.add(box.lines, apart=True)
        elif name == "dd":
            outer.add(deque("  " + x if x else x for x in box.lines))
        elif name == "blockquote":
            outer.add(deque("> " + x if x else ">" for x in box.lines), apart=True)
        elif name in ("ul", "ol") and outer.name == "li":
            outer.add(box.lines)
        else:
            outer.add(box.lines, apart=name in PARAGRAPHS)


def _spans(attributes: dict[str, str]) -> tuple[int, int]:
    """How many columns and rows a cell covers."""
    texts = (attributes.get(name, "").strip() for name in ("colspan", "rowspan"))
    return tuple(min(max(int(t[:9]), 1), _MOST_SPAN) if t.isdecimal() else 1 for t in texts)


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells `(text, columns, rows)` below each other, each in its true column.

    A column is as wide as its widest cell, WIDEST at most; longer cells are
    wrapped within it. A cell over several columns takes their room together."""
    placed, below = [], {}  # below: columns that a cell from above still covers, with rows left
    for row in rows:
        at, line, covered = 0, [], {c: n - 1 for c, n in below.items() if n > 1}
        for text, columns, deep in row:
            while at in below:
                at += 1
            line.append((at, text, columns))
            if deep > 1:
                covered.update(dict.fromkeys(range(at, at + columns), deep - 1))
            at += columns
        placed.append(line)
        below = covered
    widths = [0] * max((at + columns for line in placed for at, _, columns in line[-1:]), default=0)
    for line in placed:
        for at, text, columns in line:
            if columns == 1:
                widths[at] = max(widths[at], min(len(text), WIDEST))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 3)
    wider: dict[int, int] = {}
    for line in placed:
        for at, text, columns in line:
            room = starts[at + columns] - starts[at] - 3
            if columns > 1 and min(len(text), WIDEST) > room:
                last = at + columns - 1
                wider[last] = max(wider.get(last, 0), min(len(text), WIDEST) - room)
    starts = [0]
    for i, w in enumerate(widths):
        starts.append(starts[-1] + w + wider.get(i, 0) + 3)
    return [text for line in placed for text in _spelled(line, starts)]


def _spelled(line: list[tuple[int, str, int]], starts: list[int]) -> list[str]:
    cells = [(at, columns, _wrapped(text, starts[at + columns] - starts[at] - 3)) for at, text, columns in line]
    out = []
    for k in range(max((len(parts) for _, _, parts in cells), default=0)):
        pieces, at = [], 0
        for column, columns, parts in cells:
            if column > at:  # covered from above
                pieces.append(" " * (starts[column] - starts[at] - 3))
            pieces.append((parts[k] if k < len(parts) else "").ljust(starts[column + columns] - starts[column] - 3))
            at = column + columns
        out.append(" | ".join(pieces).rstrip())
    return out


def _wrapped(text: str, width: int) -> list[str]:
    """The text in lines of at most `width` characters, cut at spaces where there are any."""
    out = []
    at = 0
    while len(text) - at > width > 0:
        cut = text.rfind(" ", at, at + width + 1)
        cut = cut if cut > at else at + width
        out.append(text[at:cut])
        at = cut + (text[cut] == " ")
    return [*out, text[at:]]


def render(source: str) -> tuple[str, str]:
    """Title and visible text of one page."""
    page = Page(source)
    return page.title, "\n".join(page.boxes[0].lines)


def _rendered(batches):
    for batch in batches:
        done = [render(s or "") for s in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array([d[k] for d in done], pa.string()) for k in (0, 1))],
            names=[*batch.schema.names[:-1], "title", "text"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """`page_id, title, text, n_chars, n_lines`, one row per row of `pages`.

    All visible text: blocks on lines of their own, paragraphs, lists, tables
    and the like set apart by one blank line, list items marked and indented,
    table cells aligned in columns, spans over several columns and rows kept.
    Choices, text fields, formulas, labels of buttons and texts of drawings are
    visible. Unseen are the elements that render no text, and whatever is hidden
    by attribute, by inline style or by a rule of the page for a wide screen that
    names one tag, class or id. Null or empty pages give an empty text, markup
    that is cut off is read as far as it goes, repeated rows give equal texts, an
    empty table gives none. Other columns of `pages` play no part.
    """
    small_batches(pages.sparkSession)
    kind = pages.select(q(id_col)).schema[0].dataType.simpleString()
    found = pages.select(q(id_col).alias("page_id"), text_of(html_col).alias("html")).mapInArrow(
        _rendered, f"page_id {kind}, title string, text string"
    )
    text = F.col("text")
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    return found.select("page_id", "title", "text", F.length(text).cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
