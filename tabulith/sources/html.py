"""Converted papers (HTML) to text fragments and table cells.

One pass over the pages, one worker hop: everything that needs a document tree happens
here and leaves as rows; what follows are expressions on rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.operators.tasks import spread

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_NONE: list[str] = []
_STOPS = frozenset("table tr tbody thead tfoot ul ol dl section article div figure body".split())


class Node:
    """An element: its name, attributes, and children (elements or strings)."""

    __slots__ = ("name", "attrs", "children", "parent", "classes")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []
        self.classes: list[str] = attrs["class"].split() if "class" in attrs else _NONE

    def all(self) -> list[Node]:
        """All elements below, in document order, as they are now."""
        out: list[Node] = []
        stack = [c for c in reversed(self.children) if c.__class__ is Node]
        while stack:
            node = stack.pop()
            out.append(node)
            if node.children:
                stack += [c for c in reversed(node.children) if c.__class__ is Node]
        return out

    def having(self, *classes: str) -> list[Node]:
        if len(classes) == 1:
            (one,) = classes
            return [n for n in self.all() if one in n.classes]
        return [n for n in self.all() if any(c in n.classes for c in classes)]

    def named(self, *names: str) -> list[Node]:
        return [n for n in self.all() if n.name in names]

    def above(self, test) -> Node | None:
        node = self.parent
        while node is not None and not test(node):
            node = node.parent
        return node

    def text(self) -> str:
        if len(self.children) == 1 and self.children[0].__class__ is str:
            return self.children[0]
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def wrap(self, begin: str, end: str = "") -> None:
        self.children = [begin, *self.children, end]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.add(tag, {k: v or "" for k, v in attrs})

    def add(self, tag: str, attrs: dict[str, str]) -> None:
        node = self.at
        while node.parent is not None and tag in _CLOSES:
            if node.name in _CLOSES[tag]:
                self.at = node.parent
                if tag != "tr":
                    break
            if node.name in _STOPS and node.name != "tr":
                break
            node = node.parent
        new = Node(tag, attrs, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.name == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


#: A tag that no parser could read otherwise: a plain name, attributes without references or stray signs.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-\w]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[-\w.#%:;,+]+))?)*)[ \t\n\r\f]*>""", re.ASCII)
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]([a-zA-Z][-\w]*)(?:=(?:"([^"]*)"|'([^']*)'|([-\w.#%:;,+]+)))?""", re.ASCII)
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: Attributes as they stand in pages come again and again: those that a worker has read.
_READ: dict[str, dict[str, str]] = {}
_KEPT = 10_000


def _attributes(text: str) -> dict[str, str]:
    found = _READ.get(text)
    if found is None:
        found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(text)}
        if len(_READ) >= _KEPT:
            _READ.clear()
        _READ[text] = found
    return found.copy()


def _plain(html: str, tree: _Tree) -> bool:
    """Builds the tree of a page of plain tags and text alone, in one pass; False, and nothing built, if anything else is in it."""
    parts = _TAG.split(html)
    for text in parts[::4]:
        if "<" in text:
            return False
    for end, name, attributes in zip(parts[1::4], parts[2::4], parts[3::4]):
        if (end and attributes) or name.lower() in _RAW:
            return False
    if parts[0]:
        tree.handle_data(unescape(parts[0]))
    for k in range(1, len(parts), 4):
        end, name, attributes, text = parts[k : k + 4]
        if end:
            tree.handle_endtag(name.lower())
        else:
            tree.add(name.lower(), _attributes(attributes) if attributes else {})
        if text:
            tree.handle_data(unescape(text) if "&" in text else text)
    return True


def parse(html: str) -> Node:
    tree = _Tree()
    html = html or ""
    if not _plain(html, tree):
        tree.feed(html)
        tree.close()
    return tree.root


_LINK = "#[0-9A-Za-z]+"


def simple(identifier: str) -> str:
    return identifier.replace(".", "")


def flat(*nodes: Node | str) -> str:
    """TX4."""
    out = re.sub(r"[ \n\xa0]+", " ", " ".join(n if isinstance(n, str) else n.text() for n in nodes))
    out = re.sub(f"[(),;]* ({_LINK}) [(),;]*", r" \1 ", out)
    return re.sub(rf" ({_LINK}) *\1 ", r" \1 ", out).strip()


def mark_anchors(root: Node) -> None:
    """TX1, TX2: identifiers of figures, sections, tables and notes, and links to them, as words of the text."""
    for node in root.all():
        own, identifier = set(node.classes), node.attrs.get("id", "")
        if own & {"ltx_bibitem", "ltx_figure", "ltx_float", "ltx_picture", "ltx_theorem"} and identifier:
            node.children.insert(0, f" xxanchor-{simple(identifier)} ")
        if node.name in ("h2", "h3", "h4", "h5", "h6"):
            section = node.above(lambda n: n.name == "section")
            if section is not None and section.attrs.get("id"):
                node.children.insert(0, f" xxanchor-{simple(section.attrs['id'])} ")
        if "ltx_table" in own:
            node.children.insert(0, f" xxtable-xxanchor-{simple(node.attrs.get('id', 'xxunk'))} ")
    for node in root.having("ltx_tabular"):
        node.remove()
    for node in root.named("a"):
        if node.attrs.get("href", "").startswith("#"):
            node.children = ["xxref-" + simple(node.attrs["href"][1:])]
    for node in root.having("ltx_note_mark"):
        if "ltx_note_content" in node.parent.classes:
            node.remove()
        elif "ltx_role_footnote" in node.parent.classes and node.parent.attrs.get("id"):
            node.children = [f" xxref-{simple(node.parent.attrs['id'])} "]
    for node in root.having("ltx_tag_note"):
        note = node.above(lambda n: "ltx_role_footnote" in n.classes)
        if "ltx_note_content" in node.parent.classes and note is not None:
            node.children = [f" xxanchor-{simple(note.attrs.get('id', ''))} "]


def _flattened(node: Node) -> Iterator[Node | str]:
    """TX6: sections and bibliographies are replaced by what is in them."""
    for child in node.children:
        if isinstance(child, Node) and (child.name == "section" or "ltx_biblist" in child.classes):
            yield from _flattened(child)
        else:
            yield child


def grouped(article: Node) -> Iterator[tuple[int, int, str, str]]:
    """TX7: (section, subsection, header, text); a paragraph, figure or reference ends a subsection,
    a header begins a section, what comes before the first one belongs to it, and a section
    without text has one empty row so that its header isn't lost."""
    section, sub, header, words = -1, 0, "", []
    begun = shown = False
    for item in _flattened(article):
        name = item.name if isinstance(item, Node) else ""
        classes = item.classes if isinstance(item, Node) else []
        if name in ("h2", "h3"):
            if begun and (not shown or words):
                yield max(section, 0), sub, header, " ".join(words)
                words = []
            begun, shown = True, False
            section, sub, header = section + 1, 0, flat(item)
            continue
        if name == "h1":
            continue
        found = flat(item)
        if found:
            words.append(found)
        ends = "ltx_para" in classes or name == "figure" or "ltx_bibitem" in classes
        if ends and found and begun:
            yield max(section, 0), sub, header, " ".join(words)
            words, shown, sub = [], True, sub + 1
    if not shown or words:
        yield max(section, 0), sub, header, " ".join(words)


def paper_rows(html: str) -> tuple[str | None, str, str, list[tuple[int, str, str]]]:
    """TX13: title (null if none), authors, abstract, fragments (order, header, text)."""
    root = parse(html)
    mark_anchors(root)
    titles, abstracts = root.named("title"), [n for n in root.having("ltx_abstract") if n.name == "div"]
    authors = [n for n in root.having("ltx_authors") if n.name == "div"]
    strip = lambda x: re.sub(r"^\s*[aA]bstract ?", "", x)
    title = flat(titles[0]) if titles else None
    who, abstract = flat(*authors), strip(flat(*abstracts))
    for node in abstracts + authors:
        node.remove()
    rows: list[tuple[int, str, str]] = []
    articles = root.named("article")
    if articles:
        notes = [n for n in articles[0].having("ltx_note_outer") if "ltx_role_footnote" in n.parent.classes]
        for note in notes:
            note.remove()
        section = 0
        for section, sub, header, content in grouped(articles[0]):
            if not abstract and "abstract" in header.lower():
                abstract = strip(content.strip())
            else:
                rows.append(((section + 1) * 1000 + sub, header, content.strip()))
        rows += [((section + 2) * 1000 + k, "xxanchor-footnotes Footnotes", flat(n)) for k, n in enumerate(notes)]
    return title, who, abstract, rows


def fragments(pages: DataFrame, key: str = "paper_id", html: str = "html") -> DataFrame:
    """Fragments (key, title, authors, abstract, order, header, text) of every page.

    A page without an article has one row with null order, header and text, so that its
    title is kept; null pages count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, page in enumerate(batch.column(html).to_pylist()):
                title, who, abstract, found = paper_rows(page or "")
                for row in found or [(None, None, None)]:
                    at.append(i)
                    rows.append((title, who, abstract, *row))
            columns = [batch.column(key).take(pa.array(at, pa.int64()))]
            for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())):
                columns.append(pa.array([r[k] for r in rows], kind))
            yield pa.RecordBatch.from_arrays(columns, [key, "title", "authors", "abstract", "order", "header", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, title string, authors string, abstract string, `order` int, header string, text string")


_SPACES = re.compile(r"[\n\r]+|\s\s+")
_HEX = re.compile("#[0-9a-f]{3,6}")
_HEAVY = frozenset(("bold", "700", "800", "900"))
_SPAN_TABLES = {"ltx_tabular": "table", "ltx_tr": "tr", "ltx_th": "th", "ltx_tbody": "tbody", "ltx_thead": "thead", "ltx_td": "td", "ltx_tfoot": "tfoot"}


def declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute."""
    return {name.strip().lower(): value.strip() for name, _, value in (part.partition(":") for part in style.split(";"))}


def colour_of(style: str) -> str | None:
    """TB8: red, green or blue if that channel is more than twice each other one."""
    value = declared(style).get("color", "").lower()
    if value in ("red", "green", "blue"):
        return value
    if not _HEX.fullmatch(value):
        return None
    digits = value[1:]
    digits = digits if len(digits) == 6 else (digits * 2)[:6]
    channels = dict(zip(("red", "green", "blue"), (int(digits[k : k + 2], 16) for k in (0, 2, 4))))
    for name, value in channels.items():
        if all(value > 2 * other for n, other in channels.items() if n != name):
            return name
    return None


def _prepare(root: Node) -> None:
    """TB2 to TB5."""
    nodes = root.all()
    for caption in nodes:
        if "ltx_caption" in caption.classes:
            figure = caption.parent
            if figure.name == "figure" and "id" in figure.attrs:
                for table in figure.having("ltx_tabular"):
                    table.attrs["data-figure-id"] = figure.attrs["id"]
    for node in nodes:
        if node.name == "span" and node.classes:
            node.name = next((v for k, v in _SPAN_TABLES.items() if k in node.classes), node.name)
        if node.name == "th":
            node.name = "td"
    for node in nodes:
        if "ltx_ERROR" in node.classes and node.name == "span":
            node.remove()
    for inner in nodes:
        if "ltx_tabular" in inner.classes and inner.above(lambda n: "ltx_tabular" in n.classes) is not None:
            for node in [inner, *inner.named("col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")]:
                node.name = "div"


def _mark_cells(table: Node) -> None:
    """TB7, TB8: references and styles of a table's text as tags in it."""
    nodes = table.all()
    if notes := [n for n in nodes if "ltx_role_footnote" in n.classes]:
        for node in notes:
            node.remove()
        nodes = table.all()
    for node in nodes:
        if node.name == "a" and node.attrs.get("href", "").startswith("#"):
            node.wrap(f"<ref id='{node.attrs['href'][1:].replace('.', '-')}'>", "</ref>")
    styles = [declared(n.attrs["style"]) if "style" in n.attrs else {} for n in nodes]
    for tag, own, styled, ending in (
        ("bold", "ltx_font_bold", lambda s: s.get("font-weight") in _HEAVY, ("-B", "-BI")),
        ("italic", "ltx_font_italic", lambda s: s.get("font-style") == "italic", ("-I", "-BI")),
    ):
        for node, style in zip(nodes, styles):
            if not style and not node.classes:
                continue
            if own in node.classes or styled(style) or any(c.startswith("MJXc-TeX-") and c.endswith(ending) for c in node.classes):
                node.wrap(f"<{tag}>", f"</{tag}>")
    for node in nodes:
        if "color" in node.attrs.get("style", "") and (colour := colour_of(node.attrs["style"])):
            node.wrap(f"<{colour}>", f"</{colour}>")


def _number(text: str, default: int = 1) -> int:
    return int(text) if text.isdigit() and int(text) > 0 else default


def grid(table: Node) -> list[list[tuple[Node, int, int]]]:
    """TB11: rows of (cell, colspan, rowspan), every cell in all places that it spans."""
    own_rows = [r for r in table.named("tr") if r.above(lambda n: n.name == "table") is table]
    # head first, foot last, whatever their order in the page
    place = {"thead": 0, "tfoot": 2}
    own_rows.sort(key=lambda r: place.get(r.parent.name, 1))
    out: list[list[tuple[Node, int, int]]] = []
    pending: dict[int, tuple[Node, int, int, int]] = {}
    for row in own_rows:
        line: list[tuple[Node, int, int]] = []

        def spanned() -> None:
            while len(line) in pending:
                node, cs, rs, left = pending.pop(len(line))
                if left > 1:
                    later[len(line)] = (node, cs, rs, left - 1)
                line.append((node, cs, rs))

        later: dict[int, tuple[Node, int, int, int]] = {}
        for cell in (c for c in row.children if isinstance(c, Node) and c.name == "td"):
            spanned()
            cs, rs = _number(cell.attrs.get("colspan", "1")), _number(cell.attrs.get("rowspan", "1"))
            for _ in range(min(cs, 1000)):
                if rs > 1:
                    later[len(line)] = (cell, cs, rs, rs - 1)
                line.append((cell, cs, rs))
        spanned()
        for column in sorted(pending):
            while len(line) < column:
                line.append((Node("td", {}, None), 1, 1))
            spanned()
        pending = later
        out.append(line)
    return out


TABLE_CELLS = (
    "table_index int, caption string, figure_id string, row int, col int, raw_value string,"
    " borders array<string>, align array<string>, header boolean, colspan int, rowspan int"
)


def table_rows(html: str) -> Iterator[tuple]:
    """TB1: the cells of every table that is one, as TABLE_CELLS; tables count from 0, in page order."""
    root = parse(html)
    _prepare(root)
    index = 0
    for table in [t for t in root.named("table") if "ltx_tabular" in t.classes]:
        if table.above(lambda n: "ltx_authors" in n.classes) is not None:
            continue
        figure = table.above(lambda n: n.name == "figure")
        if figure is not None and "ltx_table" not in figure.classes:
            graphics = "ltx_figure" in figure.classes and any("ltx_graphics" in n.classes for n in table.named("img"))
            if graphics or "ltx_float" in figure.classes:
                continue
        _mark_cells(table)
        captions = figure.named("figcaption") if figure is not None else []
        caption = _SPACES.sub(" ", captions[0].text().strip()) if captions else None
        lines = grid(table)
        if not lines:
            continue
        width = max(map(len, lines))
        for r, line in enumerate(lines):
            for c, (cell, cs, rs) in enumerate(line + [(Node("td", {}, None), 1, 1)] * (width - len(line))):
                value = _SPACES.sub(" ", cell.text().strip())
                borders = [x[11:] for x in cell.classes if x.startswith("ltx_border_")]
                align = [x[10:] for x in cell.classes if x.startswith("ltx_align_")]
                yield index, caption, table.attrs.get("data-figure-id"), r, c, value, borders, align, "ltx_th" in cell.classes, cs, rs
        index += 1


def cells(pages: DataFrame, key: str = "paper_id", html: str = "html") -> DataFrame:
    """The raw cells of all tables of all pages: key and TABLE_CELLS."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(TABLE_CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, page in enumerate(batch.column(html).to_pylist()):
                for row in table_rows(page or ""):
                    at.append(i)
                    rows.append(row)
            columns = [batch.column(key).take(pa.array(at, pa.int64()))]
            columns += [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(columns, [key, *arrow.names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {TABLE_CELLS}")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The number of links of every page, by an expression."""
    return pages.select(key, F.regexp_count(html, F.lit("<a ")).cast("long").alias("links"))


def corpus_texts(papers: DataFrame, parts: DataFrame) -> DataFrame:
    """TX19: (paper_id, text) for a language model: title, abstract and body, a section's header where it begins; no anchors, one word for all references.

    ``papers`` are (paper_id, title, abstract), ``parts`` (paper_id, order, header, text). A
    paper's parts meet in one row, as its text does.
    """
    new = F.lag("header").over(W.partitionBy("paper_id").orderBy("order")).eqNullSafe(F.col("header"))
    said = F.when(new, F.coalesce("text", F.lit(""))).otherwise(F.concat("header", F.lit("\n\n"), F.coalesce("text", F.lit(""))))
    body = parts.select("paper_id", F.struct("order", said.alias("said")).alias("part")).groupBy("paper_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = F.concat(F.lit("Title\n"), F.coalesce("title", F.lit("")), F.lit("\n\nAbstract\n"), F.coalesce("abstract", F.lit("")), F.lit("\n\nBody\n"), F.array_join(F.transform("parts", lambda p: p["said"]), "\n"))
    plain = F.regexp_replace(F.regexp_replace(whole, "xxanchor-[^ ]*", ""), "xxref-[^ ]*", "xxref")
    return papers.join(body, "paper_id").select("paper_id", plain.alias("text"))


def corpus_sentences(texts: DataFrame, most: int | None = None, seed: int = 12345) -> DataFrame:
    """TX19: (paper_id, sentence): the lines of such texts that aren't blank; ``most`` of them drawn without replacement, if asked."""
    lines = texts.select("paper_id", F.posexplode(F.split("text", "\n")).alias("at", "sentence")).where(F.trim("sentence") != "")
    if most is not None:
        lines = lines.orderBy(F.xxhash64(F.lit(seed), "paper_id", "at"), "paper_id", "at").limit(most)
    return lines.select("paper_id", "sentence")


def element_name(tag: Column) -> Column:
    """TX11: the name of the element that an opening tag begins, in lower case."""
    return F.lower(F.regexp_extract(tag, "^<\\s*([A-Za-z][^\\s/>]*)", 1))


def element_classes(tag: Column) -> Column:
    """TX11: the class names of an opening tag; none without the attribute."""
    value = F.regexp_extract(tag, "(?i)\\sclass\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))", 0)
    inner = F.regexp_replace(F.regexp_replace(value, "(?i)^\\sclass\\s*=\\s*", ""), "[\"']", "")
    return F.array_remove(F.split(inner, "\\s+"), "")


def table_of_contents(parts: DataFrame) -> DataFrame:
    """TX14: (paper_id, order, header): a header at each change."""
    parts = spread(parts, "paper_id")
    before = F.lag("header").over(W.partitionBy("paper_id").orderBy("order"))
    return parts.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("header"))).select("paper_id", "order", "header")


def sections_with(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """The columns of ``refs`` but ref, and frag_id, for every fragment (frag_id, text) that holds a ref as one of its words: an equi-join."""
    words = parts.select("frag_id", F.explode(F.array_distinct(F.split("text", "\\s+"))).alias("ref"))
    return words.join(refs, "ref").drop("ref")

