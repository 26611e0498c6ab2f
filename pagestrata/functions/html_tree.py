"""An html tree built on the standard tokenizer; cleaning, block extraction and title from one tree per page.

Rules of the tree: a start tag opens an element; void tags close at once; an end tag closes back to the
nearest open element of its name and is ignored where none is open; nothing closes by implication;
what is left open closes at the end. Comments are no text; script, style and template hold no text of
their ancestors; of repeated attributes the last counts.
"""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.schemas import PAGE

VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
DROPPED = frozenset("script style meta link noscript".split())
SILENT = frozenset("script style template".split())
# The elements that become blocks, and their kinds.
KINDS = {"p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_header", "blockquote": "quote", "div": "division", "span": "span", **{f"h{i}": "heading" for i in range(1, 7)}}


class Node:
    """An element: name, attributes, children (nodes, strings, or (kind, text) for markup that is no text)."""

    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.items = tag, attrs or {}, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        items = self.open[-1].items
        if items and isinstance(items[-1], str):
            items[-1] += data
        else:
            items.append(data)

    def handle_comment(self, data):
        self.open[-1].items.append(("comment", data))

    def handle_decl(self, decl):
        self.open[-1].items.append(("decl", decl))

    def unknown_decl(self, data):
        self.open[-1].items.append(("cdata", data))

    def handle_pi(self, data):
        self.open[-1].items.append(("pi", data))


def parse(html: str) -> Node:
    """The tree of a page."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _archived(node: Node) -> bool:
    return "wm-" in node.attrs.get("id", "") or "archive" in node.attrs.get("class", "").lower()


def prune(root: Node) -> None:
    """Remove scripts, styles, meta data and the toolbar of an archive, in place."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.items = [x for x in node.items if not (isinstance(x, Node) and (x.tag in DROPPED or _archived(x)))]
        todo += [x for x in node.items if isinstance(x, Node)]


def find(root: Node, tag: str) -> Node | None:
    """The first element of a name in document order."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            return node
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return None


def serialise(root: Node) -> str:
    """The markup of a tree."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if not x.tag:
                todo += reversed(x.items)
                continue
            attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
            if x.tag in VOID:
                out.append(f"<{x.tag}{attrs}/>")
            else:
                out.append(f"<{x.tag}{attrs}>")
                todo.append(("end", x.tag))
                todo += reversed(x.items)
        elif isinstance(x, str):
            out.append(escape(x, quote=False))
        else:
            kind, text = x
            out.append({"end": f"</{text}>", "comment": f"<!--{text}-->", "decl": f"<!{text}>", "cdata": f"<![{text}]>", "pi": f"<?{text}>"}[kind])
    return "".join(out)


def text_of(root: Node) -> str:
    """Text nodes, each stripped, joined by blanks, runs of blanks as one."""
    parts: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                parts.append(x.strip())
        elif isinstance(x, Node) and (x is root or x.tag not in SILENT):
            todo += reversed(x.items)
    return " ".join(" ".join(parts).split())


def blocks_of(root: Node) -> list[tuple[int, str, int | None, str]]:
    """(position, kind, level, text) of every block element in document order; texts under two characters take no position.

    One walk: stripped text nodes go to one list, and a block's text is the stretch of that list between its start and
    end. What stands in a silent element is in a list of its own, as it is no text of the elements around.
    """
    found: list[list] = []  # [node, parts, start, end] in document order
    parts: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            x = x.strip()
            if x:
                parts.append(x)
        elif isinstance(x, Node):
            if x.tag in KINDS:
                entry = [x.tag, parts, len(parts), 0]
                found.append(entry)
                todo.append(entry)
            elif x.tag in SILENT and x is not root:
                todo.append((parts,))
                parts = []
            todo += reversed(x.items)
        elif isinstance(x, list):
            x[3] = len(parts)
        elif len(x) == 1:  # back to the list around a silent element
            parts = x[0]
    out = []
    for tag, held, start, end in found:
        text = " ".join(" ".join(held[start:end]).split())
        if len(text) >= 2:
            out.append((len(out) + 1, KINDS[tag], int(tag[1]) if KINDS[tag] == "heading" else None, text))
    return out


def title_of(root: Node) -> str:
    """The text of a title element that holds a single string, else a placeholder."""
    node = find(root, "title")
    if node and len(node.items) == 1 and isinstance(node.items[0], str) and node.items[0].strip():
        return node.items[0].strip()
    return "Unknown Title"


def clean_page(html: str) -> tuple[str, str, list]:
    """(cleaned html, title, blocks) of a page from one tree."""
    root = parse(html)
    title = title_of(root)
    prune(root)
    body = find(root, "body")
    kept = body if body is not None else root
    return _one_blank(serialise(kept)), title, blocks_of(kept)


def _one_blank(text: str) -> str:
    """Runs of blanks as one space, also at the ends."""
    out = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + out + (" " if out and text[-1:].isspace() else "")


@F.arrow_udf(PAGE)
def page_udf(html: pa.Array) -> pa.Array:
    """Length of the cleaned html, title and blocks of each page; null html has no blocks."""
    lengths, titles, offsets, found = [], [], [0], []
    for page in html.to_pylist():
        cleaned, title, blocks = (None, None, []) if page is None else clean_page(page)
        lengths.append(len(cleaned) if cleaned is not None else None)
        titles.append(title)
        found += blocks
        offsets.append(len(found))
    position, kind, level, text = zip(*found) if found else ((), (), (), ())
    blocks = pa.StructArray.from_arrays([pa.array(position, pa.int32()), pa.array(kind, pa.string()), pa.array(level, pa.int32()), pa.array(text, pa.string())], ["position", "element_type", "hierarchy_level", "text"])
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(titles, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), blocks)], ["cleaned_length", "title", "blocks"])


@F.arrow_udf(T.StringType())
def clean_udf(html: pa.Array) -> pa.Array:
    """The cleaned html of each page."""
    return pa.array([None if p is None else clean_page(p)[0] for p in html.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def title_udf(html: pa.Array) -> pa.Array:
    """The title of each page by its tree, with a placeholder where there is none."""
    return pa.array([None if p is None else title_of(parse(p)) for p in html.to_pylist()], pa.string())


# One evaluation per page: the optimizer may not repeat them in filters it infers from an explode.
page_udf = page_udf.asNondeterministic()


def title_by_pattern(html: Column) -> Column:
    """The title by a pattern alone: cheap, entities as they are written."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
