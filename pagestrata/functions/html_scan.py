"""A single regular-expression pass over raw html: text blocks with what a flat classifier needs.

Blocks are the elements h1-h6, p, li and blockquote in the order of their start tags, empty ones
included; comments, script, style and noscript are left out whole. Tags may be unclosed or in any
case. The scan never fails: what is no tag is text.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote".split())
_CLOSED_BY_BLOCK = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# What an element says of its content by name: 1 holds the main content, 2 holds something beside it.
_REGIONS = {"article": 1, "main": 1, "nav": 2, "aside": 2, "footer": 2, "header": 2, "menu": 2, "dialog": 2}
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Every alternative consumes what it has looked at (possessive runs; an unclosed quote is an ordinary character, a tag
# or comment cut off by the end of the page ends there), so a pass is linear in the page whatever it holds.
_ATTRS = r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript)\b{_ATTRS}(?:>|\Z).*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\s|/){_ATTRS})?+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_WORD = re.compile(r"[^\W_]+")


@dataclass(slots=True)
class Block:
    """One block of a page: its own text (without that of blocks inside it) and where it stands.

    ``container`` numbers the nearest open element that is no block, ``region`` is what it or an ancestor says of its content.
    """

    no: int
    tag: str
    parts: list = field(default_factory=list)
    link_chars: int = 0
    code_chars: int = 0
    break_before: int = 0
    gap_lines: int = 0
    container: int = 0
    region: int = 0

    @property
    def text(self) -> str:
        return " ".join(_html.unescape("".join(self.parts)).split())


def scan_blocks(page: str | None) -> list[Block]:
    """The blocks of ``page``, numbered from 1; an empty list for null or empty html."""
    if not page:
        return []
    blocks: list[Block] = []
    open_: list[Block] = []
    containers: list[tuple[str, int, int]] = [("", 0, 0)]
    depth: dict[str, int] = {}  # open containers and blocks by name, so that a stray end tag costs nothing
    links = codes = made = breaks = newlines = 0
    at = 0

    def drop() -> str:
        gone = open_.pop().tag
        depth[gone] -= 1
        return gone

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            if open_:
                b = open_[-1]
                b.parts.append(text)
                if links or codes:
                    size = len(text.strip())
                    if links:
                        b.link_chars += size
                    if codes:
                        b.code_chars += size
            newlines = max(newlines, text.count("\n")) if not text.strip() or text.endswith("\n") else 0
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name, closing = name.lower(), m.group(2) == "/"
        if name in BLOCK_TAGS:
            if closing:
                while depth.get(name) and drop() != name:
                    pass
                continue
            while open_ and (open_[-1].tag in _CLOSED_BY_BLOCK or name == "li" and open_[-1].tag == "li"):
                drop()
            b = Block(len(blocks) + 1, name, break_before=breaks, gap_lines=newlines, container=containers[-1][1], region=containers[-1][2])
            breaks = newlines = 0
            blocks.append(b)
            open_.append(b)
            depth[name] = depth.get(name, 0) + 1
            links = codes = 0
        elif name == "a":
            links = 0 if closing else 1
        elif name in ("code", "pre"):
            codes = max(0, codes - 1) if closing else codes + 1
        elif name in ("ul", "ol"):
            if closing:
                while open_ and open_[-1].tag in ("li", "p"):
                    drop()
            elif open_ and open_[-1].tag in _CLOSED_BY_BLOCK:
                drop()
        elif name not in _INLINE:
            breaks += 1
            links = codes = 0
            if name not in ("table", "tr", "hr", "input", "meta", "link", "base", "col", "source"):
                if not closing:
                    made += 1
                    depth[name] = depth.get(name, 0) + 1
                    containers.append((name, made, _REGIONS.get(name, containers[-1][2])))
                while closing and depth.get(name):
                    gone = containers.pop()[0]
                    depth[gone] -= 1
                    if gone == name:
                        break
            while open_ and open_[-1].tag != "blockquote":
                drop()
    if open_ and at < len(page):
        open_[-1].parts.append(page[at:])
    return blocks


def visible_text(page: str | None) -> str:
    """All text outside tags, comments, script, style and noscript, entities decoded, a blank for every tag."""
    return _html.unescape(_TOKEN.sub(" ", page)) if page else ""


def words(text: str | None) -> list[str]:
    """Maximal runs of Unicode letters or digits, lower-cased."""
    return _WORD.findall(text.lower()) if text else []
