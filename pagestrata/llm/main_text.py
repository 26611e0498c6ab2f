"""Main body of web pages: flat text blocks classified by a decision tree (problem 1).

Method: every page is cut into flat blocks (:func:`scan_blocks`); each block gets its word count and
link density, those of its neighbours, and those of its run, list and container of blocks; no wording
counts, so the language of a page does not matter. A decision tree fitted at start-up on a small
labelled table decides. The labelled table is made by rule: pages of made-up words composed from a few
layouts (:func:`labelled_pages`), about 40 000 blocks, no page of the corpus. Scan and tree run in one
narrow Arrow stage; only the dedupe of results shuffles.

Cases: null, empty or unparsable html gives no rows; repeated deliveries of a page give its blocks
once; pages of any length are scanned whole; a null ``page_id`` is kept as a null key; further
columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagestrata.functions.html_scan import Block, scan_blocks
from pagestrata.llm.cart import Tree, fit

FEATURES = (
    "is_h1", "is_head", "is_li", "is_quote", "words", "link", "prev_words", "prev_link", "next_words", "next_link", "prev2_words", "prev2_link", "next2_words", "next2_link",
    "head_gap", "head_link", "region", "page_h1", "after_h1", "h1_box", "h1_run", "runs_since_h1", "links_since_h1", "new_run", "run_words", "run_link", "run_longest", "run_blocks", "run_rest",
    "box_share", "box_link", "box_longest", "list_words", "list_link", "list_blocks", "before_list", "until_links", "until_long", "since_long", "box_until_long", "words_before", "words_after", "same_box_next", "last_run",
)
_LONG = 12.0  # words of a block that can hardly be a label
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")


def _measure(b: Block) -> tuple[float, float]:
    """Words (two wide characters count as one) and link density."""
    text = b.text
    if not text:
        return 0.0, 0.0
    n = text.count(" ") + 1.0
    if text[0] > "\u2e00" or text[-1] > "\u2e00":
        n += len(_WIDE.findall(text)) / 2
    return n, min(1.0, b.link_chars / len(text))


class _Part:
    """Sums over the blocks of a run, a container or a list."""

    __slots__ = ("words", "linked", "longest", "blocks", "seen")

    def __init__(self):
        self.words = self.linked = self.longest = 0.0
        self.blocks = self.seen = 0

    def add(self, words: float, link: float) -> None:
        self.words += words
        self.linked += words * link
        self.longest = max(self.longest, words * (1 - link))
        self.blocks += 1


def _distance(marks: list[bool], most: int = 9) -> tuple[list[float], list[float]]:
    """For each place, how far the next and the last mark are, at most ``most``."""
    n = len(marks)
    ahead, behind, at = [0.0] * n, [0.0] * n, -most
    for i in range(n):
        behind[i] = float(min(most, i - at))
        if marks[i]:
            at = i
    at = n + most
    for i in range(n - 1, -1, -1):
        ahead[i] = float(min(most, at - i))
        if marks[i]:
            at = i
    return ahead, behind


def block_features(blocks: list[Block]) -> list[tuple]:
    """One row of :data:`FEATURES` for each block of a page: numbers of words, links and places, no wording."""
    n = len(blocks)
    if not n:
        return []
    words, link = map(list, zip(*map(_measure, blocks)))
    strong = [x >= 0.8 for x in link]
    long = [w >= _LONG and x < 0.5 for w, x in zip(words, link)]
    h1 = next((i for i, b in enumerate(blocks) if b.tag == "h1"), -1)
    run, fresh, lists, boxes = [], [], [], {}
    last = None
    for i, b in enumerate(blocks):
        new = last is None or b.break_before > 0 or b.gap_lines >= 2 or b.container != last
        last = b.container
        fresh.append(new)
        run.append(_Part() if new else run[-1])
        run[-1].add(words[i], link[i])
        boxes.setdefault(last, _Part()).add(words[i], link[i])
        joined = b.tag == "li" and i and blocks[i - 1].tag == "li" and not new
        lists.append(lists[-1] if joined else _Part())
        lists[-1].add(words[i], link[i])
    plain = [w * (1 - x) for w, x in zip(words, link)]
    total = sum(plain) + 1e-9
    until_links, _ = _distance(strong)
    until_long, since_long = _distance(long)
    box_until, seen = [9.0] * n, {}
    for i in range(n - 1, -1, -1):
        at = seen.get(blocks[i].container)
        if at is not None:
            box_until[i] = float(min(9, at - i))
        if long[i]:
            seen[blocks[i].container] = i
    w2, l2 = [0.0, 0.0, *words, 0.0, 0.0], [0.0, 0.0, *link, 0.0, 0.0]
    out, head, runs, links, passed = [], -9, 0, 0, 0.0
    for i, b in enumerate(blocks):
        tag = b.tag
        is_head = tag[0] == "h" and tag != "h1"
        if tag == "h1":
            head = -9
        elif is_head:
            head = i
        after = 0 <= h1 <= i
        if after and fresh[i] and i > h1:
            runs += 1
        own, box, row = run[i], boxes[b.container], lists[i]
        own.seen += 1
        out.append((
            float(tag == "h1"), float(is_head), float(tag == "li"), float(tag == "blockquote"), words[i], link[i],
            w2[i + 1], l2[i + 1], w2[i + 3], l2[i + 3], w2[i], l2[i], w2[i + 4], l2[i + 4],
            float(min(9, i - head)), link[head] if head >= 0 else 0.0, float(b.region), float(h1 >= 0), float(after), float(h1 >= 0 and b.container == blocks[h1].container), float(h1 >= 0 and own is run[h1]),
            float(min(9, runs)), float(min(9, links)), float(fresh[i]), own.words, own.linked / max(own.words, 1.0), own.longest, float(own.blocks), float(own.blocks - own.seen),
            box.words / max(total, 1.0), box.linked / max(box.words, 1.0), box.longest, row.words / row.blocks, row.linked / max(row.words, 1.0), float(row.blocks), float(i + 1 < n and blocks[i + 1].tag == "li"),
            until_links[i], until_long[i], since_long[i], box_until[i], passed / total, (total - passed - plain[i]) / total, float(i + 1 < n and blocks[i + 1].container == b.container), float(own is run[-1]),
        ))
        passed += plain[i]
        if after and strong[i] and i > h1:
            links += 1
    return out


def labelled_pages(seed: int = 7, pages: int = 120) -> list[tuple[str, list[int]]]:
    """The small labelled table, made by rule: (html, label of each block); 1 is the main body.

    A page joins furniture pieces and an article in one of five layouts; all words are drawn from a made-up
    lexicon, so only lengths, links and places can be learned.
    """
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def say(lo: int, hi: int) -> str:
        return " ".join(rng.choice(lexicon) for _ in range(rng.randint(lo, hi))).capitalize()

    def link(text: str) -> str:
        return f'<a href="/{rng.choice(lexicon)}/{rng.randint(1, 9999)}">{text}</a>'

    def menu(tag: str = "li") -> tuple[str, list[int]]:
        items = [link(say(1, 3)) if rng.random() < 0.85 else say(1, 2) for _ in range(rng.randint(5, 12))]
        close = f"</{tag}>" if rng.random() < 0.6 else ""
        body = "".join(f"<{tag}>{x}{close}" for x in items)
        return (f"<ul>{body}</ul>" if tag == "li" else body), [0] * len(items)

    def teaser() -> tuple[str, list[int]]:
        title = say(1, 4)
        head = rng.choice(["h3", "h4", "p"])
        if rng.random() < 0.5:
            items = [f"<li>{link(say(4, 8))}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(3, 5))]
            return f"<{head}>{title}</{head}><ul>{''.join(items)}</ul>", [0] * (1 + len(items))
        parts, labels = [f"<{head}>{title}</{head}>"], [0]
        for _ in range(rng.randint(2, 4)):
            parts.append(f"<h4>{link(say(4, 8))}</h4>")
            labels.append(0)
            if rng.random() < 0.6:
                parts.append(f"<p>{'. '.join(say(4, 14) for _ in range(rng.randint(1, 4)))}." + rng.choice(["", "</p>"]))
                labels.append(0)
        return "".join(parts), labels

    def share() -> tuple[str, list[int]]:
        items = [say(2, 5) for _ in range(rng.randint(2, 4))]
        return "<ul>" + "".join(f"<li>{link(x) if rng.random() < 0.2 else x}</li>" for x in items) + "</ul>", [0] * len(items)

    def footer(few: bool = False) -> tuple[str, list[int]]:
        parts = [f"<p>{say(3, 9)}" + rng.choice(["", "."]) + rng.choice(["", "</p>"]) for _ in range(rng.randint(1, 4))]
        labels = [0] * len(parts)
        if rng.random() < 0.6 and not few:
            a, b = menu()
            parts.append(a)
            labels += b
        return "".join(parts), labels

    def article() -> tuple[str, list[int]]:
        parts, labels = [], []

        def add(x: str) -> None:
            parts.append(x)
            labels.append(1)

        def inline(text: str) -> str:
            w = text.split()
            if len(w) > 1 and rng.random() < 0.25:
                i = rng.randrange(len(w) - 1)
                w[i : i + 2] = [link(" ".join(w[i : i + 2])) if rng.random() < 0.5 else f"<b>{' '.join(w[i : i + 2])}</b>"]
            return " ".join(w)

        if rng.random() < 0.25:
            head = rng.choice(["h1", "h1", "h2", ""])
            if head:
                text = say(1, 4)
                add(f"<{head}>{link(text) if rng.random() < 0.15 else inline(text)}</{head}>")
            for _ in range(rng.randint(0 if head else 1, 2)):
                add(f"<p>{inline(say(1, 14))}</p>")
            return "".join(parts), labels
        if rng.random() < 0.95:
            add(f"<h1>{inline(say(4, 9))}</h1>")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.15:
                add(f"<{rng.choice(['h2', 'h3'])}>{inline(say(4, 9))}" + rng.choice(["</h2>", "</h3>"]))
            elif kind < 0.27:
                items = rng.randint(2, 5)
                parts.append("<ul>")
                for _ in range(items):
                    add(f"<li>{inline(say(3, 9))}" + rng.choice(["", "</li>"]))
                parts.append("</ul>")
            elif kind < 0.33:
                add(f"<blockquote>{inline(say(6, 20))}.</blockquote>")
            elif kind < 0.39:
                add(f"<p>{inline(say(4, 14))}.</p>")
            elif kind < 0.49:
                add(f"<p>{inline(say(1, 4))}.</p>")
            else:
                add(f"<p>{inline('. '.join(say(4, 12) for _ in range(rng.randint(1, 6))))}." + rng.choice(["", "</p>"]))
        return "".join(parts), labels

    out = []
    for _ in range(pages):
        layout = rng.randrange(5)
        pieces: list[tuple[str, tuple[str, list[int]]]] = []
        if rng.random() < 0.04:  # nothing but an article
            text, labels = article()
            out.append((f"<html><body>\n{text}</body></html>", labels))
            continue
        box = {0: "nav", 1: "div", 2: "td", 3: "", 4: "section"}[layout]
        if rng.random() < 0.3:
            pieces.append((rng.choice([box, "div"]) if box else "", (f"<p>{say(4, 13)}</p>", [0])))
        if rng.random() < 0.92:
            pieces.append((box, menu("p" if layout == 2 else "li")))
        if rng.random() < 0.3:
            pieces.append(("div", (f"<p>{say(1, 2)} › {say(1, 2)}</p>", [0])))
        if rng.random() < 0.3:
            pieces.append(("aside" if box == "nav" else box, teaser()))
        pieces.append(({0: "article", 1: "div", 2: "td", 3: "", 4: "div"}[layout], article()))
        if rng.random() < 0.5:
            pieces.append(("", share()))
        if rng.random() < 0.5:
            pieces.append(("aside" if box == "nav" else box, teaser()))
        if rng.random() < 0.9:
            pieces.append(("footer" if box == "nav" else box and "div", footer()))
        if rng.random() < 0.2:
            pieces.append((box and "div", (f"<p>{say(4, 13)}</p>", [0])))
        page, labels = [], []
        breaks = rng.choice([("\n", "\n\n"), ("\n", "\n\n"), ("\n",), ("",)])
        for wrap, (text, got) in pieces:
            gap = rng.choice(breaks) if not wrap else breaks[0]
            loose = wrap == "td" and rng.random() < 0.3
            page.append(f"{gap}<{wrap}>\n{text}" + ("" if loose else f"</{wrap}>") if wrap else gap + text)
            labels += got
        out.append(("<html><body>\n" + "".join(page) + "\n</body></html>", labels))
    return out


@lru_cache(maxsize=4)
def main_tree(seed: int = 7, pages: int = 1600) -> Tree:
    """The tree fitted on :func:`labelled_pages`; the bound of the labelled table is ``pages``."""
    xs, ys = [], []
    for page, labels in labelled_pages(seed, pages):
        x = np.array(block_features(scan_blocks(page)))
        assert len(x) == len(labels), "a labelled page must have a label for each block"
        xs.append(x)
        ys += labels
    return fit(np.concatenate(xs), np.array(ys), max_depth=14, min_leaf=15)


def main_blocks(page: str | None, tree: Tree) -> list[Block]:
    """The blocks of the main body of one page."""
    blocks = scan_blocks(page)
    if not blocks:
        return []
    p = tree.predict(np.array(block_features(blocks))) >= 0.5
    return [b for b, keep in zip(blocks, p) if keep]


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", seed: int = 7, table_pages: int = 1600) -> DataFrame:
    """(id, block_no, tag, text) of the main body of every page; one row per kept block."""
    tree = main_tree(seed, table_pages)
    key_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                owner, blocks, rows = [], [], []
                for i, page in enumerate(part.column(1)):
                    got = scan_blocks(page.as_py())
                    blocks += got
                    rows += block_features(got)
                    owner += [i] * len(got)
                keep = np.flatnonzero(tree.predict(np.array(rows)) >= 0.5) if rows else []
                kept = [blocks[i] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([owner[i] for i in keep], pa.int32())), pa.array([b.no for b in kept], pa.int64()), pa.array([b.tag for b in kept], pa.string()), pa.array([b.text for b in kept], pa.string())],
                    names=[id_col, "block_no", "tag", "text"],
                )

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {key_type}, block_no bigint, tag string, text string")
