"""Sentence boundaries across languages and scripts (problem 10).

Method: document-centred disambiguation. Whether a full stop ends a sentence is settled by what the same
document shows elsewhere: a word that stands before a stop and a small letter there is an abbreviation; a
word that stands there without a stop is none; a word written with a capital inside sentences, and never
small, is a proper name. Where the document is silent the corpus answers: abbreviations are the words
(also numbers behind a word, as in dates, and letters with stops between them) that almost never stand
without their stop; they may end a sentence if common words with a capital follow them often enough. Only
where both are silent a short list of known abbreviations is the prior.
Terminators are those of the script: ideographic stops, danda, Armenian and Arabic marks, the Greek
question mark, blanks in Thai. Matched quotations and brackets are closed to boundaries inside.

The corpus counts are aggregated by word in a shuffle and written once; only abbreviations reach the driver,
at most ``1 / least_share`` of them. Documents are then cut in one narrow stage. All passes are linear in the text.

Offsets count code points. A line end ends a sentence; outer blanks are left out.
Cases: null, empty and blank texts have no sentences; an empty table gives no rows; texts of any length
are read whole; unpaired quotation marks are ordinary characters; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.session import stored

# Common abbreviations that are followed by what they belong to; the prior where the texts are silent.
OPEN_ABBREVIATIONS = frozenset(
    "п т вул м проф ім напр зв див с ст обл тис млн млрд буд кв акад доц св гр просп пров бул оп рис табл тел т.зв н.е п.п "
    "gov dr mrs mr ms st vs fig art approx no prof gen sen rep rev capt lt col sgt pp cf vol ed e.g i.e hon "
    "ul pow im tys np tzw woj gm św nr ks mgr inż hab m.in płk ppor red al os "
    "z.b d.h bzw ca abs str vgl ggf inkl hr fr bd hrsg u.u i.d z.B d.h i.d u.U "
    "π.χ δηλ κ αρ σελ".split()
)
# Common abbreviations that may end a sentence; they do before a capital.
CLOSING_ABBREVIATIONS = frozenset("р рр р.р грн год хв ін коп т.д т.п т.ін etc co inc ltd corp jr p.m a.m r itd itp usw u.a κ.λπ κ.ά π.μ μ.μ".split())
# Words before a German ordinal number.
BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur beim ab bis seit jeder jede jedem jeden".split())

_ENDS = "。！？｡।॥؟۔։"
_CLOSE_OF = {"«": "»", "»": "«", "„": "“”", "“": "”", "‘": "’", '"': '"', "「": "」", "『": "』", "《": "》", "(": ")", "[": "]", "（": "）", "【": "】"}
_BRACKETS = "([（【"
_CLOSERS = "”“»«\"’)]」』》）】"
_MARK = re.compile(r"[.!?…。！？｡।॥؟۔։;;«»„“‘\"「『《(\[（【]")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_THAI = re.compile(r"[฀-๿]")
_SEPARATOR = re.compile(r"[\s«»„“”\"‘(\[（【「『]")
_BLANK = re.compile(r"\s")
_WORDS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"(?<![^\W_])[^\W\d_]++(?![^\W_]|\.)")
_STOP = re.compile(r"\.[ ]+[\"«„“(]?([^\W_])")
_NUMBER = re.compile(r"(?<![^\W_])([^\W\d_]++) [0-9]{1,2}(?![0-9.,:])")
_MIDCAP = re.compile(r"(?<=[^\W\d_][ ,])[ ]?([^\W\d_]+)")
_LETTERS = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]{1,3}){0,2}")
_SHORT = re.compile(r"(?:[^\W\d_]{1,3}\.)?[^\W\d_]{1,3}")
_OPENERS = "\"«„“(‘["
_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]|[^\W\d_][)]|[-–—•*·])\s+")


def _cased_start(c: str) -> bool:
    """Whether a sentence may start with this character: anything but a small letter."""
    return not c.islower()


def _key(word: str) -> str:
    """The form under which a word is known: small, but single letters and letters with stops as written."""
    return word if len(word) == 1 or "." in word else word.lower()


def keys_before(text: str, i: int) -> list[str]:
    """What the stop at i of a text may belong to, the longest first: ``т.д``, ``д``; ``am #`` of a number behind a word."""
    j = text.rfind(" ", 0, i)
    if i - j > 40:  # no word that is ever an abbreviation; keeps a text without blanks cheap
        return []
    word = text[j + 1 : i].lstrip(_OPENERS)
    before = text[text.rfind(" ", max(0, j - 40), j) + 1 : j].lstrip(_OPENERS) if j > 0 else ""
    if word.isdigit():
        return [f"{before.lower()} #"] if len(word) <= 2 and before and _WORDS.fullmatch(before) else []
    if not _LETTERS.fullmatch(word):
        return []
    if len(word) <= 3 and before.endswith(".") and _SHORT.fullmatch(before[:-1]):
        return [f"{before}{word}", _key(word)]
    return [_key(word)]


class Evidence:
    """What one document shows: abbreviations, words without a stop, capitals inside sentences."""

    def __init__(self, text: str):
        self.text, self.abbr, self.plain, self.names = text, None, None, None

    def is_abbreviation(self, word: str) -> bool:
        """Whether the document has the word with a stop before a small letter."""
        if self.abbr is None:
            flat = _BLANK.sub(" ", self.text)
            self.abbr = {k for m in _STOP.finditer(flat) if m.group(1).islower() for k in keys_before(flat, m.start())}
        return word in self.abbr

    def is_plain(self, word: str) -> bool:
        """Whether the document has the word without a stop."""
        if self.plain is None:
            self.plain = {_key(w) for w in _PLAIN.findall(self.text)}
        return word in self.plain

    def is_name(self, word: str) -> bool | None:
        """True for a proper name, False for a common word, None where the document is silent."""
        if self.names is None:
            self.small = {w for w in _WORDS.findall(self.text) if w[0].islower()}
            self.names = {m.group(1) for m in _MIDCAP.finditer(self.text) if m.group(1)[0].isupper()}
        if word.lower() in self.small:
            return False
        return True if word in self.names else None


def corpus_counts(texts: list[str | None]) -> Counter:
    """Counts by (word, kind): s = with stop before small, d = before a digit, c = before a common capital, n = before another one, b = without stop."""
    out: Counter = Counter()
    for text in texts:
        if not text:
            continue
        flat = _BLANK.sub(" ", text)
        words = Counter(_WORDS.findall(flat))
        for word, n in words.items():
            out[_key(word), "b"] += n
        for before in _NUMBER.findall(flat):
            out[f"{before.lower()} #", "b"] += 1
        for m in _STOP.finditer(flat):
            keys = keys_before(flat, m.start())
            if not keys:
                continue
            first = m.group(1)
            if first.islower():
                kind = "s"
            elif first.isdigit():
                kind = "d"
            elif first.isupper():
                after = _WORDS.match(flat, m.start(1)).group()
                kind = "s" if len(after) == 1 and flat[m.end() : m.end() + 1] == "." else "c" if after.lower() in words else "n"
            else:
                kind = "o"
            for key in keys:
                out[key, kind] += 1
                if "." not in key and not key.endswith("#"):
                    out[key, "b"] -= 1
    return out


def learn_abbreviations(docs: DataFrame, text_col: str = "text", least_share: float = 1e-6, bare_share: float = 0.05, closing_share: float = 0.2) -> dict[str, bool]:
    """Abbreviation -> whether it may end a sentence, from all documents.

    ``least_share`` of all words is the least frequency, so at most ``1 / least_share`` words come back.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                got = corpus_counts(batch.column(0).slice(start, 2000).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([k for _, k in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["word", "kind", "n"])

    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in "sdcnob"]
    counts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word string, kind string, n bigint").groupBy("word").agg(*kinds)
    counts = stored(counts, "sentence-words")
    total = counts.agg(F.sum("b")).first()[0] or 0
    stops = F.col("s") + F.col("d") + F.col("c") + F.col("n") + F.col("o")
    often = stops >= F.greatest(F.lit(5), F.lit(total * least_share))
    abbreviation = often & (F.col("b") <= bare_share * stops) & (F.col("s") + F.col("d") + F.col("n") > 0)
    rows = counts.filter(abbreviation).select("word", "c", "n").collect()
    return {r["word"]: r["c"] > 0 and r["c"] >= closing_share * (r["c"] + r["n"]) for r in rows}


def _class_of(keys: list[str], doc: Evidence, learned: dict[str, bool]) -> tuple[str, bool]:
    """(closing, open, name or none; whether the answer is evidence): the document first, then the corpus, then the prior."""
    for key in keys:
        if doc.is_abbreviation(key):
            known = learned.get(key)
            return ("name" if known is None else "closing" if known else "open"), True
        if key in learned:
            return ("closing" if learned[key] else "open"), True
        if doc.is_plain(key):
            return "none", True
        if key in CLOSING_ABBREVIATIONS:
            return "closing", False
        if key in OPEN_ABBREVIATIONS or key.endswith(" #") and key[:-2] in BEFORE_ORDINAL:
            return "open", False
    return "none", False


class _Line:
    """A line with the starts of its tokens and the closing marks that do not come any more."""

    def __init__(self, text: str):
        self.text, self.flat, self.seps, self.known, self.gone = text, _BLANK.sub(" ", text), None, {}, set()

    def start(self, i: int) -> int:
        """Where the token that holds i - 1 starts."""
        if self.seps is None:
            self.seps = [m.end() for m in _SEPARATOR.finditer(self.text)]
        k = bisect_left(self.seps, i + 1)
        return self.seps[k - 1] if k else 0

    def is_address(self, i: int) -> bool:
        """Whether the token around i is an address or a file name."""
        a = self.start(i)
        if a not in self.known:
            m = _BLANK.search(self.text, a)
            token = self.text[a : m.start() if m else len(self.text)]
            self.known[a] = "@" in token or "/" in token or "_" in token or token[:3].lower() == "www"
        return self.known[a]


def _stop_ends(at: _Line, i: int, end: int, doc: Evidence, learned: dict[str, bool]) -> bool:
    """Whether the single full stop at i of a line ends a sentence; ``end`` is behind it and its closers."""
    line = at.text
    n = len(line)
    before = line[i - 1] if i else ""
    if end < n and line[end].isdigit() and before.isdigit():
        return False
    if "ऀ" <= before <= "ॿ":
        return False
    if end < n and not line[end].isspace():
        nxt = line[end]
        if end > i + 1 or at.is_address(i):
            return False
        if nxt in "«„“‘(\"" and end + 1 < n:
            nxt = line[end + 1]
        start = at.start(i)
        dot = line.rfind(".", start, i)
        piece = line[max(start, dot + 1) : i]
        if not nxt.isalpha() or nxt.islower() or len(piece) < 2 or dot >= start and len(piece) < 4:
            return False
        if _class_of([_key(piece)], doc, learned)[0] in ("open", "name"):
            return False
        return before.islower() or before.isdigit() or not before.isupper() and before.isalpha()
    j = end
    while j < n and line[j].isspace():
        j += 1
    if j == n:
        return False  # the line end does it
    nxt, k = line[j], j
    while k + 1 < n and line[k] in "«»„“‘\"([（「『":
        k += 1
        nxt = line[k]
    if not _cased_start(nxt) or nxt in ",;:—–-)":
        return False
    start = at.start(i)
    if i - start > 200:
        return True
    word = line[start:i]
    written = word.strip("'’.,;:!?-–—")
    keys = keys_before(at.flat, i)
    if written.isdigit():
        if start == 0 and len(written) <= 3:  # the number of a list item
            return False
        return _class_of(keys, doc, learned)[0] == "none"
    kind, evident = _class_of(keys, doc, learned)
    if len(written) == 1 and written.isalpha():
        if k + 1 < n and line[k + 1] == "." and nxt.isalpha():  # z. B.
            return False
        if not written.islower():  # an initial
            return False
        return nxt.isupper() and kind not in ("open", "name")
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word) and not evident and kind == "none":  # letters with stops: initials before a name
        return word.islower() and nxt.isupper()
    if kind == "closing":
        return nxt.isupper() or not nxt.isalnum()
    if kind == "name" and nxt.isalpha():
        m = _WORDS.match(line, k)
        return (doc.is_name(m.group()) if m else None) is False
    return kind == "none"


def cut_line(line: str, doc: Evidence, learned: dict[str, bool]) -> list[int]:
    """Positions in a line at which a sentence ends."""
    cuts: list[int] = []
    n, at_line = len(line), _Line(line)
    thai = len(_THAI.findall(line)) * 3 > n
    at = 0
    while at < n:
        m = _MARK.search(line, at)
        if not m:
            break
        i, c = m.start(), m.group()
        if c in _CLOSE_OF:
            close = _find_close(at_line, i, c)
            if close < 0:
                at = i + 1
                continue
            inner = line[i + 1 : close].rstrip()
            at = close + 1
            while at < n and line[at] in _CLOSERS and line[at] not in _CLOSE_OF:
                at += 1
            if not inner or inner[-1] not in ".!?…" + _ENDS or inner.endswith((" д", " т")):
                continue
            j = at
            while j < n and line[j].isspace():
                j += 1
            if j == n:
                break
            k = j
            while k + 1 < n and line[k] in "«»„“‘\"(（「『":
                k += 1
            nxt = line[k]
            if nxt in ",;:.!?…—–-" or nxt.islower() or nxt in _ENDS:
                continue
            if c in _BRACKETS and (j == at or not nxt.isupper()):
                continue
            if j == at and nxt.isalpha() and not nxt.isupper() and nxt.lower() != nxt:
                continue
            cuts.append(at)
            continue
        end = i + 1
        while end < n and line[end] in ".!?…" + _ENDS:
            end += 1
        run = line[i:end]
        while end < n and line[end] in "”»’)]」』》）】" and line[end] not in "«„“‘":
            end += 1
        if c in ";;":
            greek = i > 0 and ("Ͱ" <= line[i - 1] <= "Ͽ" or "ἀ" <= line[i - 1] <= "῿")
            if greek and (end == n or line[end].isspace()):
                cuts.append(end)
            at = end
            continue
        at = end
        if end == n:
            break
        if any(x in _ENDS for x in run):
            cuts.append(end)
            continue
        if run == ".":
            if _stop_ends(at_line, i, end, doc, learned):
                cuts.append(end)
            continue
        j = end
        while j < n and line[j].isspace():
            j += 1
        if j == n:
            break
        k = j
        while k + 1 < n and line[k] in "«»„“‘\"([（「『":
            k += 1
        nxt = line[k]
        if j == end:  # no blank: a new sentence only before a capital
            if nxt.isupper() and (i == 0 or not line[i - 1].isupper()):
                cuts.append(end)
            continue
        if nxt.islower() or nxt in ",;:—–-":
            continue
        cuts.append(end)
    if thai:
        marker = _ITEM.match(line)
        cuts += [m.start() for m in re.finditer(r"\s+", line) if not marker or m.start() >= marker.end()]
        cuts = sorted(set(cuts))
    return cuts


def _find_close(at: _Line, i: int, c: str) -> int:
    """The place of the mark that closes the one at i within its line, or -1."""
    line = at.text
    if c in at.gone or c == "»" and i and not line[i - 1].isspace():  # a closing mark whose opening is missing
        return -1
    if c == "‘":
        j = line.find("’", i + 1)
        while j >= 0 and j + 1 < len(line) and line[j + 1].isalpha():
            j = line.find("’", j + 1)
    else:
        found = [j for j in (line.find(w, i + 1) for w in _CLOSE_OF[c]) if j >= 0]
        j = min(found) if found else -1
    if j < 0:
        at.gone.add(c)
    return j


def sentences(text: str | None, learned: dict[str, bool] | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in code points."""
    if not text:
        return []
    out, doc = [], Evidence(text)
    for m in _LINE.finditer(text):
        line, base, start = m.group(), m.start(), 0
        for cut in [*cut_line(line, doc, learned or {}), len(line)]:
            piece = line[start:cut]
            lead = len(piece) - len(piece.lstrip())
            body = piece.strip()
            if body:
                out.append((base + start + lead, base + start + lead + len(body)))
            start = cut
    return out


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learned: dict[str, bool] | None = None) -> DataFrame:
    """(id, start_pos, end_pos): one row per sentence of every document."""
    learned = learn_abbreviations(docs, text_col) if learned is None else learned

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows, starts, ends = [], [], []
                for i, text in enumerate(part.column(1)):
                    for a, b in sentences(text.as_py(), learned):
                        rows.append(i)
                        starts.append(a)
                        ends.append(b)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[id_col, "start_pos", "end_pos"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start_pos bigint, end_pos bigint")
