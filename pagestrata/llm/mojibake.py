"""Text decoded with the wrong character encoding: find it, and restore it where possible (problem 3).

Method: a noisy channel. A channel is a pair (encoding the text was written in, encoding it was read
with). For every token the bytes behind its characters form a lattice - one byte per character of the
reading encoding (two in GBK), a wildcard for each lost byte (U+FFFD) - which is decoded with the writing
encoding. Corpus word frequencies and character pairs, counted over all texts, score the original against
every decoding. A Viterbi search over (byte, last character) finds the likeliest decoding of a lattice with
wildcards among all characters the corpus holds. Where no channel wins, the characters beside the lost bytes
stand as written: the most frequent of all words that fits fills the gap (a join), else character pairs do.
Counts are hashed into cells (words in three rows, the least of which counts), so the model has a fixed size at any corpus size and is summed per task.

A record is a case when a token's best decoding beats the token as it stands; a token with lost bytes is decoded the
same way and is a case even where no decoding of its lattice wins, since bytes are gone.
Cases: null and empty texts are never cases; a null id is kept; repeated deliveries give one row; an
empty table gives no rows; further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.html_scan import visible_text
from pagestrata.session import stored

WORD_CELLS, PAIR_CELLS, CHAR_CELLS = 1 << 20, 1 << 18, 1 << 16
LOST = "�"
# Encodings in which texts are wrongly read, and in which they may have been written.
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "koi8-u", "koi8-r", "cp866", "cp437", "mac-cyrillic", "mac-roman", "gb18030")
WRITTEN_IN = ("cp1251", "koi8-u", "cp866", "cp1252", "cp1250", "iso8859-2", "mac-cyrillic", "gbk")
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_WORD = re.compile(r"[^\W_]+")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


@lru_cache(maxsize=32)
def _byte_map(encoding: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined stand for their own control character."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that ``encoding`` would have read as ``text``; null where there are none."""
    if encoding == "gb18030":
        try:
            return text.encode("gbk")
        except UnicodeEncodeError:
            return None
    table = _byte_map(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _cells(word: str) -> tuple[int, int, int]:
    """A word's cell in each of the three rows of the word table."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    m = WORD_CELLS - 1
    return h & m, WORD_CELLS + (h >> 20 & m), 2 * WORD_CELLS + (h >> 40 & m)


def _pair_cells(codes: np.ndarray) -> np.ndarray:
    h = (codes[:-1] * np.uint32(0x9E3779B1)) ^ (codes[1:] * np.uint32(0x85EBCA77))
    return (h >> np.uint32(14)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Frequencies:
    """Corpus frequencies of words, character pairs and characters, in hashed cells."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, chars: np.ndarray, top: dict[str, int]):
        self.words, self.pairs, self.chars, self.top = words, pairs, chars, top
        self.alphabets: dict = {}
        self.total = max(1.0, float(words.sum()) / 3)
        self.noise = 2 * self.total / WORD_CELLS

    def count(self, word: str) -> float:
        return max(0.0, float(min(self.words[c] for c in _cells(word))) - self.noise)

    def by_pairs(self, word: str) -> float:
        """Log-probability of a small word by its character pairs alone."""
        codes = _codes(f" {word} ")
        return float(np.log((self.pairs[_pair_cells(codes)] + 0.05) / (self.chars[np.minimum(codes[:-1], 0xFFFF)] + 8.0)).sum()) - 2.0

    def log(self, text: str) -> float:
        """Log-probability of a token: words by frequency where known, else by character pairs."""
        low = text.lower()
        out = 0.0
        for w in _WORD.findall(low):
            seen = self.count(w)
            by_pairs = self.by_pairs(w)
            out += max(by_pairs, float(np.log(seen / self.total))) if seen else by_pairs
        for c in low:
            if not (c.isalnum() or c in " _"):
                out += float(np.log((self.chars[min(ord(c), 0xFFFF)] + 0.05) / (self.total * 6))) if ord(c) > 127 else -3.0
        return out


def count_frequencies(texts: DataFrame) -> Frequencies:
    """Frequencies over a one-column table of texts, repetition bounded.

    Segments are lines and the parts of a title between bars. A segment that a hot site or a group of copies repeats counts for at
    most 1e-5 of all words, so a garbled one cannot become sound by repetition and a sound one is not forgotten.
    """

    def run(batches):
        words: Counter = Counter()
        pairs, chars = np.zeros(PAIR_CELLS, np.int64), np.zeros(CHAR_CELLS, np.int64)
        cells = np.zeros(3 * WORD_CELLS, np.int64)

        def spill():
            for w, n in words.items():
                for c in _cells(w):
                    cells[c] += n
            words.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, of_weight = batch.slice(start, 256), {}
                for t, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    of_weight.setdefault(n, []).append(t)
                for n, group in of_weight.items():
                    text = "\n".join(group).lower()
                    for w, k in Counter(_WORD.findall(text)).items():
                        words[w] += k * n
                    codes = _codes(re.sub(r"[\s!-/:-@\[-`{-~]+", " ", text))
                    pairs += n * np.bincount(_pair_cells(codes), minlength=PAIR_CELLS)
                    chars += n * np.bincount(np.minimum(codes, 0xFFFF), minlength=CHAR_CELLS)
                if len(words) > 400_000:
                    spill()
        spill()
        for kind, counts in enumerate((cells, pairs, chars)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["kind", "cell", "n"])

    segments = texts.select(F.explode(F.split(F.col(texts.columns[0]), r"\s*[\r\n]\s*|\s+\|\s+")).alias("text")).filter("text != ''")
    segments = stored(segments.groupBy("text").agg(F.count("*").alias("n")), "segments")
    length = segments.agg(F.sum(F.length("text") * F.col("n"))).first()[0] or 0
    segments = segments.select("text", F.least("n", F.lit(max(1, int(length / 6 * 1e-5)))).alias("n"))
    rows = segments.mapInArrow(run, "kind int, cell int, n bigint").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (rows.column(c).to_numpy() for c in ("kind", "cell", "n"))
    out = []
    for k, size in enumerate((3 * WORD_CELLS, PAIR_CELLS, CHAR_CELLS)):
        table = np.zeros(size, dtype=np.float32)
        table[cell[kind == k]] = n[kind == k]
        out.append(table)
    return Frequencies(*out, {})


def common_words(texts: DataFrame, vocabulary: int = 50_000) -> dict[str, int]:
    """The most frequent words of the texts, at most ``vocabulary``: candidates for filling lost bytes."""

    def run(batches):
        for batch in batches:
            words: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(_WORD.findall(t.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    top = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    return dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))


def decodings(token: str):
    """(channel, decoded) of every channel through which a token may have come; damaged sequences only by their valid part."""
    for reader in READ_AS:
        raw = to_bytes(token, reader)
        if raw is None:
            continue
        runs = list(_UTF8.finditer(raw))
        if runs and reader != "gb18030":
            parts, at = [], 0
            back = {b: c for c, b in _byte_map(reader).items()}
            for m in runs:
                parts += [back[b] for b in raw[at : m.start()]]
                parts.append(m.group().decode("utf-8", "replace"))
                at = m.end()
            parts += [back[b] for b in raw[at:]]
            yield f"utf-8>{reader}", "".join(parts), sum(len(m.group()) for m in runs)
        elif reader == "gb18030":
            try:
                yield "utf-8>gbk", raw.decode("utf-8"), len(raw)
            except UnicodeDecodeError:
                pass
            continue
        for writer in WRITTEN_IN:
            if writer != reader:
                try:
                    yield f"{writer}>{reader}", raw.decode(writer), 0
                except UnicodeDecodeError:
                    continue


def best_decoding(token: str, freq: Frequencies, margin: float = 8.0, depth: int = 0) -> tuple[str, str] | None:
    """(channel, text) of the decoding that beats the token as it stands by ``margin`` nats, else null."""
    low = token.lower()
    own = freq.log(token)
    best, got = own + margin, None
    for channel, text, sure in decodings(token):
        if text == token or any(freq.chars[min(ord(c), 0xFFFF)] < 1 for c in text.lower() if ord(c) > 127 and c != LOST and not 0x80 <= ord(c) < 0xA0):
            if text == token or depth or sure < 4 or not channel.endswith(("cp1252", "latin-1")):  # but it may have gone through twice
                continue
        if sure == 2 and len(token) == 2 and not channel.endswith(("cp1252", "latin-1")):
            continue
        if not sure:
            if not any(c.isalpha() for c in token if ord(c) > 127) or len(text) == len(token) and not any(a != b and a.isalnum() for a, b in zip(token, text)):
                continue
            seen = freq.count(text.lower())
            if seen >= 20 and len(text) >= 4 and seen >= 5 * freq.count(low.strip("«»“”„\"'().,;:!?…–—-")) and freq.by_pairs(text.lower()) > freq.by_pairs(low):
                return channel, text
        score = freq.log(text) + (3.0 * (sure // 2) + 4.0 if sure else 0.0)
        if sure and depth == 0:
            again = best_decoding(text, freq, margin, 1)
            if again and again[0].startswith("utf-8"):
                channel, text, score = f"{channel},{again[0]}", again[1], score + 12.0
        if score > best:
            best, got = score, (channel, text)
    return got


@lru_cache(maxsize=1)
def _small_table() -> np.ndarray:
    return np.array([ord(chr(c).lower()[0]) for c in range(0x10000)], np.uint32)


def _small(codes: np.ndarray) -> np.ndarray:
    """Code points in lower case."""
    return np.where(codes < 0x10000, _small_table()[np.minimum(codes, 0xFFFF)], codes)


def _log_pairs(freq: Frequencies, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Log-probability of every character of ``after`` behind every one of ``before`` (rows)."""
    h = ((before * np.uint32(0x9E3779B1))[:, None] ^ (after * np.uint32(0x85EBCA77))[None, :]) >> np.uint32(14)
    return np.log((freq.pairs[h] + 0.05) / (freq.chars[np.minimum(before, 0xFFFF)] + 8.0)[:, None])


def _alphabet(freq: Frequencies, writer: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per encoded length: (code points, bytes) of all characters above ASCII that the corpus holds, either case."""
    if writer not in freq.alphabets:
        seen = {chr(c) for c in np.flatnonzero(freq.chars >= 1) if c >= 0xA0 and c != ord(LOST) and not 0xD800 <= c < 0xE000}
        by_len: dict[int, list[tuple[int, list[int]]]] = {}
        for c in sorted(seen | {c.upper() for c in seen if len(c.upper()) == 1}, key=lambda c: (c.isupper(), c)):  # of equals the small letter
            try:
                raw = c.encode(writer)
            except UnicodeEncodeError:
                continue
            by_len.setdefault(len(raw), []).append((ord(c), list(raw)))
        freq.alphabets[writer] = {n: (np.array([c for c, _ in x], np.uint32), np.array([r for _, r in x], np.uint8)) for n, x in by_len.items()}
    return freq.alphabets[writer]


def lost_bytes(token: str, reader: str) -> list[int | None] | None:
    """The bytes behind a token, null for each lost one; null where ``reader`` cannot have read it so."""
    out: list[int | None] = []
    for piece in re.findall(LOST + "|[^" + LOST + "]+", token):
        if piece == LOST:
            out.append(None)
            continue
        raw = to_bytes(piece, reader)
        if raw is None:
            return None
        out += raw
    return out


def decode_lattice(raw: list[int | None], writer: str, freq: Frequencies, paths: int = 192, ranked: int = 64) -> str | None:
    """The likeliest text of bytes with wildcards: a Viterbi search by character pairs that keeps the ``paths`` best at every byte; the ``ranked`` best at the end are ranked by word frequencies."""
    alphabet = _alphabet(freq, writer)
    steps: list[list] = [[] for _ in range(len(raw) + 1)]  # at each byte: parts (character, score, byte before, path before)
    steps[0] = [(np.array([32], np.uint32), np.zeros(1), -1, np.array([-1]))]
    kept: list = [None] * (len(raw) + 1)
    for at in range(len(raw) + 1):
        if not steps[at]:
            continue
        char, score, back = (np.concatenate([x[i] for x in steps[at]]) for i in (0, 1, 3))
        origin = np.concatenate([np.full(len(x[0]), x[2]) for x in steps[at]])
        top = np.argsort(-score, kind="stable")[:paths]
        char, score = char[top], score[top]
        kept[at] = (char, score, origin[top], back[top])
        if at == len(raw):
            break
        if raw[at] is not None and raw[at] < 128:
            options = [(1, np.array([raw[at]], np.uint32))]
        else:
            options = []
            for n, (codes, table) in alphabet.items():
                part = raw[at : at + n]
                if len(part) == n:
                    fit = np.ones(len(codes), bool)
                    for i, x in enumerate(part):
                        if x is not None:
                            fit &= table[:, i] == x
                    if fit.any():
                        options.append((n, codes[fit]))
        for n, codes in options:
            through = (score[:, None] + _log_pairs(freq, _small(char), _small(codes))).ravel()
            best = np.argpartition(-through, paths)[:paths] if len(through) > paths else np.arange(len(through))
            steps[at + n].append((codes[best % len(codes)], through[best], at, best // len(codes)))
    if kept[-1] is None:
        return None

    def spell(i: int) -> str:
        out, at = [], len(raw)
        while at > 0:
            char, _, origin, back = kept[at]
            out.append(chr(char[i]))
            at, i = int(origin[i]), int(back[i])
        return "".join(out[::-1])

    return max(dict.fromkeys(spell(i) for i in range(min(ranked, len(kept[-1][0])))), key=freq.log)


def decode_lost(token: str, freq: Frequencies, margin: float = 8.0, channel: str | None = None) -> tuple[str, str] | None:
    """(channel, text) of a token both misread and with lost bytes; null where its characters stand as they were written.

    ``channel`` is one through which other tokens of the text came: where it wins, no other is tried.
    """
    known = [x for x in token.split(LOST) if x]
    if not any(ord(c) > 127 for x in known for c in x) or not any(c.isalnum() for x in known for c in x):
        return None
    filled = fill_lost(token, freq)
    if LOST not in filled and all(freq.count(w) >= 2 for w in _WORD.findall(filled.lower())):
        return None  # with letters in its gaps it is of known words
    own = max(sum(freq.log(x) for x in known), freq.log(filled))
    best, got = own + margin, None
    pairs = [(writer, reader) for reader in READ_AS for writer in ("utf-8", *WRITTEN_IN)]
    first = [p for p in pairs if f"{p[0]}>{'gbk' if p[1] == 'gb18030' else p[1]}" == channel]
    for place, (writer, reader) in enumerate(first + pairs):
        if place == len(first) and got:
            break
        raw = lost_bytes(token, reader)
        if raw is None:
            continue
        known_bytes = sum(x is not None and x > 127 for x in raw)
        # Only UTF-8 has a form of its own; elsewhere the known bytes must outweigh the free ones.
        if writer == reader or writer != "utf-8" and (reader == "gb18030" or known_bytes < 2 * raw.count(None)):
            continue
        text = decode_lattice(raw, writer, freq)
        if text is None or not any(ord(c) > 127 for c in text):
            continue
        if writer != "utf-8" and not any(a != LOST and a != b and a.isalnum() for a, b in zip(token, text)):
            continue  # the known characters stay as they are
        sure = known_bytes if writer == "utf-8" else 0
        score = freq.log(text) + (3.0 * (sure // 2) + 4.0 if sure else 0.0)
        if score > best and (sure >= 4 or not sure):
            best, got = score, (f"{writer}>{'gbk' if reader == 'gb18030' else reader}", text)
    return got


_PART = re.compile(r"(?:[^\W_]|" + LOST + ")+")


def lost_parts(token: str) -> list[str]:
    """The words of a token that hold U+FFFD beside a letter or digit, without the punctuation around them."""
    return [p for p in _PART.findall(token) if LOST in p and p.strip(LOST)]


@lru_cache(maxsize=4096)
def _part_pattern(part: str) -> re.Pattern:
    """A run of lost bytes stands for up to as many characters, none of them ASCII, of up to three bytes each."""
    return re.compile("".join(r"([^\W_\x00-\x7f]{%d,%d})" % ((len(p) + 2) // 3, len(p)) if p[0] == LOST else re.escape(p) for p in re.findall(LOST + "+|[^" + LOST + "]+", part.lower())))


def fits(part: str, word: str) -> bool:
    """Whether a word may be what a part with lost bytes stood for."""
    m = _part_pattern(part).fullmatch(word)
    return bool(m) and all(len(g.encode("utf-8", "replace")) >= len(r) for g, r in zip(m.groups(), re.findall(LOST + "+", part)))


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def _fill_by_pairs(part: str, freq: Frequencies) -> str:
    """A part filled by character pairs alone, with lower-case letters of the scripts around; a run of lost bytes is taken for whole letters."""
    scripts = {_script(c) for c in part if c != LOST}
    key = ("letters", frozenset(scripts))
    if key not in freq.alphabets:
        letters = np.concatenate([c for c, _ in _alphabet(freq, "utf-8").values()])
        letters = np.array([c for c in letters if chr(c).isalpha() and _script(chr(c)) in scripts and chr(c).lower() == chr(c)], np.uint32)
        freq.alphabets[key] = letters
    letters = freq.alphabets[key]
    if not len(letters):
        return part
    width = len(chr(letters[0]).encode())
    items: list[str | None] = []
    for p in re.findall(LOST + "+|[^" + LOST + "]+", part):
        items += [None] * max(1, round(len(p) / width)) if p[0] == LOST else list(p)
    codes, score, back = np.array([32], np.uint32), np.zeros(1), []
    for c in items:
        after = letters if c is None else np.array([ord(c.lower()[0])], np.uint32)
        through = score[:, None] + _log_pairs(freq, codes, after)
        best = through.argmax(0)
        back.append((codes, best))
        codes, score = after, through[best, np.arange(len(after))]
    i, out = int(score.argmax()), []
    for k in range(len(items) - 1, -1, -1):
        out.append(items[k] or chr(codes[i]))
        i, codes = int(back[k][1][i]), back[k][0]
    return "".join(out[::-1])


def fill_lost(token: str, freq: Frequencies, words: dict[str, str] | None = None) -> str:
    """A token with U+FFFD restored: by ``words`` (part -> word), the words of ``freq.top``, else character pairs.

    A run of lost bytes may stand for as many letters (single-byte writing) or for fewer (UTF-8).
    """
    done = {}
    for part in lost_parts(token):
        word = (words or {}).get(part)
        if word is None and freq.top:
            word = max(((n, w) for w, n in freq.top.items() if fits(part, w)), default=(0, None))[1]
        if word is None:
            word = _fill_by_pairs(part, freq)
        else:  # known letters keep their case
            m, known = _part_pattern(part).fullmatch(word), part.replace(LOST, "")
            groups = iter(g.upper() if known.isupper() and len(known) > 1 else g for g in m.groups())
            word = "".join(next(groups) if p[0] == LOST else p for p in re.findall(LOST + "+|[^" + LOST + "]+", part))
        done[part] = word
    return _PART.sub(lambda m: done.get(m.group(), m.group()), token)


def _grams(text: str) -> set[str]:
    return {text[i : i + n] for n in (1, 2, 3, 4) for i in range(len(text) - n + 1)} - {"^", "$"}


def _part_keys(part: str) -> list[str]:
    """Keys of a part, one per length it may have: the longest literal (at most four characters, ends included)."""
    runs = re.findall(LOST + "+", part)
    literal = max((x[:4] if x[0] == "^" else x[-4:] for x in f"^{part.lower()}$".split(LOST) if x.strip("^$")), key=len)
    known = sum(c != LOST for c in part.lower())
    return [f"{n} {literal}" for n in range(known + sum((len(r) + 2) // 3 for r in runs), known + sum(map(len, runs)) + 1)]


_KEY_CELLS = 1 << 22


def words_for_lost(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, word): the most frequent of all words of ``texts`` that fits each part with lost bytes, by a join on length and literal."""

    def keys(batches):
        for batch in batches:
            rows = [(p, k) for p in batch.column(0).to_pylist() for k in _part_keys(p)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.string()), pa.array([xxhash.xxh32_intdigest(k) % _KEY_CELLS for _, k in rows], pa.int32())], names=["part", "key", "cell"])

    keyed = stored(parts.distinct().mapInArrow(keys, "part string, key string, cell int"), "lost-keys")
    wanted = np.zeros(_KEY_CELLS, bool)
    wanted[keyed.select("cell").distinct().toArrow().column(0).to_numpy()] = True
    wanted = np.packbits(wanted).tobytes()

    def count(batches):
        for batch in batches:
            words: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(w for w in _WORD.findall(t.lower()) if not w.isascii())
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    def candidates(batches):
        for batch in batches:
            rows = []
            for i, w in enumerate(batch.column(0).to_pylist()):
                for g in _grams(f"^{w}$"):
                    k = f"{len(w)} {g}"
                    c = xxhash.xxh32_intdigest(k) % _KEY_CELLS
                    if wanted[c >> 3] >> (7 - (c & 7)) & 1:
                        rows.append((i, k))
            at = pa.array([i for i, _ in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for _, k in rows], pa.string())], names=["word", "n", "key"])

    def check(batches):
        for batch in batches:
            yield batch.filter(pa.array([fits(p, w) for p, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    words = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    pairs = keyed.select("part", "key").join(words.mapInArrow(candidates, "word string, n bigint, key string"), "key").select("part", "word", "n")
    return pairs.mapInArrow(check, "part string, word string, n bigint").groupBy("part").agg(F.max(F.struct("n", "word"))["word"].alias("word"))


class Restorer:
    """Finds and restores damaged tokens; verdicts are kept per worker in a bounded cache."""

    def __init__(self, freq: Frequencies, margin: float = 8.0):
        self.freq, self.margin, self.seen = freq, margin, {}

    def token(self, token: str, channel: str | None = None) -> tuple[str, str] | None:
        """The verdict on a token; one with lost bytes is decoded through ``channel`` first."""
        key = (token, channel) if LOST in token else token
        if key not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[key] = decode_lost(token, self.freq, self.margin, channel) or ("lost", token) if LOST in token else best_decoding(token, self.freq, self.margin)
        return self.seen[key]

    def damaged(self, text: str | None) -> bool:
        """Whether a text holds any wrongly decoded token."""
        if not text or text.isascii():
            return False
        return any(self.token(t) for t in dict.fromkeys(_TOKEN.findall(text)))

    def restore(self, text: str | None) -> tuple[str | None, str | None]:
        """(restored text, channels); (text, null) where nothing is damaged. Lost bytes of well-read tokens stay for :func:`fill_lost`."""
        if not text or text.isascii():
            return text, None
        used = {}
        ways = Counter(got[0] for t in _TOKEN.findall(text) if LOST not in t and (got := self.token(t))) if LOST in text else Counter()
        way = ways.most_common(1)[0][0] if ways else None

        def fix(m: re.Match) -> str:
            got = self.token(m.group(), way)
            if not got:
                return m.group()
            used[got[0]] = 1
            return got[1]

        out = _TOKEN.sub(fix, text)
        return out, " ".join(sorted(used)) or None


def texts_of(tables: list[tuple[DataFrame, Column]]) -> DataFrame:
    """All texts of several (table, column) pairs as one column."""
    out = None
    for df, col in tables:
        one = df.select(col.cast("string").alias("text"))
        out = one if out is None else out.unionAll(one)
    return out


def visible(df: DataFrame, id_col: str, html: str, title: Column) -> DataFrame:
    """(id, text): visible text and title of html pages."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                text = ["\n".join(x for x in (visible_text(h), t) if x) or None for h, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["rec_id", "text"])

    key = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("rec_id"), F.col(html).alias("h"), title.alias("t")).mapInArrow(run, f"rec_id {key}, text string")


def find_damaged(records: DataFrame, freq: Frequencies, margin: float = 8.0) -> DataFrame:
    """(tab, rec_id) of the records (tab, rec_id, text) that hold wrongly decoded text, once each."""

    def run(batches):
        restorer = Restorer(freq, margin)
        for batch in batches:
            hit = pa.array([restorer.damaged(t.as_py()) for t in batch.column(2)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["tab", "rec_id"])

    return records.select("tab", "rec_id", "text").mapInArrow(run, f"tab string, rec_id {records.schema['rec_id'].dataType.simpleString()}").distinct()


def restore_damaged(records: DataFrame, freq: Frequencies, margin: float = 8.0) -> DataFrame:
    """(tab, rec_id, text, restored, channels) of the damaged records, once each."""

    def run(batches):
        restorer = Restorer(freq, margin)
        for batch in batches:
            got = [restorer.restore(t.as_py()) for t in batch.column(2)]
            hit = pa.array([c is not None for _, c in got], pa.bool_())
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array([t for t, _ in got], pa.string()), pa.array([c for _, c in got], pa.string())]
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in cols], names=["tab", "rec_id", "text", "restored", "channels"])

    kind = f"tab string, rec_id {records.schema['rec_id'].dataType.simpleString()}, text string, restored string, channels string"
    damaged = stored(records.select("tab", "rec_id", "text").mapInArrow(run, kind).dropDuplicates(["tab", "rec_id", "text"]), "damaged")

    def parts(batches):
        for batch in batches:
            rows = [(t, p) for t in batch.column(0).to_pylist() for p in {p for x in _TOKEN.findall(t) for p in lost_parts(x)}]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(t.encode("utf-8", "replace")).hexdigest() for t, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string())], names=["digest", "part"])

    def fill(batches):
        for batch in batches:
            out = []
            for t, got in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                words = {x["part"]: x["word"] for x in got or []}
                out.append(_TOKEN.sub(lambda m: fill_lost(m.group(), freq, words) if LOST in m.group() else m.group(), t))  # noqa: B023
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string()), batch.column(4)], names=["tab", "rec_id", "text", "restored", "channels"])

    of_text = damaged.filter(F.contains("restored", F.lit(LOST))).select("restored").distinct().mapInArrow(parts, "digest string, part string")
    found = words_for_lost(of_text.select("part"), records.select("text"))
    filled = of_text.join(found, "part").groupBy("digest").agg(F.collect_list(F.struct("part", "word")).alias("fill"))
    return damaged.withColumn("digest", F.sha1("restored")).join(filled, "digest", "left").select("tab", "rec_id", "text", "restored", "channels", "fill").mapInArrow(fill, kind)
