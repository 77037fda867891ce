"""Noise in text from scanned pages.

Method: noisy-channel correction. Each word of a body line has as candidates the words of
the corpus that look alike once characters that scanners confuse are folded together; a
candidate's score is its channel probability, the product of the probabilities of its
confusions, times the likelihood of corpus words and word pairs, and Viterbi picks the best
words of each line. The probability of each confusion of characters is learned from the
corpus: words that only scans hold are aligned with the one frequent word of their look.
Words broken at a line's end are joined first; whether the hyphen belongs to the word is
decided by the counts of both spellings. Page marks, running headers and footers are found
by their place at page breaks, by recurrence within a document, and by the shapes of lines
that recur so across the corpus.

Word counts and pair counts cover all pages. Words, candidates and pairs are
joined, never collected; a document's own lines are the largest thing a task holds.

Defined cases: null, blank and repeated pages; documents of one page; pages without marks;
texts in scripts without case (no candidates); very long texts are one row like any other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.llm.near_sets import K2, K3
from actaloom.operators.texts import one_text
from actaloom.session import cut, spread, stored

#: Probability of one confusion where nothing is learned (also the largest), and the occurrences that this counts as;
#: weight of a scanned page's word against a clean one's, share of the pair model.
CONFUSION, PRIOR, SCANNED, PAIR = 0.05, 20, 0.05, 0.3
#: How many times as often as in all words a confusion may happen in one word.
SPREAD = 10.0
#: Weight of a word and its lead over the next one of its look that make it what a misread word was.
FREQUENT, LEAD = 20.0, 10.0
#: Pairs that count as much as the words' own weights.
EVEN = 100
#: Bits of the tables of words and pairs.
BITS = 1 << 23
#: A line of more characters and of more than this part of its document's width is a full line, no header.
NARROW, WIDTH = 60, 0.75
#: Page marks in succession that may be unreadable; lines that a page has besides its mark at least.
MISSING, BESIDE = 3, 3
#: Characters that scanners confuse, as the sequences they are folded into. Fixed values.
WIDE = {"m": "rri", "n": "ri", "u": "ii", "d": "ci", "h": "ii", "w": "vv"}
SAME = {"0": "o", "@": "a", "5": "s", "$": "s", "1": "i", "l": "i", "|": "i", "!": "i", "6": "b", "9": "c", "g": "c", "q": "c", "e": "c", "t": "f", "y": "v", "8": "b", "3": "3"}
HYPHENS = "-­¬‐‑"
ENDS = tuple(HYPHENS)
WORD = re.compile(r"[^\W_][\w@|]*(?:-[\w@|]+)*|@[\w@|]+(?:-[\w@|]+)*")
LETTER = re.compile(r"[^\W\d_]")
BROKEN = re.compile(rf"([^\W\d_][\w@|]*|[@\d][\w@|]*[^\W\d_][\w@|]*|[^\W_]+(?:-[\w@|]+)+)([{HYPHENS}])[^\S\n]*$")
ROMAN = r"(?=[ivxlc1y])[ivxlc1y]+"
NUM = r"[\dOolI|sSbB@]+"
MARK = re.compile(rf"^[\W_]*(?:(?P<word>p[áaà@4][gq9][\w@]*\.?|f[l1iI|][s5]?\.?|folha|page)\s*)?(?P<n>{NUM}|{ROMAN})(?:\s*(?:/|d[ec]|cl[ec]|of)\s*(?P<of>{NUM}|{ROMAN}))?[\W_]*$", re.I)


class Folds(dict):
    """Code point -> its look."""

    def __missing__(self, c: int) -> str:
        flat = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        self[c] = look = "".join(SAME.get(y, y) for x in flat for y in WIDE.get(x, x))
        return look


FOLDS = Folds()


def fold(word: str) -> str:
    """The look of a word: the same for a word and its misread forms."""
    return word.lower().translate(FOLDS)


#: Looks of several letters, by a letter that has that look; for each Latin-1 character its look or that letter, 0 where
#: neither is one of Latin-1; what has no such byte.
LETTERS = {look: x for x, look in WIDE.items()}
FLAT = bytes(ord(x) if len(x) == 1 and ord(x) < 256 else 0 for x in (LETTERS.get(FOLDS[c], FOLDS[c]) for c in range(256)))
ODD = re.compile(f"([^{re.escape(''.join(chr(c) for c in range(256) if FLAT[c]))}]+)")


def fold_lines(lines: list[str]) -> list[str]:
    """The looks of lines without line breaks; all but the odd characters are folded as bytes."""
    pieces = ODD.split("\n".join(lines).lower())
    flat = "\0".join(pieces[::2]).encode("latin-1").translate(FLAT)
    for look, x in LETTERS.items():
        flat = flat.replace(x.encode(), look.encode())
    pieces[::2] = flat.decode("latin-1").split("\0")
    pieces[1::2] = [x.translate(FOLDS) for x in pieces[1::2]]
    return "".join(pieces).split("\n") if lines else []


def shape(line: str) -> str:
    """A line's look with numbers and capitalised names left open."""
    s = re.sub(r"(?<![^\W\d_])\d[\d./-]*(?:[A-Z]+\b)?(?![^\W\d_])", "0", line.strip().strip("\f").strip())
    words = s.split()
    if s.isupper():  # in capitals throughout: the first words tell the kind of line
        words = [w if k < 3 or not re.search(r"[^\W\d_]", w) else w.lower() if len(w) < 3 else w.title() for k, w in enumerate(words)]
    caps = [w[:1].isupper() for w in words]
    kept = [w if k == 0 or not c or w.isupper() else "X" for k, (w, c) in enumerate(zip(words, caps))]
    return fold(re.sub(r"(?:X(?: (?:d|cl)[aoec@0]s?)? ?)+", "X ", " ".join(kept)).strip())


def marks(lines: list[str]) -> dict[int, str]:
    """Lines that hold a page mark only, by their index. Marks of one style count on from page to page."""
    by_style: dict[str, list[tuple[int, int, bool]]] = {}
    for i, line in enumerate(lines):
        s = line.strip().strip("\f").strip()
        if not s or not (m := MARK.match(s)):
            continue
        n, word = m.group("n"), (m.group("word") or "").lower()
        if not any(c.isdigit() for c in s) and not word and not re.fullmatch(rf"[\W_]*{ROMAN}[\W_]*", s.lower()) and not m.group("of"):
            continue
        digits = n.translate(str.maketrans("OolI|sSbB@", "0011155660"))
        value = int(digits) if digits.isdigit() else roman(n.lower().replace("1", "i").replace("y", "v"))
        of = (m.group("of") or "").translate(str.maketrans("OolI|sSbB@", "0011155660"))
        if of.isdigit() and value > int(of):
            continue
        year = not word and of.isdigit() and int(of) > 999  # may be the number of a case: only a row of them is sure
        sure = not year and bool(word or m.group("of")) or s[0] in "[-—–(" and s[-1] in "])-—–"
        if not sure and (not s[-1].isalnum() or not s[0].isalnum()):
            continue
        plain = "roman" if re.search("[ivxy]", n.lower()) else "#"
        style = (word[:1] + ("/" if m.group("of") else "") + (of if year else "") + (s[0] if not s[0].isalnum() else "")) or plain
        by_style.setdefault(style, []).append((i, value, sure))
    out: dict[int, str] = {}
    for style, found in by_style.items():
        if any(f[2] for f in found):
            out |= {i: style for i, _, _ in found}
            continue
        best: list[tuple[int, int, bool]] = []  # the longest row of marks that counts up by one from 1
        for f in found:
            if f[1] == (best[-1][1] + 1 if best else 1):
                best.append(f)
        full = [i for i, line in enumerate(lines) if line.strip()]
        rising = rising_row(found, full)
        if len(rising) > max(2, len(best)):
            out |= dict.fromkeys(rising, style)
        elif len(best) >= 2 or best and best[0][0] in {*full[:3], *full[-3:]}:
            out |= {i: style for i, _, _ in best}
    return out


def rising_row(found: list[tuple[int, int, bool]], full: list[int]) -> list[int]:
    """Lines of the longest row of marks that rises from any number, unreadable ones left out.

    Between two marks of a row lies a page: numbers on lines that stand together, as in a
    table, are no row. full: the lines that are not blank.
    """
    nth = {i: k for k, i in enumerate(full)}
    length: list[int] = []
    before: list[int] = []
    last: dict[int, list[int]] = {}  # number -> its marks
    for k, (i, value, _) in enumerate(found):
        near = [j for v in range(value - MISSING - 1, value) for j in last.get(v, ()) if nth[i] - nth[found[j][0]] > BESIDE * (value - v)]
        at = max(near, key=lambda j: (length[j], found[j][1], j), default=-1)
        length.append(length[at] + 1 if near else 1)
        before.append(at)
        held = last.setdefault(value, [])
        if not held or length[k] > max(length[j] for j in held):
            held.append(k)
    at = max(range(len(found)), key=lambda k: (length[k], -k), default=-1)
    row = []
    while at >= 0:
        row.append(found[at][0])
        at = before[at]
    return row[::-1]


def roman(s: str) -> int:
    values, total = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0
    for a, b in zip(s, s[1:] + " "):
        total += -values.get(a, 0) if values.get(b, 0) > values.get(a, 0) else values.get(a, 0)
    return total


def zones(lines: list[str], found: dict[int, str]) -> dict[int, int]:
    """Lines beside a page break, with the number of the break: up to three before and after it, blank ones not counted."""
    full = [i for i, line in enumerate(lines) if line.strip() and i not in found]
    breaks = sorted({-1, len(lines), *found, *(i for i, line in enumerate(lines) if "\f" in line)})
    out: dict[int, int] = {}
    for k, at in enumerate(breaks):
        feed = 0 <= at < len(lines) and at not in found
        before = [i for i in full if i < at][-3:]
        after = [i for i in full if i > at or feed and i == at][:3]
        for i in before + after:
            out.setdefault(i, k)
    return out


def layout(pages: DataFrame) -> DataFrame:
    """(rel, line_no, role, shape, again, often): page marks, lines beside a page break, and short lines that recur in their document.

    again: the line recurs; often: it is no full line and recurs beside most page breaks of its
    document, or three times and more where no page break was found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, int, str, str, bool, bool]] = []
            for rel, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = text.split("\n")
                found = marks(lines)
                rows += [(rel, i + 1, "page_number", "", False, False) for i in found]
                zone = zones(lines, found)
                brief = [i for i, line in enumerate(lines) if i not in found and line.strip()]
                widths = sorted(len(lines[i].strip()) for i in brief)
                full = max(NARROW, WIDTH * widths[len(widths) * 9 // 10]) if widths else NARROW
                looks = dict(zip(brief, fold_lines([" ".join(lines[i].split()) for i in brief])))
                count = Counter(looks.values())
                at: dict[str, set[int]] = {}
                for i, k in zone.items():
                    if i in looks:
                        at.setdefault(looks[i], set()).add(k)
                most = max(2, 0.6 * (len(set(zone.values())) - 2))
                for i, look in looks.items():
                    narrow = len(lines[i].strip()) <= full
                    if i in zone or narrow and count[look] > 1 and len(look) > 5:
                        often = narrow and len(at[look]) >= most if i in zone else count[look] >= 3 and lines[i].rstrip()[-1] not in ".,;:"
                        rows.append((rel, i + 1, "zone" if i in zone else "inner", shape(lines[i]), count[look] > 1, often))
            cols = list(zip(*rows)) or [[], [], [], [], [], []]
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rel", "line_no", "role", "shape", "again", "often"])

    return pages.mapInArrow(run, "rel string, line_no bigint, role string, shape string, again boolean, often boolean")


def furniture(pages: DataFrame) -> DataFrame:
    """(rel, line_no, kind): header, footer and page-mark lines of all pages."""
    rows = cut(layout(pages))
    lines = rows.filter(F.col("role") != "page_number")
    often = lines.filter("often").groupBy("shape").agg(F.count_distinct("rel").alias("docs"))
    usual = often.join(lines.filter("role = 'zone'").groupBy("shape").agg(F.count_distinct("rel").alias("all")), "shape").filter((F.col("docs") >= 3) & (F.col("docs") >= 0.3 * F.col("all"))).select("shape", F.lit(True).alias("usual"))
    judged = lines.join(usual, "shape", "left")
    headers = judged.filter(F.col("often") | F.col("usual")).select("rel", "line_no", F.lit("header").alias("kind"))
    return headers.unionByName(rows.filter(F.col("role") == "page_number").select("rel", "line_no", F.lit("page_number").alias("kind")))


#: ASCII characters that no word has, but the line's end, as blanks.
BLANKS = bytes(c if c > 127 or c == 10 or chr(c).isalnum() or chr(c) in "_@|-" else 32 for c in range(256))


def bare(text: str) -> bytes:
    """A text in lower case as UTF-8 with BLANKS; its words are the same, and fewer things stand between the blanks."""
    return text.lower().encode().translate(BLANKS)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column of texts: words, and hyphenated words also as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()  # of what stands between blanks; words are taken from each only once
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    count.update(bare(t).split())
            if len(count) > 500_000:
                yield emit(count)
                count.clear()
        yield emit(count)

    def emit(count: Counter[bytes]) -> pa.RecordBatch:
        full: Counter[str] = Counter()
        for token, n in count.items():
            for w in WORD.findall(token.decode()):
                if not w.isdigit() and LETTER.search(w):
                    full[w] += n
                    if "-" in w:
                        for part in w.split("-"):
                            full[part] += n
        return pa.RecordBatch.from_arrays([pa.array(list(full), pa.string()), pa.array(list(full.values()), pa.int64())], names=["word", "n"])

    return spread(texts).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def parts_of(text: str) -> list[str]:
    """The words of a line in lower case, hyphenated ones in their parts; numbers are none."""
    return [p for w in WORD.findall(text.lower()) for p in w.split("-") if p and not p.isdigit()]


class Tokens(dict):
    """What stands between blanks, see bare -> the 64-bit hashes of its words but numbers, as bytes; a line's end has the hash 0."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[int, str] = {}
        self.restart()

    def restart(self) -> None:
        """Forgets all tokens and words but the line's end, so that what is held stays bounded."""
        self.clear()
        self.words.clear()
        self.update({b"\n": bytes(8), b"": b""})

    def __missing__(self, token: bytes) -> bytes:
        raw = b""
        for p in parts_of(token.decode()):
            h = HASHES[p]
            self.words[h] = p
            raw += h.to_bytes(8, "little")
        self[token] = raw
        return raw


def known_pairs(text: str, table: np.ndarray, tokens: Tokens) -> dict[tuple[str, str], int]:
    """How often each pair of words, see parts_of, stands within the lines of a text, of those that a bit table may hold."""
    if len(tokens) > 300_000:
        tokens.restart()
    h = np.frombuffer(b"".join(map(tokens.__getitem__, bare(text).replace(b"\n", b" \n ").split(b" "))), np.uint64)
    a, b = h[:-1], h[1:]
    bits = pair_bits(a, b)
    hits = np.flatnonzero(table[bits >> 3] >> (bits & 7).astype(np.uint8) & 1)
    hits = hits[(a[hits] != 0) & (b[hits] != 0)]
    pairs = np.stack([a[hits], b[hits]], 1)
    ids, first, n = np.unique(a[hits] * K2 + b[hits] * K3, return_index=True, return_counts=True)  # 64 bits, as the words' hashes are
    words = tokens.words
    return {(words[x], words[y]): k for (x, y), k in zip(pairs[first].tolist(), n.tolist())}


@lru_cache(100_000)
def pieces(a: str, b: str) -> tuple[tuple[str, str], ...]:
    """The confusions between a read word and the one meant, of the same look: (read, meant) of each piece that differs.

    The words are cut wherever both looks are cut between letters.
    """
    ends = []
    for w in (a, b):
        at, out = 0, {}
        for k, c in enumerate(w):
            at += len(fold(c))
            out[at] = k + 1  # marks without a look of their own belong to the letter before
        ends.append(out)
    i = j = 0
    out = []
    for at in sorted(ends[0].keys() & ends[1].keys()):
        x, y = a[i : ends[0][at]], b[j : ends[1][at]]
        if x != y:
            out.append((x, y))
        i, j = ends[0][at], ends[1][at]
    return tuple(out)


def edits(a: str, b: str) -> int:
    """Number of confusions: a piece that differs is one if a single letter is read as it or for it, else three."""
    return 0 if a == b else max(1, sum(1 if min(len(x), len(y)) <= 1 else 3 for x, y in pieces(a, b)))


class Channel(dict):
    """(read, meant) -> the logarithm of the probability that the word `meant` is read as `read`, kept once computed.

    counts: how often a piece was read as another; held: how often scanned pages have a piece.
    """

    def __init__(self, counts: dict[tuple[str, str], int] | None = None, held: dict[str, int] | None = None) -> None:
        super().__init__()
        self.counts, self.held = counts or {}, held or {}

    def piece(self, x: str, y: str) -> float:
        n = self.counts.get((x, y), 0)
        p = min(CONFUSION, (n + PRIOR * CONFUSION) / (max(n, self.held.get(y, 0)) + PRIOR))
        return math.log(p) * (1 if min(len(x), len(y)) <= 1 else 3)

    def __missing__(self, words: tuple[str, str]) -> float:
        if len(self) > 300_000:
            self.clear()
        self[words] = cost = 0.0 if words[0] == words[1] else min(math.log(CONFUSION), sum(self.piece(x, y) for x, y in pieces(*words)))
        return cost


def learn_channel(first: DataFrame, scans: DataFrame) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """What Channel is made of, from all words of the scanned pages.

    A word that clean pages hardly have and whose look has one frequent word, well ahead of the
    others, was meant as that word. How often a piece was read wrongly is divided by how often
    scanned pages have it. Only confusions with a single letter on one side are learned; there
    are at most a few thousand of them, the only thing that comes to the driver.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[tuple[str, str]] = Counter()
            for word, n, meant in zip(*(c.to_pylist() for c in b.columns)):
                for x, y in pieces(word, meant):
                    if min(len(x), len(y)) <= 1 and len(x) <= 3 and len(y) <= 3:
                        count[x, y] += n
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in count], pa.string()), pa.array([p[1] for p in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["read", "meant", "n"])

    lead = F.when(F.size("opts") > 1, F.col("opts")[1]["weight"]).otherwise(F.lit(0.0))
    clear = first.filter((F.size("opts") > 0) & (F.col("own") < 1) & (F.col("opts")[0]["cand"] != F.col("word")) & (F.col("opts")[0]["weight"] >= FREQUENT) & (F.col("opts")[0]["weight"] >= LEAD * lead))
    found = clear.join(scans, "word").select("word", "n", F.col("opts")[0]["cand"].alias("meant")).mapInArrow(aligned, "read string, meant string, n bigint")
    rows = found.groupBy("read", "meant").agg(F.sum("n").alias("n")).filter("n > 1").collect()
    wanted = sorted({r["meant"] for r in rows if len(r["meant"]) > 1})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for b in batches:
            for word, n in zip(*(c.to_pylist() for c in b.columns)):
                for p in word:
                    count[p] += n
                for p in wanted:
                    if p in word:
                        count[p] += n * word.count(p)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["piece", "n"])

    held = scans.select("word", "n").mapInArrow(present, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # letters and such pieces
    return {(r["read"], r["meant"]): r["n"] for r in rows}, {r["piece"]: r["n"] for r in held}


class Hashes(dict):
    """Word -> 64-bit hash, NUMBER for a number, which is no word of a pair; emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = int(NUMBER) if word.isdigit() else xxhash.xxh3_64_intdigest(word) | 1
        return h


NUMBER = np.uint64(2)
HASHES = Hashes()


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def pair_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * K2 + b * K3) >> np.uint64(64 - 23)).astype(np.int64)  # both are hashes; BITS = 2^23


def bit(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BITS


def bit_table(rows: DataFrame) -> np.ndarray:
    """A table of BITS bits (1 MB) of rows of one or two words: what is not in it is certainly not among the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            at = set(map(bit, *cols)) if len(cols) == 1 else set(pair_bits(*map(hashes, cols)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32())], names=["at"])

    at = rows.mapInArrow(run, "at int").distinct().toPandas()["at"].to_numpy(np.int64)
    table = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return table


class Known(dict):
    """What stands between blanks, see bare -> whether a bit table may hold one of its words."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, key: bytes) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[key] = found = any(self.table[at >> 3] >> (at & 7) & 1 for at in map(bit, parts_of(key.decode())))
        return found


LINES = "rel string, line_no bigint, words array<string>, from_line array<bigint>, broken array<string>"


def body_lines(pages: DataFrame, doubtful: np.ndarray) -> DataFrame:
    """Lines of running text that end in a broken word or have a word of the bit table, see LINES. pages: (rel, text, skip).

    words: the line's words; a word broken at the end stands joined with its rest, which the
    line of the rest leaves out, and in its two parts. from_line: the line that a joined
    word's rest lies on, minus the line of a part, or 0. broken: the joined and the hyphenated
    spelling, left part and sign of the broken word, or empty.
    """

    shared = pages.sparkSession.sparkContext.broadcast(doubtful)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for b in batches:
            out: list[tuple] = []
            for rel, text, skip in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines, left_out = text.split("\n"), set(skip or [])
                body = [i for i, line in enumerate(lines) if line.strip() and i + 1 not in left_out]
                carried = ""
                for k, i in enumerate(body):
                    line = lines[i]
                    if carried:
                        line = line.lstrip()[len(carried) :]
                        carried = ""
                    broken = []
                    m = BROKEN.search(line) if line.rstrip()[-1:] in ENDS else None
                    head = line[: m.start()] if m else line
                    if m and k + 1 < len(body):
                        rest = re.match(r"[\w@|]+(?:-[\w@|]+)*", lines[body[k + 1]].lstrip())
                        if rest and rest.group()[0].islower() or rest and rest.group()[0] in "@0156":
                            carried = rest.group()
                            joined = (m.group(1) + carried).lower()
                            broken = [joined, f"{m.group(1)}-{carried}".lower(), m.group(1).lower(), m.group(2)]
                    if m and not broken:
                        head = f"{head} {m.group(1)}"
                    if not broken and not any(map(known.__getitem__, bare(head).split())):
                        continue
                    words = parts_of(head)
                    where = [0] * len(words)
                    if broken:
                        rest_parts = parts_of(carried)
                        words += [broken[0], *parts_of(m.group(1)), *rest_parts]
                        where += [body[k + 1] + 1] + [-(i + 1)] * len(parts_of(m.group(1))) + [-(body[k + 1] + 1)] * len(rest_parts)
                    out.append((rel, i + 1, words, where, broken))
            cols = list(zip(*out)) or [[], [], [], [], []]
            types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rel", "line_no", "words", "from_line", "broken"])

    return pages.mapInArrow(run, LINES)


def looks(words: DataFrame) -> DataFrame:
    """words with the look of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([fold(w) for w in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "look"])

    return words.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in words.dtypes) + ", look string")


#: What a word without options adds to the likelihood of a line.
SURE = math.log(1 - PAIR + PAIR + 1e-12)


def decode(words: list[str], options: dict[str, dict[str, float]], pairs: dict[tuple[str, str], int], channel: Channel) -> list[str]:
    """The most likely words of a line, by Viterbi over the options of its doubtful words.

    options: doubtful word -> weight of each word it may stand for, itself included; a word
    without options stands for itself. The likelihood of an option mixes its share of the
    weights with its share of the pairs that the word before it forms.
    """
    score = {"": 0.0}
    back: list[dict[str, str]] = []
    for w in words:
        opts = options.get(w)
        if not opts:  # all pairs with the words before it have the share 1
            who = max(score, key=score.__getitem__)
            back.append({w: who})
            score = {w: score[who] + SURE}
            continue
        total, now, came = sum(opts.values()) or 1.0, {}, {}
        follow = {p: sum(pairs.get((p, c), 0) for c in opts) for p in score}
        for c, n in opts.items():
            best, who = -1e18, ""
            for p, s in score.items():
                pair = (pairs.get((p, c), 0) + EVEN * n / total) / (follow[p] + EVEN)
                s += math.log((1 - PAIR) * n / total + PAIR * pair + 1e-12)
                if s > best:
                    best, who = s, p
            now[c], came[c] = best + channel[w, c], who
        back.append(came)
        score = now
    out: list[str] = []
    at = max(score, key=lambda c: (score[c], c)) if words else ""
    for came in reversed(back):
        out.append(at)
        at = came[at]
    return out[::-1]


def records(lists: pa.ListArray) -> Iterator[list[tuple]]:
    """Each list of records as tuples; a null is an empty list."""
    rows = list(zip(*(c.to_pylist() for c in lists.flatten().flatten())))
    at = 0
    for n in lists.value_lengths().fill_null(0).to_pylist():
        yield rows[at : at + n]
        at += n


def own_weight(word: str, own: float, clean: bool, options: dict[str, float], channel: Channel) -> float:
    """The weight of a word as it stands. What misreading its options explains speaks for no word of its own, unless clean pages have it."""
    if re.search(r"[\d@|]", word):  # signs and digits within a word make it hardly one
        return 1e-3
    explained = 0.0 if clean else SPREAD * sum(n * math.exp(channel[word, c]) for c, n in options.items() if c != word)
    return max(1e-3, own - explained)


def scan_noise(pages: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, repairs) of scanned pages. pages: all (rel, text); scanned: (rel) of the scanned ones.

    cases: (rel_raw, line_no, kind), kinds header, page_number, hyphen, char. repairs: (rel,
    line_no, words, right), the body lines' words in lower case with their decoded forms.
    """
    found = stored(pages.join(scanned, "rel", "left_semi").filter(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]")), "scans-found")
    own = stored(one_text(found, "rel", "text").dropDuplicates(["rel"]).select("rel", "text"), "scans")
    own = spread(own)
    around = stored(furniture(own), "furniture")
    skip = around.groupBy("rel").agg(F.collect_set("line_no").alias("skip"))
    every = word_counts(pages.select("text"))
    scans = stored(word_counts(own.select("text")), "scan-words")
    model = every.withColumnRenamed("n", "all").join(scans, "word", "left").select("word", (F.greatest(F.col("all") - F.coalesce("n", F.lit(0)), F.lit(0)) + F.least(F.coalesce("n", F.lit(0)), F.col("all")) * SCANNED).alias("weight"), (F.col("all") > F.coalesce("n", F.lit(0))).alias("clean"))
    model = stored(looks(model), "words")
    first = stored(options_of(scans.filter(~F.col("word").contains("-")).select("word"), model), "looks")
    learned = own.sparkSession.sparkContext.broadcast(learn_channel(first, scans))
    lines = stored(body_lines(own.join(skip, "rel", "left").select("rel", "text", "skip"), bit_table(first.filter(DOUBT).select("word"))), "lines")

    joined = lines.filter(F.size("broken") > 0).select(F.col("broken")[0].alias("word"), F.col("broken")[1].alias("whole"))
    options = stored(options_of(lines.select(F.explode("words").alias("word")).distinct(), model), "options")
    doubtful = options.filter(DOUBT)
    tokens = lines.select("rel", "line_no", F.posexplode("words").alias("at", "word"))
    choice = tokens.join(doubtful, "word").select("rel", "line_no", "word", "own", "clean", F.explode("opts").alias("o"))
    opts = choice.groupBy("rel", "line_no").agg(F.collect_set(F.struct("word", "own", "clean", F.col("o.cand").alias("cand"), F.col("o.weight").alias("weight"))).alias("opts"))
    near = pair_counts(pages, own, tokens, opts.select("rel", "line_no"), doubtful)
    ready = lines.join(opts, ["rel", "line_no"]).join(near, ["rel", "line_no"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(*learned.value)
        for b in batches:
            right = []
            for words, found, pairs in zip(b.column(2).to_pylist(), records(b.column(4)), records(b.column(5))):
                table: dict[str, dict[str, float]] = {}
                held: dict[str, tuple[float, bool]] = {}
                for word, own, clean, cand, weight in found:
                    table.setdefault(word, {})[cand] = weight
                    held[word] = own, clean
                for word, (own, clean) in held.items():
                    table[word][word] = own_weight(word, own, clean, table[word], channel)
                right.append(decode(words, table, {(x, y): n for x, y, n in pairs}, channel))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(right, pa.list_(pa.string()))], names=["rel", "line_no", "words", "from_line", "right"])

    repairs = stored(ready.select("rel", "line_no", "words", "from_line", "opts", "pairs").mapInArrow(run, "rel string, line_no bigint, words array<string>, from_line array<bigint>, right array<string>"), "repairs")
    wrong = repairs.select("rel", "line_no", F.explode(F.arrays_zip("words", "from_line", "right")).alias("w")).filter(F.col("w.words") != F.col("w.right"))

    breaks = hyphens(lines, model)
    broken = lines.filter(F.size("broken") > 0).select("rel", "line_no", F.length(F.col("broken")[2]).alias("left"))
    placed = wrong.join(broken, ["rel", "line_no"], "left").join(breaks.withColumn("joined", F.lit(True)), ["rel", "line_no"], "left")
    placed = placed.filter((F.col("w.from_line") == 0) | ((F.col("w.from_line") > 0) == F.coalesce("joined", F.lit(False)))).withColumn("first", same_start("w.words", "w.right"))
    on_next = (F.col("w.from_line") > 0) & (F.col("first") >= F.col("left"))
    line = F.when(on_next, F.col("w.from_line")).when(F.col("w.from_line") < 0, -F.col("w.from_line")).otherwise(F.col("line_no"))
    char = placed.select("rel", line.alias("line_no"), F.lit("char").alias("kind"))
    cases = around.select("rel", "line_no", "kind").union(breaks.select("rel", "line_no", F.lit("hyphen").alias("kind"))).union(char)
    firm = cases.join(around.select("rel", "line_no", F.lit(True).alias("furniture")), ["rel", "line_no"], "left").filter(F.col("furniture").isNull() | F.col("kind").isin("header", "page_number"))
    return firm.select(F.col("rel").alias("rel_raw"), "line_no", "kind").distinct(), repairs


#: A word of which another word may be the true form. This prunes what Viterbi decides on: what is left out
#: has less than 0.02 of the word's own weight even at the largest probability that a confusion has.
DOUBT = f"exists(opts, o -> o.cand <> word and o.weight * {CONFUSION} > own * 0.02)"


def options_of(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word, opts, own, clean): all words of the same look with their weights, heaviest first, the word's own weight, and whether clean pages have it."""
    proper = model.filter(~F.col("word").rlike(r"[\d@|]") & (F.length("word") > 2))  # only plain words can be meant
    cands = looks(words).join(proper.select("look", F.col("word").alias("cand"), "weight"), "look")
    options = cands.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("weight", "cand")), asc=False).alias("opts"))
    return words.join(options, "word", "left").join(model.select("word", F.col("weight").alias("own"), "clean"), "word", "left").select("word", "opts", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("clean", F.lit(False)).alias("clean"))


def same_start(a: str, b: str) -> F.Column:
    """Number of characters that two columns share at their start."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(F.col(a), i, F.lit(1)) == F.substr(F.col(b), i, F.lit(1))), i).otherwise(acc))


def pair_counts(pages: DataFrame, scans: DataFrame, tokens: DataFrame, asked: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(rel, line_no, pairs): weights in all pages of the word pairs that the doubtful words' candidates may form in each line.

    Pairs of scanned pages weigh as little as their words do, so that a misreading does not
    speak for itself. Pairs that are in no page have no row.
    """
    line = tokens.join(asked, ["rel", "line_no"], "left_semi").join(doubtful.select("word", F.transform("opts", lambda o: o["cand"]).alias("cands")), "word", "left")
    choice = line.select("rel", "line_no", "at", F.explode(F.array_union(F.coalesce("cands", F.array().cast("array<string>")), F.array("word"))).alias("w"), F.col("cands").isNotNull().alias("open"))
    a, b = choice.alias("x"), choice.select("rel", "line_no", (F.col("at") - 1).alias("at"), F.col("w").alias("v"), F.col("open").alias("open_v")).alias("y")
    may = stored(a.join(b, ["rel", "line_no", "at"]).filter("open or open_v").select("rel", "line_no", F.col("w").alias("a"), F.col("v").alias("b")).filter(~F.concat("a", "b").rlike(r"[\d@|]")).distinct(), "pairs")
    shared = scans.sparkSession.sparkContext.broadcast(bit_table(may.select("a", "b").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count, tokens = shared.value, Counter(), Tokens()
        for b in batches:
            held, size = [], 0
            for t in b.column(0).to_pylist():
                held.append(t or "")
                size += len(held[-1])
                if size > 200_000:
                    count.update(known_pairs("\n".join(held), table, tokens))
                    held, size = [], 0
            count.update(known_pairs("\n".join(held), table, tokens))
            if len(count) > 500_000:
                yield emit(count)
                count.clear()
        yield emit(count)

    def emit(count: Counter[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in count], pa.string()), pa.array([p[1] for p in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["a", "b", "n"])

    def counts(texts: DataFrame, name: str) -> DataFrame:
        return spread(texts).mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias(name))

    every, own = counts(pages.select("text"), "all"), F.coalesce("own", F.lit(0))
    corpus = every.join(counts(scans.select("text"), "own"), ["a", "b"], "left")
    corpus = corpus.select("a", "b", (F.greatest(F.col("all") - own, F.lit(0)) + F.least(own, "all") * SCANNED).alias("n"))
    return may.join(corpus, ["a", "b"]).groupBy("rel", "line_no").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))


def hyphens(lines: DataFrame, model: DataFrame) -> DataFrame:
    """(rel, line_no): lines whose last word is broken only because the line ended.

    The weights of both spellings decide, each among words with or without a hyphen as it is
    itself; if neither is known, the hyphen belongs to the word only if both sides are words.
    """
    b = lines.filter(F.size("broken") > 0).select("rel", "line_no", F.col("broken")[0].alias("joined"), F.col("broken")[1].alias("whole"), F.col("broken")[2].alias("left"))
    both = b.select("joined", "whole", "left").distinct()
    spelled = looks(both.select(F.col("joined").alias("word")).union(both.select("whole")).distinct())
    weight = model.groupBy("look", F.col("word").contains("-").alias("dash")).agg(F.sum("weight").alias("weight"))
    known = spelled.withColumn("dash", F.col("word").contains("-")).join(weight, ["look", "dash"]).select("word", "weight")
    judged = both.join(known.select(F.col("word").alias("joined"), F.col("weight").alias("one")), "joined", "left").join(known.select(F.col("word").alias("whole"), F.col("weight").alias("two")), "whole", "left")
    sides = judged.select("joined", "whole", F.coalesce("one", F.lit(0.0)).alias("one"), F.coalesce("two", F.lit(0.0)).alias("two"), F.element_at(F.split("left", "-"), -1).alias("p"), F.split(F.expr("substring(whole, length(left) + 2)"), "-")[0].alias("q"))
    seen = model.filter(F.col("weight") >= 1).select(F.col("word").alias("p"), F.lit(True).alias("has_p"))
    sides = sides.join(seen, "p", "left").join(seen.withColumnRenamed("p", "q").withColumnRenamed("has_p", "has_q"), "q", "left")
    ends = sides.filter((F.col("one") > F.col("two")) | ((F.col("one") == F.col("two")) & (F.col("has_p").isNull() | F.col("has_q").isNull()))).select("joined", "whole").distinct()
    return b.join(ends, ["joined", "whole"], "left_semi").select("rel", "line_no")


def clean_text(pages: DataFrame, cases: DataFrame, repairs: DataFrame) -> DataFrame:
    """(rel_raw, text): each page once, without header and page-mark lines, words joined and repaired, one line a paragraph.

    A new paragraph begins after an empty line or at an indented line. pages: (rel, text);
    cases and repairs: see scan_noise. Null and blank pages stay as they are.
    """
    by_kind = cases.groupBy("rel_raw").agg(F.collect_list(F.struct("line_no", "kind")).alias("cases")).withColumnRenamed("rel_raw", "rel")
    changed = repairs.select("rel", "line_no", F.explode(F.arrays_zip("words", "right")).alias("w")).filter(F.col("w.words") != F.col("w.right"))
    right = changed.groupBy("rel").agg(F.collect_set(F.struct("line_no", F.col("w.words").alias("wrong"), F.col("w.right").alias("right"))).alias("repairs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, found, fixes in zip(b["text"], b["cases"], b["repairs"]):
                out.append(text if text is None or not text.strip() else paragraphs(text, found if found is not None else [], fixes if fixes is not None else []))
            yield pd.DataFrame({"rel_raw": b["rel"], "text": out})

    rows = one_text(pages, "rel", "text").dropDuplicates(["rel"]).join(by_kind, "rel", "left").join(right, "rel", "left")
    return rows.select("rel", "text", "cases", "repairs").mapInPandas(run, "rel_raw string, text string")


def paragraphs(text: str, cases: list, fixes: list) -> str:
    out: list[str] = []
    kinds: dict[int, set[str]] = {}
    for c in cases:
        kinds.setdefault(c["line_no"], set()).add(c["kind"])
    words: dict[int, dict[str, str]] = {}
    for f in fixes:
        words.setdefault(f["line_no"], {})[f["wrong"]] = f["right"]
    new, joined, pending = True, False, {}
    for n, line in enumerate(text.split("\n"), 1):
        if kinds.get(n, set()) & {"header", "page_number"}:
            continue
        if not line.strip():
            new = True
            continue
        body = line.strip().strip("\f").strip()
        if out and joined:
            out[-1] += body
        elif out and not new and not line.lstrip("\f").startswith("  "):
            out[-1] += " " + body
        else:
            out.append(body)
        here = words.get(n, {})
        for wrong, right in [*pending.items(), *here.items()]:
            out[-1] = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda m: cased(m.group(), right), out[-1], flags=re.I)  # noqa: B023
        joined = "hyphen" in kinds.get(n, set())
        pending = here if joined else {}
        if joined:
            out[-1] = out[-1].rstrip(HYPHENS)
        elif out[-1][-1] in HYPHENS and out[-1][-2:-1].isalpha():
            out[-1], joined = out[-1][:-1] + "-", True  # the hyphen belongs to the word
        new = False
    return "\n\n".join(out)


def cased(like: str, word: str) -> str:
    """word in the case of the text that it replaces."""
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word
