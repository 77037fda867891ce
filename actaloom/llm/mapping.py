"""Mapping of freely typed values to a canonical list.

Method: an Aho-Corasick automaton over the canonical names and their aliases finds
mentions inside each value; the longest mentions that do not overlap win. Values without
one go to token-set similarity, in two views of a value. As a set of words: words are paired
with the words of each name by their likeness (swapped, doubled, lost and wrong letters,
abbreviations before a full stop). As a set of letter pairs of the value without its blanks:
blanks that are lost or misplaced leave nearly all of the pairs. The better view decides.

Both views go through an index, so that a value is compared only with names that share
something with it: words of the list that a word is like (looked up once for each distinct
word), and names by letter pair. The automaton and the index hold the reference list, which
is bounded: more than `MAX_NAMES` names and aliases raise an error. Only distinct values pass
through Python.

Defined cases: null and blank values have no row in the distinct map; a value of signs only,
or like no entry, gives `unmapped`; of equally good entries the one of the lowest name
wins; a value naming two entries goes to the longer mention.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMAPPED = "unmapped"
MAX_NAMES = 100_000
#: Words that carry no meaning of their own in the names of the list.
STOP = {"a", "o", "as", "os", "e", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "por", "ao", "para", "com", "the", "of", "and", "in"}
#: Words of these letters in whatever order are such words, swapped.
SWAPPED = {"".join(sorted(w)) for w in STOP if len(w) > 1}
#: Similarity that a value must reach, by its letter pairs, by its words, and by its words if
#: each has a partner on the other side; likeness of two words that may be one.
PAIRS, TOKENS, ALL, LIKE = 0.62, 0.80, 0.66, 0.6


def fold(value: str) -> str:
    """Lower-cased words without accents, signs and encoding damage, single blanks between."""
    try:
        value = value.encode("latin-1").decode("utf-8")  # UTF-8 read as Latin-1
    except UnicodeError:
        try:
            value = value.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    flat = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w.]|_", " ", flat).split())


@functools.lru_cache(maxsize=100_000)
def letters(a: str) -> int:
    """The set of a's characters as bits."""
    bits = 0
    for c in a:
        bits |= 1 << (ord(c) & 63)
    return bits


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if a == b:
        return 0
    x, y = letters(a), letters(b)
    if abs(len(a) - len(b)) > most or (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


@functools.lru_cache(maxsize=300_000)
def likeness(a: str, b: str) -> float:
    size = max(len(a), len(b))
    return 1 - distance(a, b, int(size * 0.4)) / size if size else 0.0


def letter_pairs(squeezed: str) -> Counter[str]:
    """The pairs of neighbouring letters, its ends marked."""
    s = f"^{squeezed}$"
    return Counter(s[k : k + 2] for k in range(len(s) - 1))


class Mapper:
    """names: (folded name or alias, entry), any number an entry."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.names: dict[str, str] = {}
        for name, entry in sorted(names):
            if name:
                self.names.setdefault(name.replace(".", ""), entry)
        self.auto = ahocorasick.Automaton()
        for name, entry in self.names.items():
            self.auto.add_word(f" {name} ", (len(name) + 2, entry))
        self.auto.make_automaton()
        self.parts = [([w for w in name.split() if w not in STOP] or name.split(), entry) for name, entry in sorted(self.names.items())]
        self.of_word: dict[str, list[int]] = {}
        self.of_pair: dict[str, tuple[list[int], list[int]]] = {}
        self.sizes = np.zeros(len(self.parts))
        for k, (name, _) in enumerate(sorted(self.names.items())):
            for w in set(self.parts[k][0]):
                self.of_word.setdefault(w, []).append(k)
            for p, n in letter_pairs(name.replace(" ", "")).items():
                at, counts = self.of_pair.setdefault(p, ([], []))
                at.append(k)
                counts.append(n)
                self.sizes[k] += n
        self.words = sorted(self.of_word)
        self.bits = np.array([letters(w) for w in self.words], np.uint64)
        self.long = np.array([len(w) for w in self.words], np.int64)
        self.pairs = {p: (np.array(a), np.array(c)) for p, (a, c) in self.of_pair.items()}
        self.near = functools.lru_cache(200_000)(self.near_words)

    def embedded(self, text: str) -> str | None:
        """The entry of the longest mention; mentions stand on word ends and do not overlap."""
        if not self.names:
            return None
        hits = sorted(((size, -end, entry) for end, (size, entry) in self.auto.iter(f" {text} ")), reverse=True)
        taken: list[tuple[int, int, str]] = []
        for size, end, entry in hits:
            a, b = -end - size + 1, -end
            if all(b <= x or a >= y for x, y, _ in taken):  # neighbours share one blank
                taken.append((a, b, entry))
        return taken[0][2] if taken else None

    def near_words(self, word: str) -> dict[str, float]:
        """Words of the list that a word, with a full stop if it is cut short, may be, with their likeness."""
        short, w = word.endswith("."), word.strip(".")
        if not w:
            return {}
        mask, out = np.uint64(letters(w)), {}
        most = (np.maximum(self.long, len(w)) * (1 - LIKE) + 1e-9).astype(np.int64)
        fits = (abs(self.long - len(w)) <= most) & (np.bitwise_count(self.bits & ~mask) <= most) & (np.bitwise_count(mask & ~self.bits) <= most)
        for k in np.flatnonzero(fits):
            if (s := likeness(w, self.words[k])) >= LIKE:
                out[self.words[k]] = s
        if short and len(w) >= 3:
            out |= {n: 1.0 for n in self.words if n.startswith(w)}
        return out

    def tells(self, word: str) -> bool:
        """Whether a word counts: no number, no word without meaning, even with its letters swapped."""
        w = word.strip(".")
        return bool(w) and w not in STOP and not w.isdigit() and ("".join(sorted(w)) not in SWAPPED or w in self.of_word)

    def tokens(self, value: list[str], name: list[str]) -> float:
        """Letters of both sides in words that pair up, each weighted by its likeness; 0 if they are too few."""
        left, good = list(name), 0.0
        for w in value:
            near = self.near(w)
            pick, best = None, 0.0
            for k, n in enumerate(left):
                if (s := near.get(n, 0.0)) > best:
                    best, pick = s, k
            if pick is not None:
                size = len(left.pop(pick))
                good += best * ((size if w.endswith(".") else len(w.strip("."))) + size)
        total = sum(len(w.strip(".")) for w in value) + sum(map(len, name))
        share = min(1.0, good / total) if total else 0.0
        return share if share >= (ALL if not left and len(value) == len(name) else TOKENS) else 0.0

    def __call__(self, value: str) -> str:
        text = fold(value)
        plain = " ".join(text.replace(".", " ").split())
        if not re.search(r"[^\W\d]", plain):
            return UNMAPPED
        if entry := self.embedded(plain):
            return entry
        words = [w for w in text.split() if self.tells(w)]
        scores: dict[int, float] = {}
        for k in sorted({k for w in words for n in self.near(w) for k in self.of_word[n]}):
            if s := self.tokens(words, self.parts[k][0]):
                scores[k] = s
        own = letter_pairs("".join(w for w in plain.split() if not w.isdigit()))
        shared = np.zeros(len(self.parts))
        for p, n in own.items():
            if p in self.pairs:
                at, counts = self.pairs[p]
                shared[at] += np.minimum(counts, n)
        dice = 2 * shared / (self.sizes + sum(own.values()))
        for k in np.flatnonzero(dice >= PAIRS):
            scores[int(k)] = max(scores.get(int(k), 0.0), float(dice[k]))
        return self.parts[min(scores, key=lambda k: (-scores[k], k))][1] if scores else UNMAPPED


def names_of(reference: DataFrame, entry: str, aliases: str | None) -> list[tuple[str, str]]:
    """(folded name, entry) of the reference list; raises beyond MAX_NAMES."""
    cols = [F.array(F.col(entry))] + ([F.coalesce(F.col(aliases), F.array().cast("array<string>"))] if aliases else [])
    rows = reference.select(F.col(entry).alias("entry"), F.explode(F.concat(*cols)).alias("name")).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError("the reference list is too large for one automaton")
    return [(fold(r["name"]), r["entry"]) for r in rows if r["name"] and r["entry"]]


def map_values(df: DataFrame, value: str, reference: DataFrame, entry: str, aliases: str | None = None) -> DataFrame:
    """(value, entry): one row for each distinct value of df that is not blank."""
    spark, names = df.sparkSession, names_of(reference, entry, aliases)
    shared = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = Mapper(shared.value)
        for b in batches:
            yield pd.DataFrame({"value": b["value"], "entry": [mapper(v) for v in b["value"]]})

    distinct = df.select(F.col(value).cast("string").alias("value")).filter(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]")).distinct()
    # few values may be much work: as many tasks as a shuffle has, which adaptive execution leaves alone
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return distinct.repartition(tasks).mapInPandas(run, "value string, entry string")
