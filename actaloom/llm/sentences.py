"""Sentence boundaries across languages and scripts.

Method: candidate boundaries are generated (marks that may end a sentence with the signs
that close it, quotations that end with such a mark) and each is classified by a
maximum-entropy model over the token before, its kind and length, the mark, the gap, the
kind of what follows, and the script. The model is trained on reliable boundaries of the
corpus itself, see reliable: marks at the end of a paragraph, with what the next one begins
with, and after long words before a capital are boundaries; marks before a small letter, after
the number that begins a paragraph and after abbreviations as the corpus shows them are none.
A weak prior, the same for all features it names, only says which way a feature points, so that
a few texts of a rare script do not need all of its features; the weights are the corpus's.

The training sample is bounded: the texts of the `SAMPLE` keys of lowest hash, at most
`SAMPLE_CHARS` characters of each. Splitting itself covers every row and whole texts, one
narrow pass without a shuffle. What never holds a boundary is no candidate: text in one
pair of quotation marks, a colon or semicolon, a single line break. What always is one is
not classified: an empty line, and in Thai white space that is not beside a digit.

Defined cases: null, empty and blank texts have no rows; offsets count code points;
repeated rows are split alike; texts of any length are scanned in one pass.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.session import spread

SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Abbreviations, lower-cased, without the last full stop. Fixed values.
TITLES = set("sr sra srs dr dra drs prof profa eng engª arq exmo exma d st sto sta mr mrs ms m mm mme mlle hr fr herr frau rev gen cel cap dott sig डॉ د أ".split())
REFS = set(
    "n nº nos no núm num nr nrs ref refs art arts artº al als pág págs pag p pp fls fl f doc docs cfr cf vd vs v ss ls l cap tit sec vol ed tel av r ib id "
    "abs bd bzw z ca usw vgl par ex ej i.e e.g i.é d.l op cit inc.º ac rel proc cap.º § كم ص ف م रु सं par.ex p.ex".split()
)
ENDERS = set("lda ltda s.a s.a.r.l s.l inc ltd co corp gmbh etc seg segs s h a.m p.m am pm min kg km cia u.e e.u.a d.c a.c jr sén".split())
OPENERS = "«“„‘「『\"¿¡‹"
MARKS = ".!?…‥。．！？｡؟۔।॥"
CLOSERS = ")\\]’'”»」』›"
#: A quotation, or marks with what closes them. Full stops before a small letter or digit are no candidates.
CANDIDATE = re.compile(
    rf"[«“„「『\"{MARKS}](?:(?<=«)[^»]*»|(?<=“)[^”“]*”|(?<=„)[^“”]*[“”]|(?<=「)[^」]*」|(?<=『)[^』]*』|(?<=\")[^\"]*\""
    rf"|(?<=[{MARKS}])(?:(?<!\.)|(?=[{MARKS}])|(?!\s*[a-zß-öø-ÿ,;:])(?![0-9ºª°/_-]))[{MARKS}]*(?P<close>[{CLOSERS}]*))"
)
BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
THAI = re.compile(r"(?<=[฀-๿])[^\S\n]+(?=[^\s\d])|(?<=[^\s\d])[^\S\n]+(?=[฀-๿])")
#: Marks before a small letter; tokens, with the full stop after them.
LOOSE = re.compile(rf"[{MARKS}]+(?=\s+[a-zß-öø-ÿ])")
WORDS = re.compile(r"([^\s(\[{«“„‘「『\"¿¡,;:!?…。！？।؟.)\]}»”」』’]+)(\.?)")
TOKEN = re.compile(r"[^\s(\[{«“„‘「『\"¿¡,;:!?…。！？।؟]*")


def token_before(text: str, start: int, at: int) -> str:
    size = 40
    while True:
        token = TOKEN.match(text[max(start, at - size) : at][::-1]).group()[::-1]
        if len(token) < size or at - size <= start:
            return token
        size *= 8


@functools.lru_cache(100_000)
def kind_of(token: str, first: bool) -> str:
    """The kind of the token before a mark. first: it begins its paragraph."""
    low = token.lower()
    if not token:
        return "none"
    if token[-1] in ")]}»”」』’'":
        return "closed"
    if first and (token.isdigit() or re.fullmatch(r"[A-Z]|[IVXLC]+|\d+(\.\d+)*", token)):
        return "numbering"
    if low in ENDERS:
        return "ender"
    if low in TITLES or re.fullmatch(r"eng\.[ºª]|dr\.ª|prof\.ª|sr\.ª", low):
        return "title"
    if low in REFS:
        return "ref"
    if len(token) == 1 and token.isalpha() and (token.isupper() or token.islower()):
        return "initial"
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
        return "initial"
    if token[-1].isdigit():
        return "digit"
    return "word" if len(token) > 3 or not token.isalpha() else "short"


def script_of(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "han"
    return "case" if c.isupper() or c.islower() else "other"


def next_kind(text: str, at: int, end: int) -> str:
    """What begins at `at`: U capital, l small letter, d digit, o opening sign, n letter of a script without case, s sign, p mark of the same sentence."""
    if at >= end:
        return "end"
    c = text[at]
    if c in OPENERS:
        return "o"
    if c in "([{":
        return "U" if at + 1 < end and text[at + 1].isupper() else "l"
    if c.isupper() or c.istitle():
        return "U"
    if c.islower():
        return "l"
    if c.isdigit():
        return "d"
    if c.isalpha():
        return "k" if script_of(c) == "kana" else "n"
    return "p" if c in ",;:.!?…)]}”»’'" else "s"


#: What is known of the features before training: signs, all of one size. Fixed values.
PRIOR = {
    "mark=!": 1.0, "mark=wide": 1.0,
    "kind=title": -1.0, "kind=ref": -1.0, "kind=initial": -1.0, "kind=numbering": -1.0, "kind=word": 1.0, "kind=closed": 1.0,
    "next=U": 1.0, "next=o": 1.0, "next=l": -1.0, "next=p": -1.0,
}

Key = tuple[str, str, str, str, str, str]


def features(key: Key) -> list[str]:
    kind, token, mark, gap, follow, script = key
    out = ["bias", f"mark={mark}", f"kind={kind}"]
    if kind != "digit" and len(token) <= 6:
        out.append(f"prev={token}")
    if follow != "end":
        out += [f"next={follow}", f"gap={gap}&mark={mark}", f"mark={mark}&next={follow}", f"kind={kind}&next={follow}", f"script={script}&mark={mark}"]
        if mark == "q":
            out.append(f"mark=q&gap={gap}&next={follow}")
    return out


def key_at(text: str, start: int, end: int, m: re.Match[str]) -> tuple[int, int, Key] | None:
    """(end of the sentence, begin of the next, features' key) of a candidate in the paragraph text[start:end]."""
    at = m.end()
    if m.group("close") is None:
        inner = text[m.start() + 1 : at - 1].rstrip(" \t\xa0 ")
        if not inner or inner[-1] not in MARKS:
            return None
        kind, token, sort = "closed", "", "q"
    else:
        mark = text[m.start() : m.start("close")]
        token = token_before(text, start, m.start())
        kind = kind_of(token, m.start() - len(token) == start)
        if mark[0] in "。！？｡．।॥؟۔":
            sort = "wide"
        elif "!" in mark or "?" in mark:
            sort = "!"
        elif "…" in mark or "..." in mark:
            sort = "wide" if mark == "……" else "…"
        else:
            sort = "."
        if sort != "." and kind != "closed":
            kind = "word"  # only a full stop may belong to an abbreviation
    after = at
    while after < end and text[after].isspace():
        after += 1
    gap = "none" if after == at else "line" if "\n" in text[at:after] else "space"
    follow = next_kind(text, after, end)
    if gap == "none" and follow == "U" and text[after + 1 : after + 2] == ".":  # within an acronym
        follow = "p"
    return at, after, (kind, token.lower() if len(token) <= 8 else "", sort, gap, follow, script_of(text[m.start() - 1]) if m.start() else "case")


class Model(dict):
    """Features' key -> whether the candidate is a boundary; kept once computed."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, key: Key) -> bool:
        if len(self) > 200_000:
            self.clear()
        get = self.weights.get
        self[key] = good = sum(get(f, PRIOR.get(f, 0.0)) for f in features(key)) > 0
        return good


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(first character, end) of every paragraph that is not blank."""
    at = 0
    for stop, after in [*(m.span() for m in BLANK.finditer(text)), (len(text), len(text))]:
        while at < stop and text[at].isspace():
            at += 1
        if at < stop:
            yield at, stop
        at = after


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence of the text."""
    out: list[tuple[int, int]] = []
    thai = THAI.search(text) is not None

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for start, end in paragraphs(text):
        begin, cuts = start, []
        for m in CANDIDATE.finditer(text, start, end):
            found = key_at(text, start, end, m)
            if found and found[2][4] != "end" and model[found[2]]:
                cuts.append((found[0], found[1]))
        if thai:
            cuts = sorted(cuts + [(m.start(), m.end()) for m in THAI.finditer(text, start, end) if not text[m.start() - 1].isdigit()])
        for stop, after in cuts:
            if stop > begin:
                add(begin, stop)
                begin = after
        add(begin, end)
    return out


def abbreviations(texts: list[str], last: Counter[str]) -> set[str]:
    """Short tokens of five texts or more that hardly ever stand without a full stop, nor at a paragraph's end. last: tokens at paragraphs' ends."""
    plain: Counter[str] = Counter()
    dotted: Counter[str] = Counter()
    held_by: Counter[str] = Counter()
    for t in texts:
        found = [x for x in WORDS.findall(t.lower()) if len(x[0]) <= 6 and not x[0][0].isdigit()]
        plain.update(w for w, _ in found)
        own = Counter(w for w, dot in found if dot)
        dotted.update(own)
        held_by.update(own.keys())
    return {w for w, n in dotted.items() if held_by[w] >= 5 and n >= 0.95 * plain[w] and last[w] <= 0.01 * n}


def reliable(texts: list[str]) -> list[tuple[Key, int, int]]:
    """(features' key, 1 boundary or 0 none, count) of the candidates that are safe to learn from.

    Boundaries: the marks at the ends of paragraphs, with what the next paragraph begins with
    as what follows; and marks after a long word or a closing sign before a capital, which
    paragraphs' ends show to be ends of sentences. None: marks before a small letter or a mark
    of the same sentence, the number that begins a paragraph, abbreviations as the corpus shows
    them, and quotations that a character follows which often does so but begins no paragraph.
    """
    seen: Counter[Key] = Counter()
    ends: Counter[Key] = Counter()
    small: Counter[Key] = Counter()
    last: Counter[str] = Counter()
    first: Counter[str] = Counter()
    after: Counter[tuple[Key, str]] = Counter()
    for text in texts:
        parts = list(paragraphs(text))
        for (start, end), following in zip(parts, [*parts[1:], None]):
            first[text[start]] += 1
            for m in CANDIDATE.finditer(text, start, end):
                if not (found := key_at(text, start, end, m)):
                    continue
                key = found[2]
                if key[4] != "end":
                    seen[key] += 1
                    if key[2] == "q" and key[3] == "none":
                        after[key, text[found[1]]] += 1
                else:
                    last[key[1]] += 1
                    if following:
                        ends[(*key[:3], "space", next_kind(text, *following), key[5])] += 1
            for m in LOOSE.finditer(text, start, end):
                token = token_before(text, start, m.start())
                small[(kind_of(token, False), token.lower() if len(token) <= 8 else "", ".", "space", "l", "case")] += 1
    cut_short = abbreviations(texts, last)
    follows = Counter()
    for (_, c), n in after.items():
        follows[c] += n
    out = [(k, 0, n) for (k, c), n in after.items() if follows[c] >= 5 and first[c] <= 0.02 * follows[c]]
    out += [(k, 0, n) for k, n in small.items()] + [(k, 1, n) for k, n in ends.items() if k[0] != "numbering"]
    for k, n in seen.items():
        kind, token, mark, gap, follow, _ = k
        if follow in "lp" or kind == "numbering" or mark == "." and token in cut_short:
            out.append((k, 0, n))
        elif kind in ("word", "closed") and gap != "none" and follow in "Uo":
            out.append((k, 1, n))
    return out


def fit(texts: list[str], rounds: int = 12, hold: float = 0.05) -> dict[str, float]:
    """Weights of the maximum-entropy model by Newton's method, with a Gaussian prior of precision `hold` around PRIOR."""
    data = reliable(texts)
    if not data:
        return dict(PRIOR)
    count = Counter(f for key, _, n in data for f in features(key) for _ in range(min(n, 3)))
    names = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= 3))}
    x, y, w = np.zeros((len(data), len(names)), np.float32), np.zeros(len(data)), np.zeros(len(data))
    for r, (key, label, n) in enumerate(data):
        y[r], w[r] = label, min(n, 50)
        x[r, [names[f] for f in features(key) if f in names]] = 1
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    theta = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (y - p)) - hold * (theta - prior)
        curve = (x * np.maximum(w * p * (1 - p), 1e-6)[:, None].astype(np.float32)).T @ x
        step = np.linalg.solve(curve.astype(float) + hold * np.eye(len(names)), grad)
        theta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-3:
            break
    return PRIOR | {f: round(float(theta[k]), 4) for f, k in names.items()}


def fit_corpus(df: DataFrame, key: str, text: str) -> dict[str, float]:
    """The model of a corpus, from its bounded sample (see the module)."""
    ids = df.select(F.col(key).alias("k")).filter(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    keys = [r["k"] for r in ids.collect()]
    rows = df.filter(F.col(key).isin(keys)).select(F.substring(F.col(text), 1, SAMPLE_CHARS).alias("t")).filter(F.col("t").isNotNull()).limit(2 * SAMPLE).collect() if keys else []
    return fit([r["t"] for r in rows])


def split_sentences(df: DataFrame, key: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, start_at, end_at): a row for each sentence, in code points."""
    weights = weights or fit_corpus(df, key, text)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights)
        for b in batches:
            found = [spans(t, model) if t else [] for t in b.column(1).to_pylist()]
            counts = np.array([len(f) for f in found], np.int64)
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["key", "start_at", "end_at"])

    out = spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"key {kind}, start_at bigint, end_at bigint")
    return out.withColumnRenamed("key", key)
