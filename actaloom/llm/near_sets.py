"""Similarity join of records by their sets of consecutive words.

Method: chosen-path join. Each set is split recursively on tokens sampled by a hash that
all sets share: from a node of the recursion a set goes on to the children of those of its
tokens whose hash with the path lies under a threshold, about `BRANCH` of them. A path ends
as soon as its bucket is expected to be small; sets that meet at the end of a path are
compared by brute force. Independent runs are repeated until a pair at the threshold is
met with the probability `recall`: each set makes as many as the length of the paths over its
most frequent tokens asks, for a partner that holds all of it or is held by it. What meets is
then checked exactly.

Scale: sets that are equal form one class, and only classes go through the join, so that a
group of copies costs as one record. How many sets hold a token is estimated over all rows
by a table of fixed size (4 MB). Paths that a sample of the classes shows to be crowded all
the same are cut into blocks before the shuffle, so that each pair of blocks is a group of its
own; what the sample misses is cut after it. Nothing is dropped, no task holds more than two
blocks, and a crowded path never meets one task. Only pairs whose 256-bit sketches agree
leave a bucket.

Defined cases: null and blank texts belong to no class; a text of fewer words than a
shingle is the set of its one short shingle, so that equal short texts meet; repeated rows
count once; a text of any length is one row of the set table. Shingles are 32-bit hashes, those
of sets under `WIDE` 64-bit ones, for few hashes may agree by chance; classes are digests of the
64-bit ones of all sets.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaloom.operators.graph import components
from actaloom.session import cut, spread, stored

#: Expected number of children of a set at each node.
BRANCH = 1.5
#: Longest path, and the sets that a bucket is brought down to.
DEPTH, SMALL = 8, 24
#: Classes of one block of a large bucket; a group of more than three blocks is cut, two are compared.
BLOCK = 1024
#: One of so many classes is looked at for crowded paths; crowded ones are broadcast up to this many (8 bytes each).
SAMPLED, CROWDED = 64, 2_000_000
#: Characters of texts whose sets are made at once, rows of whole groups that are compared at once, pairs of them.
CHARS, READY, PAIRS = 1_000_000, 16_384, 100_000
#: Members of a class that form one part of it where pairs are listed.
PART = 1024
#: Sets of fewer shingles keep 64-bit hashes.
WIDE = 16
#: Classes with a partner up to which their names (16 bytes each) are broadcast to the set table.
FEW = 500_000
#: Cells of the table of token frequencies.
CELLS = 1 << 20
WORD = re.compile(r"\w+")

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32, S34, CIRCLE = np.uint64(29), np.uint64(32), np.uint64(34), np.uint64(1 << 32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S32)) * K1
    x = (x ^ (x >> S29)) * K2
    return x ^ (x >> S32)


#: ASCII characters that no word has, as blanks.
BLANKS = bytes(c if c > 127 or chr(c).isalnum() or chr(c) == "_" else 32 for c in range(256))


class Words(dict):
    """What stands between blanks -> the 64-bit hashes of its words, as bytes; emptied when it gets large."""

    def __missing__(self, token: bytes) -> bytes:
        if len(self) > 500_000:
            self.clear()
        self[token] = raw = b"".join(xxhash.xxh3_64_intdigest(w).to_bytes(8, "little") for w in WORD.findall(token.decode()))
        return raw


WORDS = Words()


def uniques(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of sorted sets, which lie one after another, without repetitions. No set is empty."""
    first = np.cumsum(sizes) - sizes
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    return x[new], np.add.reduceat(new, first, dtype=np.int64)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the texts' shingles as sorted 64-bit hashes, one after another, and their sizes."""
    raw = [b"".join(map(WORDS.__getitem__, t.lower().encode().translate(BLANKS).split())) for t in texts]
    words = np.array([len(r) // 8 for r in raw], np.int64)
    h = np.frombuffer(b"".join(raw), np.uint64)
    sizes = np.maximum(words - width + 1, 1)
    last = np.cumsum(sizes)
    full = words >= width
    at = (np.arange(last[-1]) + np.repeat(np.cumsum(words) - words - last + sizes, sizes))[np.repeat(full, sizes)]
    s = h[at] * K1
    for k in range(1, width):
        s = mix(s ^ (h[at + k] + K3))
    if not full.all():
        long, s = s, np.empty(last[-1], np.uint64)
        s[np.repeat(full, sizes)] = long
        for i in np.flatnonzero(~full).tolist():
            s[last[i] - 1] = xxhash.xxh3_64_intdigest(" ".join(WORD.findall(texts[i].lower())))
    for i, k in zip((last - sizes).tolist(), last.tolist()):
        s[i:k].sort()
    return uniques(s, sizes)


def shingles(text: str, width: int) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes."""
    return shingle_sets([text], width)[0]


def narrow(x: np.ndarray) -> np.ndarray:
    """The sorted 32-bit hashes of sorted 64-bit ones."""
    y = (x >> S32).astype(np.uint32)
    return y if len(y) < 2 or (y[1:] != y[:-1]).all() else np.unique(y)


def unpack(raw: bytes, n: int) -> np.ndarray:
    """The items of a set of n shingles as it is stored."""
    return np.frombuffer(raw, np.uint64 if n < WIDE else np.uint32)


#: Bins of a sketch, each of two bits; sets under SMALLEST have a hash of their own for each bin.
BINS, SMALLEST = 128, 160
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
SEEDS = mix(np.arange(1, BINS + 1, dtype=np.uint64) * K3)
SKETCH = ("s1", "s2", "s3", "s4")


def sketches(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of 256 bits for each of the sets that lie one after another: two of a least hash for each of 128 bins.

    A bin of two sets agrees with a probability of (1 + 3 * Jaccard similarity) / 4. A bin of
    a large set holds the hashes that fall into it, an empty one takes the next one's; for
    small sets, whose bins would mostly be empty, each bin hashes the whole set.
    """
    h = x.astype(np.uint64) * K1
    m, low, last = mix(h), np.empty((len(sizes), BINS), np.uint64), np.cumsum(sizes)
    for k, (i, j) in enumerate(zip((last - sizes).tolist(), last.tolist())):
        if j - i < SMALLEST:
            low[k] = mix(h[None, i:j] ^ SEEDS[:, None]).min(axis=1)
        else:
            own = m[i:j]
            own.sort()
            at = np.searchsorted(own, EDGES)
            at[at == j - i] = 0
            low[k] = own[at]
    bits = (low >> np.uint64(20)).astype(np.uint8) & 3
    return np.packbits(np.stack([bits >> 1, bits & 1], 2).reshape(len(sizes), 2 * BINS), axis=1).view("<i8")


SETS = "key string, cls binary, n int, s1 bigint, s2 bigint, s3 bigint, s4 bigint, items binary, cells binary"
SETS_ARROW = pa.schema([("key", pa.string()), ("cls", pa.binary()), ("n", pa.int32()), *((s, pa.int64()) for s in SKETCH), ("items", pa.binary()), ("cells", pa.binary())])


def set_table(texts: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """One row for each text that is not blank, see SETS; a last row a partition (key null) has the frequent cells in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sets = np.zeros(CELLS, np.uint32), 0
        schema = SETS_ARROW

        def rows(keys: list[str], held: list[str]) -> pa.RecordBatch:
            full, wide = shingle_sets(held, width)
            x, size = uniques((full >> S32).astype(np.uint32), wide)
            count[:] += np.bincount(x & np.uint32(CELLS - 1), minlength=CELLS).astype(np.uint32)
            ends = np.cumsum(wide) * 8, np.cumsum(size) * 4
            raw, short = full.tobytes(), x.tobytes()
            wides, narrows = ([data[i:j] for i, j in zip([0, *e.tolist()], e.tolist())] for data, e in zip((raw, short), ends))
            cls = [hashlib.blake2b(r, digest_size=16).digest() for r in wides]
            items = [w if n < WIDE else r for w, r, n in zip(wides, narrows, wide.tolist())]
            cols = keys, cls, np.where(wide < WIDE, wide, np.maximum(WIDE, size)), *sketches(x, size).T, items, [None] * len(keys)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            keys, held, chars = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k is None or t is None or not t.strip():
                    continue
                keys.append(k)
                held.append(t)
                chars += len(t)
                if chars > CHARS:
                    yield rows(keys, held)
                    sets += len(keys)
                    keys, held, chars = [], [], 0
            if keys:
                yield rows(keys, held)
                sets += len(keys)
        at = np.flatnonzero(count > max(1, sets // 1000)).astype(np.uint32)
        cells = at.tobytes() + count[at].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([None], [None], [sets], [None], [None], [None], [None], [None], [cells]), schema)], schema=schema)

    return spread(texts.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))).mapInArrow(run, SETS)


def cell_shares(sets: DataFrame) -> tuple[np.ndarray, int]:
    """(share of the sets that hold a token of each cell, number of sets): a table of fixed size."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(raw, np.uint32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, v[0].astype(np.int64)]), pa.array(np.r_[n, v[1].astype(np.int64)])], names=["cell", "n"])

    rows = sets.filter("key is null").select("n", "cells").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    share, total = np.zeros(CELLS, np.float32), int(rows.n[rows.cell == -1].sum())
    body = rows[rows.cell >= 0]
    share[body.cell.to_numpy()] = body.n.to_numpy() / max(1, total)
    return np.clip(share, 1 / 1000 / 4, 1.0), total


#: Parts of a halving in which the shares of tokens are told apart, and groups of a set's tokens.
STEPS, GROUPS = 8, 8


@functools.cache
def runs_needed(threshold: float, recall: float, need: int, gains: tuple[int, ...]) -> int:
    """Runs until two sets at the threshold meet with the probability `recall`.

    need: how far a path has to go until its bucket is small; gains: how far each group of the
    shared tokens takes it, groups being of equal weight; both in parts of a halving, see
    STEPS. This is the branching process over all DEPTH levels. Of the children of the larger
    set a part of `threshold` at least is shared: so many if it holds all of the smaller set,
    more if the two are of like size.
    """
    left = np.arange(need + 1)[:, None] - np.array(gains)
    p = np.ones(need + 1)
    for _ in range(DEPTH):
        p[0] = 1.0
        p = 1 - np.exp(-threshold * BRANCH * p[np.maximum(left, 0)].mean(axis=1))
    return math.ceil(math.log(1 - recall) / math.log(1 - p[need]))


def runs_of(size: np.ndarray, total: int, threshold: float, recall: float) -> int:
    """Runs of a set with tokens of these shares: enough for each set at the threshold.

    The tokens that a pair shares are a part of `threshold` of either set at least. Taken are
    the most frequent ones, whose paths are the longest; so neither set of a pair makes fewer
    runs than the pair needs.
    """
    need = max(0, math.ceil(math.log2(max(1, total) / SMALL) * STEPS))
    gains = np.sort(np.minimum(-np.log2(size) * STEPS + 1e-4, need).astype(np.int64))[: max(1, math.ceil(threshold * len(size)))]
    return runs_needed(threshold, recall, need, tuple(gains[np.arange(GROUPS) * len(gains) // GROUPS].tolist()))


def leaf_paths(sets: list[np.ndarray], share: np.ndarray, total: int, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(path, index of the set): the paths at whose ends the sets stand, over all their runs; sorted by set.

    A path goes on to the tokens whose hash lies in a window of the circle of 32-bit numbers
    that starts at a place drawn by the path and is BRANCH / (size of the set) of it wide. With
    the hashes sorted a window is found by bisection, whatever the size of the set, for all
    sets at once.
    """
    n = np.array([len(x) for x in sets], np.int64)
    first, flat, of = np.r_[0, np.cumsum(n)[:-1]], np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    size = share[flat & np.uint32(CELLS - 1)]
    runs = np.array([runs_of(size[i : i + k], total, threshold, recall) for i, k in zip(first, n)])
    x64 = mix(flat.astype(np.uint64) * K3)
    place = of.astype(np.uint64) << S34 | x64 >> S32
    order = np.argsort(place)
    x64, size, place = x64[order], size[order], place[order]
    ring = np.empty(2 * len(flat), np.uint64)  # each set's circle twice over, one set after another
    at = np.arange(len(flat)) + first[of]
    ring[at], ring[at + n[of]] = place, place + CIRCLE
    width = np.minimum(2.0**32 * BRANCH / n, 2.0**32 - 1).astype(np.uint64)
    own = np.repeat(np.arange(len(sets)), runs)
    paths = mix((np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs) + 1).astype(np.uint64) * K2)
    expect, ended, owners = np.full(len(own), float(total)), [], []
    for depth in range(DEPTH):
        start = own.astype(np.uint64) << S34 | paths >> S32
        low, high = np.searchsorted(ring, start), np.searchsorted(ring, start + width[own])
        hits = high - low
        at = np.repeat(np.arange(len(paths)), hits)
        own = own[at]
        tok = np.arange(len(at)) + np.repeat(low - np.cumsum(hits) + hits, hits) - 2 * first[own]
        tok = first[own] + tok % n[own]
        child, left = mix(paths[at] * K1 + x64[tok]), expect[at] * size[tok]
        ends = (left <= SMALL) | (depth == DEPTH - 1)
        ended.append(child[ends])
        owners.append(own[ends])
        paths, expect, own = child[~ends], left[~ends], own[~ends]
        if not len(paths):
            break
    path, owner = np.concatenate(ended), np.concatenate(owners)
    order = np.lexsort((path, owner))
    path, owner = path[order], owner[order]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
    return path[new], owner[new]


def crowded_paths(sets: DataFrame, share: np.ndarray, total: int, threshold: float, recall: float) -> dict[int, int]:
    """Path -> number of blocks, of the paths at which more classes than a block stand, judged by a sample of the classes.

    The sample is a fixed part of the classes by their digest, so it grows with the data; a path
    of two blocks has about 32 classes of it. Missed paths cost time, not rows.
    """
    some = sets.filter("key is not null").filter(F.pmod(F.xxhash64("cls"), F.lit(SAMPLED)) == 0).dropDuplicates(["cls"])
    least = max(2, BLOCK // SAMPLED)
    paths = path_rows(some, share, total, threshold, recall, {}).groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rows = paths.orderBy(F.desc("n"), "path").limit(CROWDED).toPandas()
    return dict(zip(rows["path"].tolist(), (-(-rows["n"] * SAMPLED // BLOCK)).tolist()))


def path_rows(sets: DataFrame, share: np.ndarray, total: int, threshold: float, recall: float, crowded: dict[int, int]) -> DataFrame:
    """(path, cls, n, s1 .. s4): where each class ends; copies within a partition count once.

    A class at a crowded path stands in the groups of all pairs of its block with another.
    """
    spark = sets.sparkSession
    shared, blocks_of = spark.sparkContext.broadcast(share), spark.sparkContext.broadcast(crowded)

    def cut_up(b: pa.RecordBatch, paths: np.ndarray, at: np.ndarray, blocks: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        known = np.array(list(blocks), np.int64)
        some = np.isin(paths, known)
        out, where = [], []
        for p, k in zip(paths[some].tolist(), at[some].tolist()):
            g = blocks[p]
            own = xxhash.xxh3_64_intdigest(b.column(0)[k].as_py()) % g
            out += [xxhash.xxh3_64_intdigest(f"{p} {min(own, j)} {max(own, j)}") - (1 << 63) for j in range(g)]
            where += [k] * g
        return np.r_[paths[~some], np.array(out, np.int64)], np.r_[at[~some], np.array(where, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            paths, owner = leaf_paths([x for _, x in held], shared.value, total, threshold, recall)
            paths, at = paths.astype(np.int64), np.array([k for k, _ in held])[owner]
            if blocks:
                paths, at = cut_up(b, paths, at, blocks)
            k = pa.array(at)
            return pa.RecordBatch.from_arrays([pa.array(paths), b.column(0).take(k), *(b.column(c).take(k) for c in (2, 3, 4, 5, 6))], names=["path", "cls", "n", *SKETCH])

        seen: set[bytes] = set()
        blocks = blocks_of.value
        for b in batches:
            cls, raws, sizes = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            held, size = [], 0
            for k, (c, raw, n) in enumerate(zip(cls, raws, sizes)):
                if c in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(c)
                x = unpack(raw, n)
                held.append((k, narrow(x) if n < WIDE else x))
                size += len(x)
                if size > 150_000 or len(held) >= 512:
                    yield rows(b, held)
                    held, size = [], 0
            if held:
                yield rows(b, held)

    return sets.filter("key is not null").select("cls", "items", "n", *SKETCH).mapInArrow(run, f"path bigint, cls binary, n int, {', '.join(f'{s} bigint' for s in SKETCH)}")


def least_bins(threshold: float) -> int:
    """Bins that the sketches of a pair at the threshold share but in one of ten thousand cases."""
    p = (1 + 3 * threshold) / 4
    return int(BINS * p - 3.7 * math.sqrt(BINS * p * (1 - p)))


@functools.cache
def upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a small group, see compare."""
    return np.triu_indices(n, 1)


def compare(groups: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """(a, b) of the rows (grp, cls, n, s1 .. s4), sorted by grp, that share a group and whose sizes and sketches agree.

    Sizes of a pair at the threshold differ by its factor at most. A small and a large set
    have no sketches to compare; if their sizes agree they pass.
    """
    need = least_bins(threshold)
    g, size_of = groups.column(0).to_numpy(), groups.column(2).to_numpy()
    s = np.stack([groups.column(k).to_numpy() for k in (3, 4, 5, 6)], 1).view(np.uint64)
    small = size_of < SMALLEST
    cls = groups.column(1).combine_chunks()
    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    size = np.diff(edges)
    left, right = [], []

    def keep(u: np.ndarray, v: np.ndarray) -> None:
        near = np.minimum(size_of[u], size_of[v]) >= threshold * np.maximum(size_of[u], size_of[v])
        u, v = u[near], v[near]
        x = s[u] ^ s[v]
        off = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        good = (off[:, 0] + off[:, 1] + off[:, 2] + off[:, 3] <= BINS - need) | (small[u] != small[v])
        left.append(u[good])
        right.append(v[good])

    for n in np.unique(size[size > 1]):
        at = edges[:-1][size == n]
        if n <= 512:
            i, j = upper(int(n)) if n <= 64 else np.triu_indices(n, 1)
            step = max(1, PAIRS // len(i))
            for k in range(0, len(at), step):
                keep((at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel())
        else:  # some rows against all later ones, so that no more than a million pairs are held
            step = max(1, 1_000_000 // n)
            for first in at:
                for k in range(0, n, step):
                    i = np.arange(k, min(n, k + step))
                    u, v = np.repeat(i, n - i - 1), np.concatenate([np.arange(x + 1, n) for x in i])
                    keep(first + u, first + v)
    if not left or not sum(map(len, left)):
        return None
    names = cls.dictionary_encode()
    order = pc.sort_indices(names.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    own = rank[names.indices.to_numpy()]
    x, y = (own[np.concatenate(k)] for k in (left, right))
    pairs = np.unique((np.minimum(x, y) << 32 | np.maximum(x, y))[x != y])
    return pa.RecordBatch.from_arrays([names.dictionary.take(order.take(pa.array(k))) for k in (pairs >> 32, pairs & (1 << 32) - 1)], names=["a", "b"])


#: A pair of classes, or a row of a group that is too large to be compared as it is (then grp is set).
FOUND = "a binary, b binary, grp bigint, n int, s1 bigint, s2 bigint, s3 bigint, s4 bigint"


def bucket_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """FOUND from rows (path, cls, n, s1 .. s4) that are partitioned and sorted by path.

    A group of more than three blocks is handed on row by row as soon as it is known to be so
    large; no more than that is held, and whole groups of READY rows.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("grp", pa.int64()), ("n", pa.int32()), *((s, pa.int64()) for s in SKETCH)])

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (out := compare(pa.Table.from_batches(held), threshold)) is not None:
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(out.num_rows, f.type) for f in schema if f.name not in "ab")], schema=schema)

    def on(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(1), pa.nulls(b.num_rows, pa.binary()), b.column(0), *b.columns[2:]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that goes on
        ready: list[pa.RecordBatch] = []  # whole groups before it
        count, large = 0, False
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            first = int(edges[1]) if len(edges) > 1 else b.num_rows
            if held and held[-1].column(0)[0].as_py() == g[0]:
                part = b.slice(0, first)
                if large:
                    yield on(part)
                elif count + first > 3 * BLOCK:
                    yield from map(on, [*held, part])
                    large = True
                else:
                    held.append(part)
                    count += first
                b = b.slice(first)
                if not b.num_rows:
                    continue
                edges = edges[1:] - first
            if not large:
                ready += held
            held, count, large = [], 0, False
            last = int(edges[-1])
            sizes = np.diff(np.r_[edges, b.num_rows])
            for i in np.flatnonzero(sizes[:-1] > 3 * BLOCK):
                yield on(b.slice(int(edges[i]), int(sizes[i])))
            if (keep := sizes[:-1] <= 3 * BLOCK).any():
                whole = b.slice(0, last)
                ready.append(whole if keep.all() else whole.filter(pa.array(np.repeat(keep, sizes[:-1]))))
            if sum(x.num_rows for x in ready) >= READY:
                yield from pairs(ready)
                ready = []
            held, count = [b.slice(last)], b.num_rows - last
            if count > 3 * BLOCK:
                yield on(held[0])
                large = True
        if not large:
            ready += held
        if ready:
            yield from pairs(ready)

    return rows.select("path", "cls", "n", *SKETCH).mapInArrow(run, FOUND)


def meeting_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes that end at the same path and whose sketches agree, a < b, each pair once."""
    found = cut(bucket_pairs(rows.repartition("path").sortWithinPartitions("path"), threshold))
    pairs = found.filter("grp is null").select("a", "b")
    left = found.filter("grp is not null").select("grp", F.col("a").alias("cls"), "n", *SKETCH)
    if not left.isEmpty():  # crowded paths that the sample missed: count, then cut into pairs of blocks
        blocks = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_g"))
        large = left.join(blocks, "grp")
        own = F.pmod(F.xxhash64("cls"), F.col("_g")).cast("bigint")
        both = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda j: F.struct(F.least(own, j.cast("bigint")).alias("i"), F.greatest(own, j.cast("bigint")).alias("j")))
        cut_up = large.withColumn("_k", F.explode(both)).withColumn("path", F.xxhash64("grp", "_k.i", "_k.j"))
        again = cut(bucket_pairs(cut_up.select("path", "cls", "n", *SKETCH).repartition("path").sortWithinPartitions("path"), threshold))
        pairs = pairs.union(again.filter("grp is null").select("a", "b"))
        if not again.filter("grp is not null").isEmpty():
            raise AssertionError("a pair of blocks is larger than three blocks")
    return pairs.distinct()


def similar_classes(sets: DataFrame, threshold: float = 0.5, recall: float = 0.99) -> DataFrame:
    """(a, b, similarity): classes of sets at least as similar as the threshold, a < b."""
    share, total = cell_shares(sets)
    crowded = crowded_paths(sets, share, total, threshold, recall)
    pairs = cut(meeting_pairs(path_rows(sets, share, total, threshold, recall, crowded), threshold))
    wanted = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)  # else both sides are shuffled
    items = sets.filter("key is not null").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "items", "n")
    both = pairs.join(items.select(F.col("cls").alias("a"), F.col("items").alias("x"), F.col("n").alias("nx")), "a").join(items.select(F.col("cls").alias("b"), F.col("items").alias("y"), F.col("n").alias("ny")), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for p, q, nx, ny in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5))):
                x, y = unpack(p, nx), unpack(q, ny)
                if (nx < WIDE) != (ny < WIDE):
                    x, y = (narrow(z) if n < WIDE else z for z, n in ((x, nx), (y, ny)))
                n = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(n / (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "x", "y", "nx", "ny").mapInArrow(exact, "a binary, b binary, similarity double").filter(F.col("similarity") >= threshold)


def members(records: DataFrame, sets: DataFrame, key: str, rel: str) -> DataFrame:
    """(member, cls): distinct records of each class, joined by the text's key."""
    own = records.select(F.col(key).cast("string").alias("member"), F.col(rel).cast("string").alias("key")).filter("member is not null and key is not null").distinct()
    return own.join(sets.filter("key is not null").select("key", "cls").distinct(), "key").select("member", "cls").distinct()


def similar_records(records: DataFrame, key: str, rel: str, texts: DataFrame, text_key: str, text: str, width: int = 3, threshold: float = 0.5, recall: float = 0.99) -> DataFrame:
    """(id_a, id_b): all pairs of distinct records whose texts are similar, equal texts included, id_a < id_b."""
    sets = stored(set_table(texts, text_key, text, width), "sets")
    own = cut(members(records, sets, key, rel))
    links = similar_classes(sets, threshold, recall).select("a", "b")
    # a class of many members is cut into parts, whose pairs are joined one by one
    parts = own.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select("cls", "n", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    within = parts.filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    split = own.join(parts, "cls").select("member", "cls", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"))
    count = lambda c: parts.select(F.col("cls").alias(c), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{c}"))
    asked = links.union(within).join(count("a"), "a").join(count("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("part_a") <= F.col("part_b")))
    x, y = (split.select(F.col("member").alias(v), F.col("cls").alias(c), F.col("part").alias(f"part_{c}")) for v, c in (("x", "a"), ("y", "b")))
    pairs = asked.join(x, ["a", "part_a"]).join(y, ["b", "part_b"]).filter(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_groups(records: DataFrame, key: str, rel: str, texts: DataFrame, text_key: str, text: str, width: int = 3, threshold: float = 0.5, recall: float = 0.99) -> DataFrame:
    """(id, group_id, links): a row for each record with a text; its class's links to other classes; the group is the least id that similar texts connect."""
    sets = stored(set_table(texts, text_key, text, width), "sets")
    own = cut(members(records, sets, key, rel))
    links = cut(similar_classes(sets, threshold, recall).select("a", "b"))
    degree = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    group = components(links).withColumnRenamed("node", "cls")
    full = own.join(degree, "cls", "left").join(group, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = full.groupBy("component").agg(F.min("member").alias("group_id"))
    return full.join(least, "component").select(F.col("member").alias("id"), "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")).groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
