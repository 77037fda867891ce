from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actaloom.llm import bpe, packing

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids(text: str) -> list[int]:
    return np.frombuffer(bpe.encoder(PATH).ids_of(text), "<i4").tolist()


HARD = ["", " ", "  ", "\n \n", "a  b   c\n\n  d ", "l'été d'hier, don't I'LL", "1.234,56 € n.º 7", "𝐕𝐚𝐥𝐨𝐫 ½ ﬁnal ①②", "<|endoftext|> x", "\t 　x", "नमस्ते 世界 สวัสดี", "éà", "x" * 5000, " " * 300 + "y", "​﻿\x85\x1c z", "\r\n\r\na"]


@pytest.mark.parametrize("text", HARD)
def test_same_ids_as_the_library(peer, text):
    assert ids(text) == peer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=80) | st.text(alphabet=" \n\taeio1.,'é’s", max_size=60))
def test_random_texts(peer, text):
    assert ids(text) == peer.encode(text, add_special_tokens=False).ids


def test_round_trip_and_nulls(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(90, None), (91, "twice"), (91, "twice")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id bigint, text string, ids string")
    enc = bpe.encode_corpus(df, "doc_id", "text")
    assert enc.columns == ["doc_id", "ids"]
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert got[90] == [] and got[0] == []
    back = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(enc, "doc_id", "ids").collect()}
    assert all(back[k] == (t or "") for k, t in rows)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_hilbert_is_a_curve():
    n = 1 << 4
    old = packing.DIMS, packing.BITS
    try:
        packing.DIMS, packing.BITS = 2, 4
        grid = np.array([(x, y) for x in range(n) for y in range(n)])
        order = grid[np.argsort(packing.hilbert(grid))]
        assert sorted(packing.hilbert(grid)) == list(range(n * n))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    finally:
        packing.DIMS, packing.BITS = old


def test_packing_keeps_all_and_fills(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 300)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(["lei", "casa", "dia", "prova", "custo"], k=rnd.randint(1, 700)))) for i in range(800)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(5000, None), (5001, ""), (5002, "lei " * 9000)]
    sizes = spark.createDataFrame([(1, 512), (2, 2048), (3, 0), (4, None)], "pack_id bigint, capacity bigint")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    packed = packing.pack(df, "doc_id", "text", sizes)
    want = {r["doc_id"]: len(r["ids"]) for r in bpe.encode_corpus(df, "doc_id", "text").collect()}
    for pack_id, capacity in ((1, 512), (2, 2048)):
        used, pieces = defaultdict(int), defaultdict(list)
        for r in packed.filter(F.col("pack_id") == pack_id).collect():
            used[r["container_id"]] += r["n_tokens"]
            pieces[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
        assert max(used.values()) <= capacity
        for doc, n in want.items():
            parts = sorted(pieces[doc])
            assert sum(k for _, k in parts) == n
            assert len(parts) == (1 if n <= capacity else -(-n // capacity))
            assert all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
        total = sum(want.values())
        assert total / (capacity * sum(v > 0 for v in used.values())) > (0.8 if capacity == 512 else 0.95)
    again = packing.pack(df.repartition(5), "doc_id", "text", sizes)
    assert packed.exceptAll(again).count() == 0
    assert packing.pack(df.limit(0), "doc_id", "text", sizes).count() == 0
    assert packed.select("pack_id").distinct().count() == 2


def test_stretches_are_ranges_of_the_whole_key(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([5, 7]) << 16 | rnd.randrange(3000)) for i in range(900)] + [(1000 + i, 7 << 16 | 123) for i in range(200)] + [(2000 + i, i << 16) for i in range(20, 60)]
    items = spark.createDataFrame([(k, 1, c) for k, c in rows], "key bigint, n_tokens bigint, curve bigint")
    for cuts in (packing.CUTS, 0):
        monkeypatch.setattr(packing, "CUTS", cuts)
        got = packing.with_stretch(items).select("key", "curve", "name").collect()
        assert sorted((r["key"], r["curve"]) for r in got) == sorted(rows)
        spans, sizes = defaultdict(list), defaultdict(int)
        for r in got:
            spans[r["name"]].append(r["curve"])
            sizes[r["name"]] += 1
        assert max(sizes.values()) <= 2 * 50
        crowd = 7 << 16 | 123
        ranges = sorted((min(c), max(c)) for c in spans.values() if set(c) != {crowd})
        assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        assert sum(set(c) == {crowd} for c in spans.values()) >= 4
