from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from actaloom.llm import ledger, mapping, near_sets, quota


def jaccard(a: str, b: str, width: int) -> float:
    def sets(t: str) -> set:
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def texts(seed: int, n: int) -> list[tuple[str, str]]:
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choices(vocab, k=rnd.randint(3, 120))) for _ in range(n)]
    for k in range(0, n, 3):
        words = base[k].split()
        for _ in range(max(1, len(words) // 25)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        base.append(" ".join(words))
    base += [base[0], base[1], base[1]]
    return [(f"k{i:04d}", t) for i, t in enumerate(base)]


def test_similarity_join_against_brute_force(spark):
    rows = texts(1, 120)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id string, text string, cls string")
    got = {(r["id_a"], r["id_b"]) for r in near_sets.similar_records(df, "id", "id", df, "id", "text").collect()}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x, y, 3) >= 0.5}
    assert not got - want
    assert len(got & want) >= 0.99 * len(want)


@pytest.mark.parametrize("sampled", [1, 64])  # crowded paths are known beforehand, or not
def test_similarity_join_large_bucket_and_edges(spark, monkeypatch, sampled):
    monkeypatch.setattr(near_sets, "BLOCK", 8)
    monkeypatch.setattr(near_sets, "SAMPLED", sampled)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(f"k{i:03d}", f"{shared} own{i} extra{i}") for i in range(40)] + [("n1", None), ("n2", "  "), ("e1", "uma só"), ("e2", "Uma SÓ!"), (None, "uma só"), ("long", "a b c " * 60_000)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r["id_a"], r["id_b"]) for r in near_sets.similar_records(df, "id", "id", df, "id", "text").collect()}
    assert {(a, b) for a, b in got if a[0] == "k"} == set(itertools.combinations([f"k{i:03d}" for i in range(40)], 2))
    assert {(a, b) for a, b in got if a[0] != "k"} == {("e1", "e2")}
    groups = {r["id"]: r["group_id"] for r in near_sets.similar_groups(df, "id", "id", df, "id", "text").collect()}
    assert {groups[f"k{i:03d}"] for i in range(40)} == {"k000"} and groups["e2"] == "e1" and groups["long"] == "long"
    assert near_sets.similar_records(df.limit(0), "id", "id", df.limit(0), "id", "text").count() == 0


def test_similarity_join_under_skew(spark):
    rnd = random.Random(7)
    rows = [(f"o{i:03d}", " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))) for i in range(600)]
    words = [f"c{rnd.randrange(10**6)}" for _ in range(500)]
    rows += [(f"s{i:03d}", " ".join(words[: 200 + i])) for i in range(300)]  # a third of all texts hold one another
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r["id_a"], r["id_b"]) for r in near_sets.similar_records(df, "id", "id", df, "id", "text").collect()}
    near = {(f"s{i:03d}", f"s{j:03d}"): (198 + i) / (198 + j) for i, j in itertools.combinations(range(300), 2)}
    want = {p for p, s in near.items() if s >= 0.5}
    assert not got - want
    edge = {p for p in want if near[p] < 0.6}
    assert len(got & want) >= 0.99 * len(want) and len(got & edge) >= 0.99 * len(edge)


@pytest.mark.parametrize(("total", "share"), [(100_000, 1 / 3), (10**7, 0.3), (10**9, 0.1), (10**9, 0.01)])
def test_similarity_join_meets_contained_sets_on_long_paths(total, share):
    rnd, shares, pairs = np.random.default_rng(1), np.full(near_sets.CELLS, share, np.float32), 150
    sets = []
    for _ in range(pairs):
        y = np.unique(rnd.integers(0, 2**32, 200, dtype=np.uint32))
        sets += [y, np.sort(rnd.permutation(y)[: (len(y) + 1) // 2])]  # of similarity 0.5
    met = 0
    for k in range(0, len(sets), 20):
        path, owner = near_sets.leaf_paths(sets[k : k + 20], shares, total, 0.5, 0.99)
        ends = [set(path[owner == i].tolist()) for i in range(20)]
        met += sum(bool(ends[i] & ends[i + 1]) for i in range(0, 20, 2))
    assert met >= 0.97 * pairs


def test_paths_of_sets_do_not_depend_on_each_other():
    rnd, share = np.random.default_rng(2), np.full(near_sets.CELLS, 0.02, np.float32)
    sets = [np.unique(rnd.integers(0, 2**32, n, dtype=np.uint32)) for n in (1, 2, 3, 40, 900, 40, 7)]
    path, owner = near_sets.leaf_paths(sets, share, 10**6, 0.5, 0.99)
    for i, x in enumerate(sets):
        alone, _ = near_sets.leaf_paths([x], share, 10**6, 0.5, 0.99)
        assert len(alone) and set(path[owner == i].tolist()) == set(alone.tolist())


def test_mapping(spark):
    ref = spark.createDataFrame([("Água", ["agua da rede"]), ("Gás canalizado", []), ("Obras em habitação", None)], "topic string, aliases array<string>")
    cases = {
        "GAS CANALIZADO": "Gás canalizado", "Gás canalziado": "Gás canalizado", "T12 - Gás_canalizado ?": "Gás canalizado", "GÃ¡s canalizado": "Gás canalizado", "Obrasemhabitação": "Obras em habitação",
        "habitação, Obras em": "Obras em habitação", "Obras em habi.": "Obras em habitação", "água da rede": "Água", "Astrologia": "unmapped", "???": "unmapped", "x" * 5000: "unmapped",
    }
    df = spark.createDataFrame([(v, 1) for v in cases] * 2 + [(None, 1), ("  ", 1), (" ", 1)], "value string, entry int")
    assert {r["value"]: r["entry"] for r in mapping.map_values(df, "value", ref, "topic", "aliases").collect()} == cases
    assert mapping.map_values(df.limit(0), "value", ref, "topic", "aliases").count() == 0
    empty = mapping.map_values(df, "value", ref.limit(0), "topic", "aliases").select("entry").distinct().collect()
    assert [r["entry"] for r in empty] == ["unmapped"]


def test_short_texts_of_equal_narrow_hashes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "S32", np.uint64(62))  # narrow hashes of two bits only
    df = spark.createDataFrame([(f"k{i:02d}", f"uma{i}") for i in range(40)] + [("same", "UMA7")], "id string, text string")
    full = [near_sets.shingles(f"uma{i}", 3) for i in range(40)]
    assert len({x.tobytes() for x in full}) == 40 and all(len(near_sets.unpack(x.tobytes(), 1)) == 1 for x in full)
    monkeypatch.undo()
    got = {(r["id_a"], r["id_b"]) for r in near_sets.similar_records(df, "id", "id", df, "id", "text").collect()}
    assert got == {("k07", "same")}


def test_shingle_sets_of_many_texts_against_each_alone():
    rnd = random.Random(5)
    many = ["!!!", "uma só", "Uma SÓ!", "a b c " * 5000, "é½² x–y “q” _a_ a_b @c|d-e", "ΑΣ ΑΣ, ΑΣ-Α", "\x1c\xa0x", "日本語 テキスト 日本"]
    many += ["".join(rnd.choices("ab1_@|- .\t\r\xa0 “–½²éΣσ", k=rnd.randrange(90))) for _ in range(500)]
    values, sizes = near_sets.shingle_sets(many, 3)
    for text, own in zip(many, np.split(values, np.cumsum(sizes)[:-1])):
        words = re.findall(r"\w+", text.lower())
        assert len(own) == (len({tuple(words[k : k + 3]) for k in range(len(words) - 2)}) or 1) and (own[1:] > own[:-1]).all()
        assert own.tolist() == near_sets.shingles(text, 3).tolist() == near_sets.shingles("\n".join(words), 3).tolist()
    x, size = near_sets.uniques((values >> near_sets.S32).astype(np.uint32), sizes)
    rows = near_sets.sketches(x, size)
    assert all((near_sets.sketches(y, np.array([len(y)])) == r).all() for y, r in zip(np.split(x, np.cumsum(size)[:-1]), rows))


def test_pair_that_meets_at_many_paths_is_found_once(spark):
    rows = [(path, bytes([k]), 100, 0, 0, 0, 0) for path in range(6000) for k in (2, 1, 2)]
    df = spark.createDataFrame(rows, "path bigint, cls binary, n int, s1 bigint, s2 bigint, s3 bigint, s4 bigint").coalesce(1).sortWithinPartitions("path")
    found = [(bytes(r["a"]), bytes(r["b"])) for r in near_sets.bucket_pairs(df, 0.5).collect()]
    assert set(found) == {(b"\1", b"\2")} and len(found) <= -(-len(rows) // near_sets.READY)


def test_pairs_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "PART", 4)
    rows = [(f"k{i:02d}", "o mesmo texto para todos") for i in range(30)] + [("z", "outro texto sem parceiro algum")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r["id_a"], r["id_b"]) for r in near_sets.similar_records(df, "id", "id", df, "id", "text").collect()}
    assert got == set(itertools.combinations([f"k{i:02d}" for i in range(30)], 2))


def keys(df) -> set:
    return {r["sample_key"] for r in df.filter("selected").collect()}


def test_ledger_is_stable(spark, tmp_path):
    schema = "id string, imported string, step int"
    rows = [(f"id{i}", f"2024-{1 + i % 12:02d}-01", 0) for i in range(500)]
    first = spark.createDataFrame(rows + rows[:50] + [(None, "2024-01-01", 0), ("odd", None, 0), ("bad", "soon", 0)], schema)
    grow = lambda df, name: ledger.grow(df, "id", "imported", 0.1, str(tmp_path / name))
    x = keys(grow(first, "a"))
    assert x == keys(grow(first.repartition(7), "b")) == keys(grow(first, "a")) and len(x) == 51
    later = first.union(spark.createDataFrame([(f"new{i}", "2025-03-01", 0) for i in range(300)], schema))
    z = keys(grow(later, "c"))  # a ledger of its own, later dates
    assert x <= z and len(z) == 81
    for name, date in (("late", "2024-01-01"), ("old", "2019-05-05"), ("between", "2024-06-15"), ("undated", None)):
        before = keys(grow(first, name))
        more = first.union(spark.createDataFrame([(f"{name}{i}", date, 0) for i in range(300)], schema))
        after = keys(grow(more, name))
        assert before == x <= after and len(after) == 81
        assert keys(grow(more.limit(0), name)) == after  # nothing is forgotten
    gone = later.filter("id not like 'id1%'")
    step = grow(gone, "a")
    assert x <= keys(step)  # deleted records stay in the ledger
    assert {r["sample_key"] for r in ledger.present(step, gone, "id").collect()} == {k for k in keys(step) if not k.startswith("id1")}
    assert grow(first.limit(0), "d").count() == 0
    assert keys(ledger.grow(first, "id", "imported", 1.0, str(tmp_path / "all"))) == {f"id{i}" for i in range(500)} | {"odd", "bad"}


def test_ledger_replaces_a_run_that_broke_off(spark, tmp_path):
    df = spark.createDataFrame([(f"id{i}",) for i in range(100)], "id string")
    first = keys(ledger.grow(df, "id", None, 0.2, str(tmp_path / "l")))
    (tmp_path / "l" / "run=00000001").mkdir()
    (tmp_path / "l" / "run=00000001" / "part-0.parquet").write_bytes(b"broken")
    more = df.union(spark.createDataFrame([(f"n{i}",) for i in range(50)], "id string"))
    second = keys(ledger.grow(more, "id", None, 0.2, str(tmp_path / "l")))
    assert first <= second and len(first) == 20 and len(second) == 30
    lower = ledger.grow(more.union(spark.createDataFrame([("late",)], "id string")), "id", None, 0.1, str(tmp_path / "l"))
    assert keys(lower) == second and lower.count() == 151


def test_quota(spark):
    rows = [(f"a{i}", "big") for i in range(800)] + [(f"b{i}", "mid") for i in range(150)] + [(f"c{i}", "rare") for i in range(2)] + [(f"d{i}", "other") for i in range(48)]
    df = spark.createDataFrame(rows + rows[:100] + [(None, "big"), ("z", None)], "id string, cat string")
    targets = spark.createDataFrame([("big", 0.5, 5), ("mid", 0.4, 5), ("rare", 0.05, 3), ("never", 0.05, 1), (None, 0.1, 1)], "category string, target_share double, min_rows bigint")
    sample, report = quota.quota_sample(df, "id", "cat", targets, size=100)
    got = {r["category"]: r for r in report.collect()}
    assert [got[c]["wanted"] for c in ("big", "mid", "rare", "never")] == [50, 40, 5, 5]
    assert got["rare"]["sampled"] == 2 and not got["rare"]["attainable"] and not got["never"]["attainable"]
    assert got["big"]["sampled"] >= 50 and got["mid"]["sampled"] >= 40
    keys = [r["rec_key"] for r in sample.collect()]
    assert len(keys) == len(set(keys)) == 100
    again, _ = quota.quota_sample(df.repartition(9), "id", "cat", targets, size=100)
    assert {r["rec_key"] for r in again.collect()} == set(keys)
    none, empty = quota.quota_sample(df.limit(0), "id", "cat", targets)
    assert none.count() == 0 and not any(r["attainable"] for r in empty.collect() if r["wanted"])


def test_repair_spreads_what_is_short():
    have = {"a": 1000, "b": 1000, "c": 1000}
    got = quota.repair(have, {"a": 60, "b": 60, "c": 60}, dict.fromkeys("abc", 5), 90, 46)
    assert sorted(got.values()) == [30, 30, 30]


def test_repair_of_records_with_two_categories():
    have = {"a": 100, "b": 100, "a\x1fb": 100, "c": 500, "": 3}
    wanted = {"a": 60, "b": 60, "c": 20}
    got = quota.repair(have, wanted, {"a": 5, "b": 5, "c": 0}, 100, 46)
    assert sum(got.values()) == 100 and {c: quota.tally(got, c) for c in wanted} == wanted and got["a\x1fb"] >= 40


def test_quota_of_records_with_two_categories(spark):
    rows = [(f"x{i}", c) for i in range(60) for c in ("a", "b")] + [(f"a{i}", "a") for i in range(60)] + [(f"c{i}", "c") for i in range(200)] + [(f"d{i}", "d") for i in range(100)]
    df = spark.createDataFrame(rows + rows[:9], "id string, cat string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.25, 1)], "category string, target_share double, min_rows bigint")
    sample, report = quota.quota_sample(df, "id", "cat", targets, size=80)
    got = {r["category"]: (r["sampled"], r["attainable"]) for r in report.collect()}
    assert got == {"a": (40, True), "b": (40, True), "c": (20, True)}
    assert sample.count() == 80 and sample.filter("signature like '%b%' and rec_key not like 'x%'").count() == 0
