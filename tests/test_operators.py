from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from actaloom.operators import families, graph, hash_pick, merge, review, sampling, search, texts, tree
from actaloom.streaming import ingest


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (52, 51)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in (50, 51, 52)} == {50}


def test_lowest_by_hash_is_exact(spark):
    rows = [(f"k{i}", "hot" if i % 3 else f"g{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, g string").withColumn("p", hash_pick.priority("k", "s"))
    quotas = spark.createDataFrame([("hot", 700), ("g0", 3), ("g1", 0), ("none", 5)], "g string, take bigint")
    got = hash_pick.lowest_by_hash(df, "k", quotas, "g", "s", bins=64).collect()
    for g, take in (("hot", 700), ("g0", 3)):
        want = sorted((r["p"], r["k"]) for r in df.filter(F.col("g") == g).collect())[:take]
        assert sorted((r["p"], r["k"]) for r in got if r["g"] == g) == want
    assert {r["g"] for r in got} == {"hot", "g0"}


def test_precision_sample(spark):
    rows = [(f"conn_{i:024x}", ("about_topic", "cites_instrument", "document_of")[i % 3]) for i in range(30)]
    a = sampling.precision_sample(spark.createDataFrame(rows, "assertion_id string, predicate string"), 12).collect()
    b = sampling.precision_sample(spark.createDataFrame(rows[::-1], "assertion_id string, predicate string"), 12).collect()
    assert {r["assertion_id"] for r in a} == {r["assertion_id"] for r in b} and len(a) == 12
    assert len({r["predicate"] for r in a}) == 3
    with pytest.raises(ValueError):
        sampling.precision_sample(spark.createDataFrame(rows, "assertion_id string, predicate string"), 31)


def test_tree(spark):
    df = spark.createDataFrame([("A/B", "x"), ("A/C", "y"), (None, "z"), ("", "q")], "folder string, title string")
    got = {r["path"]: r["n"] for r in tree.folder_tree(df, "folder").collect()}
    assert got == {"A": 2, "A/B": 1, "A/C": 1}
    assert {r["path"] for r in tree.tree_filter(df, "folder", ["title"], "Y").collect()} == {"A", "A/C"}


def test_payload(spark):
    rows = [("1", "Voos", None), ("2", "Voos", ["c"])]
    nodes = graph.payload_nodes(spark.createDataFrame(rows, "id string, topic string, categories array<string>")).collect()
    assert [r["n"] for r in nodes if r["type"] == "root"] == [2]
    assert sum(r["type"] == "group" for r in nodes) == 5
    assert [(r["node"], r["n"]) for r in nodes if r["type"] == "topic"] == [("topic:voos", 2)]


def test_three_way_merge(spark):
    def kv(**d):
        return spark.createDataFrame(list(d.items()), "k string, v string")

    got = {r["k"]: r["v"] for r in merge.three_way(kv(old="1", a="1", z="1"), kv(a="2", app="x"), kv(old="1", a="1", z="1", note="n"), "k", "v").collect()}
    assert got == {"a": "2", "app": "x", "note": "n"}
    mine = spark.createDataFrame([("c", 12, "high")], "id string, at int, p string")
    other = spark.createDataFrame([("c", 8, "low"), ("d", 1, "x")], "id string, at int, p string")
    assert {r["id"]: r["p"] for r in merge.merge_records(mine, other, "id", "at").collect()} == {"c": "high", "d": "x"}


def test_document_merge(spark):
    def docs(**fields):
        return spark.createDataFrame([("x", k, json.dumps(v)) for k, v in fields.items()], "doc string, field string, value string")

    def merged(base, local, remote):
        rows = merge.merge_documents(docs(**base), docs(**local), docs(**remote), "doc", "field", "value").collect()
        return {r["field"]: json.loads(r["value"]) for r in rows}

    both = {"app": 1, "old": 1, "items": [{"id": "a"}, {"id": "z"}]}
    assert merged({"app": 1}, {"app": 2, "n": 2}, {"app": 1, "note": "keep"}) == {"app": 2, "n": 2, "note": "keep"}
    assert merged(both, {"app": 1, "items": [{"id": "a"}]}, both | {"note": "new"}) == {"app": 1, "items": [{"id": "a"}], "note": "new"}
    low, high = {"id": "c", "updatedAt": "2026-10-16T08:00", "n": {"p": "Low", "s": "x"}}, {"id": "c", "updatedAt": "2026-10-16T12:00", "n": {"p": "High"}}
    none = {"app": 1}
    assert merged(none, none | {"items": [high]}, none | {"items": [low]})["items"] == [high]
    assert merged(none, none | {"items": [low]}, none | {"items": [high]})["items"] == [high]
    mine, theirs = [{"id": "a", "v": 9}, {"id": "c", "v": 3}], [{"id": "a", "v": 1}, {"id": "b", "v": 2}]
    assert merged(none, none | {"items": mine}, none | {"items": theirs})["items"] == [{"id": "a", "v": 9}, {"id": "b", "v": 2}, {"id": "c", "v": 3}]
    assert merged(both, both | {"items": []}, both)["items"] == []
    assert merged({"app": 1, "tags": ["a"]}, {"app": 1, "tags": ["a", "b"]}, {"app": 1, "tags": ["a"]})["tags"] == ["a", "b"]  # no records: a plain field


def test_review(spark):
    rows = [("a", "accepted", 1), ("a", "accepted", 2), ("b", "accepted", 1), ("b", "rejected", 3), ("c", "rejected", 1), ("c", "rejected", 2), ("d", "accepted", 1), ("e", "disputed", 1), ("e", "accepted", 2), ("f", "accepted", 1), ("f", "accepted", 5), (None, "accepted", 1)]
    two = review.reviewers(spark.createDataFrame(rows, "k string, s string, at int"), "k", "s", ["at"])
    held = spark.createDataFrame([("a", True), ("f", False)], "k string, supported boolean")
    got = {r["k"]: r["g"] for r in two.join(held, "k", "left").select("k", review.gate(F.col("first"), F.col("second"), F.col("supported")).alias("g")).collect()}
    assert got == {"a": "accepted", "b": "disputed", "c": "rejected", "d": "unreviewed", "e": "unreviewed", "f": "rejected"}
    assert tuple(review.agreement(two, "first", "second").first()) == (4, 3, 75.0)
    sample = spark.createDataFrame([("a",), ("f",), ("x",)], "k string")
    assert tuple(review.precision(sample, held, "k", "supported").first()) == (3, 1, 33.3)
    steps = spark.createDataFrame([(a, b) for a in (review.MANUAL, review.IMPORTED, review.REVIEWED) for b in (review.MANUAL, review.IMPORTED, review.REVIEWED)], "a string, b string")
    assert {(r["a"], r["b"]) for r in steps.filter(review.allowed(F.col("a"), F.col("b")) & (F.col("a") != F.col("b"))).collect()} == {(review.MANUAL, review.REVIEWED), (review.IMPORTED, review.REVIEWED)}


def test_one_text_and_supported(spark):
    rows = [("a", "x y"), ("a", "x y"), ("b", "2 q"), ("b", "1 q"), ("c", None)]
    pages = spark.createDataFrame(rows, "k string, t string")
    claims = spark.createDataFrame([(1, "a", "y"), (1, "a", "y"), (2, "b", "2"), (3, "b", "1 q"), (4, "c", "x"), (5, "gone", "x"), (6, None, "x"), (7, "a", None)], "n int, k string, quote string")
    got = {(r["n"], r["supported"]) for r in texts.supported(claims, "k", "quote", pages, "k", "t").collect()}
    assert got == {(1, True), (2, False), (3, True)}


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "lei lei prazo"), (2, "Lei, custo"), (3, None), (4, "prazo"), (5, "")], "k int, t string")
    df.write.parquet(str(tmp_path / "in"))
    index = search.indexed(spark.read.parquet(str(tmp_path / "in")), "k", "t")
    assert {r["k"] for r in search.bm25(index, "LEI").collect()} == {1, 2} and (index.docs, index.mean) == (4, 1.5)
    assert {r["k"] for r in search.bm25(index, "lei prazo").collect()} == {1}
    assert search.bm25(index, "").count() == search.bm25(index, "nada lei").count() == 0
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert search.bm25(search.indexed(spark.read.parquet(str(tmp_path / "none")), "k", "t"), "lei").count() == 0


def test_batches_are_exact(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(103)] + [("k1",), (None,)], "k string")
    rows = sampling.batches(df, "k", 25).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in rows} == {1: 25, 2: 25, 3: 25, 4: 25, 5: 3}


def test_retry_once():
    state, puts = {"v": 1}, []

    def write(fails):
        def run(_, version):
            puts.append(version)
            if len(puts) <= fails:
                state["v"] += 1
                raise merge.Conflict

        return run

    assert merge.save_with_retry(lambda: ("r", state["v"]), lambda r: r + "!", write(1)) == "r!" and puts == [1, 2]
    puts.clear()
    with pytest.raises(merge.Conflict):
        merge.save_with_retry(lambda: ("r", state["v"]), lambda r: r, write(9))
    assert len(puts) == 2


def test_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), (None, "x")], "k string, h string")
    status = lambda df: {r["k"]: r["status"] for r in ingest.ingest_batch(df, str(tmp_path / "s"), "k", "h").collect()}
    assert status(rows) == {"a": "written", "b": "written"}
    assert status(rows) == {"a": "unchanged", "b": "unchanged"}
    assert status(spark.createDataFrame([("a", "2"), ("c", "1")], "k string, h string")) == {"a": "protected", "c": "written"}
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    rows.write.parquet(str(tmp_path / "in"))
    ingest.ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), "k", "h", str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_nearest_edges(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(98, [0.0, 0.0]), (99, None)], "id int, v array<float>")
    got = families.nearest(df, "id", "v", df.filter("id in (0, 98, 99)"), k=5, block=16).orderBy("rank").collect()
    assert [r["key"] for r in got] == [7, 14, 21, 28, 35] and {r["query"] for r in got} == {0}
