"""Families of equal texts, and vectors that are alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaloom.functions.identity import content_hash
from actaloom.operators.paging import ranked


def families(df: DataFrame, key: str, text: str) -> DataFrame:
    """(family_id, content_hash, n): texts that more than one key has. Null texts belong to none."""
    rows = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), content_hash(F.col(text)).alias("content_hash")).distinct()
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat(F.lit("family_"), F.substring("content_hash", 1, 16)).alias("family_id"), "content_hash", "n")


def family_members(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(family_id, member, place): a row for each member, ordered by `order`, then key.

    Families are kept as rows, never gathered in arrays, and a large one is ranked by many tasks.
    """
    rows = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("member"), content_hash(F.col(text)).alias("h")).agg(F.min(order).alias("o"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    placed = ranked(rows.join(shared, "h").withColumn("o", F.coalesce("o", F.lit((1 << 62)))), "h", ["o", "member"], "place")
    return placed.select(F.concat(F.lit("family_"), F.substring("h", 1, 16)).alias("family_id"), "member", "place")


def duplicate_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, representative, copies): each key of a shared text with the least key of it, and the number of the others."""
    rows = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), content_hash(F.col(text)).alias("h")).distinct()
    least = rows.groupBy("h").agg(F.min("k").alias("representative"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(least, "h").select(F.col("k").alias(key), "representative", (F.col("n") - 1).alias("copies"))


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query, key, rank, cosine): the k rows nearest to each query vector by exact cosine, itself left out.

    Rows and queries are cut into blocks of about `block` by hash; each pair of blocks is one
    task, which returns its own k best, and the best of these are ranked. Null vectors and
    vectors of norm 0 have no neighbours; ties go to the lesser key.
    """
    total, asked = df.count(), queries.count()
    nb, nq = max(1, -(-total // block)), max(1, -(-asked // block))
    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(nb)).alias("b"), F.lit(False).alias("q")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    ask = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))).alias("b"), F.lit(True).alias("q"), F.pmod(F.xxhash64(key), F.lit(nq)).cast("int").alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf.q], pdf[~pdf.q]
        if not len(q) or not len(r):
            return pd.DataFrame({"query": [], "key": [], "cosine": []})
        a, b = np.stack(q.v.to_list()), np.stack(r.v.to_list())
        na, nb_ = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        s = (a / np.where(na, na, 1)[:, None]) @ (b / np.where(nb_, nb_, 1)[:, None]).T
        s[:, nb_ == 0] = -np.inf
        s[na == 0] = -np.inf
        s[q.id.to_numpy()[:, None] == r.id.to_numpy()[None, :]] = -np.inf
        ids, out = r.id.to_numpy(), []
        for i, name in enumerate(q.id):
            best = np.lexsort((ids, -s[i].round(9)))[:k]
            out += [(name, ids[j], float(s[i, j])) for j in best if s[i, j] > -np.inf]
        return pd.DataFrame(out, columns=["query", "key", "cosine"])

    near = rows.unionByName(ask).groupBy("b", "c").applyInPandas(run, f"query {kind}, key {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "key")
    return near.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).withColumn("cosine", F.round("cosine", 6))
