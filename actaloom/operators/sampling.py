"""Deterministic samples: stratified by hash, and pilots with mandatory members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaloom.operators.hash_pick import lowest_by_hash, priority
from actaloom.operators.paging import ranked

SALT = "pilot-precision-v1"


def precision_sample(edges: DataFrame, n: int, key: str = "assertion_id", stratum: str = "predicate", least: int = 3, salt: str = SALT) -> DataFrame:
    """n rows ordered by SHA-256 of salt and key: up to `least` of every stratum first, the rest by the order alone.

    The same for any order and partitioning of the input. Raises ValueError if n exceeds the
    rows. Strata must be few (they are ranked by their smallest hashes, capped per stratum
    before any sort), rows of null key or stratum are left out, repeated keys count once.
    """
    rows = edges.filter(F.col(key).isNotNull() & F.col(stratum).isNotNull()).groupBy(key).agg(F.min(stratum).alias(stratum))
    digest = F.sha2(F.concat_ws(":", F.lit(salt), F.col(key)), 256)
    total = rows.count()
    if n > total:
        raise ValueError(f"sample of {n} from {total} rows")
    ranked = rows.withColumn("digest", digest).withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy("digest", key))).filter(F.col("_rn") <= max(n, least))
    first = ranked.withColumn("_first", F.col("_rn") <= least)
    picked = first.orderBy(F.desc("_first"), "digest", key).limit(n)
    return picked.select(key, stratum, "digest")


def pilot(df: DataFrame, key: str, mandatory: DataFrame, n: int, strata: list[str], seed: int = 46) -> DataFrame:
    """(key, chosen): all mandatory keys, then the strata's turn by hash until n are reached.

    In each stratum rows are ranked by hash; all first ones come before all second ones. No
    stratum gives more than n rows, so only its n lowest hashes are ranked.
    """
    keys = df.groupBy(key).agg(*(F.min(F.coalesce(F.col(s), F.lit("unknown"))).alias(s) for s in strata))
    must = mandatory.select(key).distinct().join(keys.select(key), key, "left_semi")
    left = max(0, n - must.count())
    rest = keys.join(must, key, "left_anti").withColumn("_s", F.concat_ws("\x1f", *strata))
    quotas = rest.select("_s").distinct().withColumn("take", F.lit(left))
    few = lowest_by_hash(rest, key, quotas, "_s", str(seed)).withColumn("_p", priority(key, str(seed)))
    turn = F.row_number().over(Window.partitionBy("_s").orderBy("_p", key))
    filled = few.withColumn("_t", turn).orderBy("_t", "_p", key).limit(left)
    return must.withColumn("chosen", F.lit("mandatory")).unionByName(filled.select(key, F.lit("stratum").alias("chosen")))


def batches(df: DataFrame, key: str, size: int, salt: str = "batch") -> DataFrame:
    """(key, batch): distinct keys in batches of exactly `size` by the order of their hashes, the last one smaller."""
    keys = df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_p", priority(key, salt)).withColumn("_all", F.lit(0))
    rn = ranked(keys, "_all", ["_p", key])
    return rn.select(key, (F.floor((F.col("rn") - 1) / size) + 1).cast("bigint").alias("batch"))


__all__ = ["batches", "lowest_by_hash", "pilot", "precision_sample"]
