"""Integrity checks and reports; each gives rows, none stops a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.operators.graph import latest

#: Bytes of one file that fail, and of the published artifact. Fixed values.
FILE_LIMIT, ARTIFACT_LIMIT = 104_857_600, 996_147_200
IGNORED = (".git", "node_modules", ".astro")


def publication_check(files: DataFrame, path: str, size: str, artifact: tuple[str, ...] = ("site", "dist"), limit: int = ARTIFACT_LIMIT, file_limit: int = FILE_LIMIT) -> DataFrame:
    """One row (files, oversized, artifact_bytes, ok) over (path, size)."""
    parts = F.split(path, "/")
    rows = files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))))
    inside = F.lit(True)
    for part in artifact:
        inside = inside & F.array_contains(parts, part)
    out = rows.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum((F.col(size) >= file_limit).cast("bigint")), F.lit(0)).alias("oversized"),
        F.coalesce(F.sum(F.when(inside, F.col(size)).otherwise(0)), F.lit(0)).cast("bigint").alias("artifact_bytes"),
    )
    return out.withColumn("ok", (F.col("oversized") == 0) & (F.col("artifact_bytes") <= limit))


def parity(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a flag for each side): keys that some side lacks."""
    out = None
    for name, df in sides.items():
        one = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
        out = one if out is None else out.join(one, key, "full_outer")
    flags = [F.coalesce(F.col(n), F.lit(False)).alias(n) for n in sides]
    allin = F.lit(True)
    for n in sides:
        allin = allin & F.coalesce(F.col(n), F.lit(False))
    return out.filter(~allin).select(key, *flags)


def aggregate_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a SHA-256 over all rows, the same for any order and partitioning.

    The hashes of the rows are added up in four parts, so every task sends one row on.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.select(row.alias("h")).agg(*(F.coalesce(part(k), F.lit(0)).cast("string").alias(f"p{k}") for k in range(4)))
    return sums.select(F.sha2(F.concat_ws(":", "p0", "p1", "p2", "p3"), 256).alias("digest"))


def lint_report(catalog: DataFrame, pages: DataFrame, edges: DataFrame, others: DataFrame | None = None, years: int = 10) -> DataFrame:
    """(rule, n): violations by rule.

    others: further catalogs' (rel_raw), whose pages are no orphans. A citation is missing where a
    citing edge has no evidence; an authority is unverified where its edge's latest record is
    not accepted; a record is stale if its year lies more than `years` before its import;
    is_empty is wrong where a page is said to be empty and has text (it is never filtered on).
    """
    known = catalog.select("rel_raw") if others is None else catalog.select("rel_raw").union(others.select("rel_raw"))
    now = latest(edges.filter("assertion_id is not null").select("assertion_id", "predicate", "review_state", "loaded_at", "recorded_at"), "assertion_id", ["loaded_at", "recorded_at"])
    year = F.expr("try_cast(year as int)")
    rules = {
        "catalog-without-page": catalog.select("rel_raw").filter("rel_raw is not null").distinct().join(pages.select("rel_raw"), "rel_raw", "left_anti"),
        "page-without-catalog": pages.select("rel_raw").filter("rel_raw is not null").distinct().join(known.filter("rel_raw is not null"), "rel_raw", "left_anti"),
        "repeated-id": catalog.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "accepted-without-evidence": edges.filter((F.col("review_state") == "accepted") & (F.coalesce("evidence", F.lit("")) == "")),
        "missing-citation": edges.filter(F.col("predicate").startswith("cites_") & (F.coalesce("evidence", F.lit("")) == "")),
        "unverified-authority": now.filter("predicate = 'cites_authority' and coalesce(review_state, '') <> 'accepted'"),
        "stale-as-of": catalog.filter(F.expr("try_cast(substr(imported, 1, 4) as int)") - year > years),
        "is-empty-wrong": pages.filter(F.col("is_empty").eqNullSafe("True") & F.col("text").rlike(r"\S")),
    }
    out = None
    for name, df in rules.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionAll(one)
    return out
