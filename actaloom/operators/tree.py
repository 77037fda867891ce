"""Folder trees as flat tables of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(path: str) -> F.Column:
    """All ancestors of a path and itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folder_tree(df: DataFrame, folder: str) -> DataFrame:
    """(path, name, depth, parent, n): every folder with the documents in and under it."""
    rows = df.filter(F.col(folder).isNotNull() & (F.col(folder) != "")).select(F.explode(prefixes(folder)).alias("path"))
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(F.lit(""))
    return counts.select("path", F.element_at(parts, -1).alias("name"), F.size(parts).cast("bigint").alias("depth"), parent.alias("parent"), "n")


def tree_filter(df: DataFrame, folder: str, texts: list[str], query: str) -> DataFrame:
    """(path): folders kept for a query: their path or one of their documents contains it, or a folder below is kept."""
    q = query.lower()
    hit = F.lower(F.col(folder)).contains(q) | F.lower(F.concat_ws(" ", *texts)).contains(q)
    kept = df.filter(F.col(folder).isNotNull() & (F.col(folder) != "") & hit).select(F.explode(prefixes(folder)).alias("path"))
    return kept.distinct()
