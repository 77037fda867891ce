"""Facets: counts of dimension values, many-valued dimensions, all dimensions in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaloom.functions.text import first_filled


def facet_counts(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """(value, n), null and empty values as "unknown"; order n descending, then value."""
    col = F.col(value) if isinstance(value, str) else value
    return df.groupBy(first_filled(col).alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def facet_multi(df: DataFrame, values: str, name: str = "value") -> DataFrame:
    """Counts of an array's values; an empty or null array counts as "unmapped"."""
    filled = F.when(F.size(F.coalesce(F.col(values), F.array().cast("array<string>"))) == 0, F.array(F.lit("unmapped"))).otherwise(F.col(values))
    return df.select(F.explode(filled).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def facet_distinct(df: DataFrame, dims: list[str]) -> DataFrame:
    """One row: the number of different filled values of each dimension."""
    return df.agg(*(F.count_distinct(F.nullif(F.col(d), F.lit(""))).alias(d) for d in dims))


def filter_facets(df: DataFrame, **wanted: str) -> DataFrame:
    """Equality on every facet that is asked for; "" asks nothing."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value) if value else df
    return df


def with_taxonomy(df: DataFrame, label: str, taxonomy: DataFrame) -> DataFrame:
    """df with topic_kind, sector and categories of its exact label; "unmapped" and no category if the list lacks it.

    taxonomy is a reference list; Spark broadcasts it if its size is known to be small.
    """
    tax = taxonomy.select(F.col("topic").alias(label), "topic_kind", "sector", F.col("categories").alias("topic_categories"))
    joined = df.join(tax, label, "left")
    return joined.withColumn("topic_kind", F.coalesce("topic_kind", F.lit("unmapped"))).withColumn("sector", first_filled(F.col("sector"), default="unmapped")).withColumn("topic_categories", F.coalesce("topic_categories", F.array().cast("array<string>")))
