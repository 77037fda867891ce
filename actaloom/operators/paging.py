"""Pages, batches and caps of ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaloom.session import stored


def ranked(df: DataFrame, dim: str, order: list[str], name: str = "rn") -> DataFrame:
    """df with the row number of each row within its value of dim. order must be total.

    Rows are sorted by range, so that a value of a third of all rows spreads over many tasks;
    each task counts its own rows, and the counts of the tasks before it are added.
    """
    placed = stored(df.repartitionByRange(dim, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    local = F.row_number().over(Window.partitionBy("_part", dim).orderBy(*order))
    sizes = placed.groupBy("_part", dim).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(dim).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", F.col(dim).alias("_dim"), before.alias("_before"))
    rows = placed.withColumn("_local", local)
    joined = rows.join(offsets, (rows["_part"] == offsets["_part"]) & rows[dim].eqNullSafe(offsets["_dim"]))
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name))


def paginate(df: DataFrame, dim: str, order: list[str], size: int = 200) -> DataFrame:
    """df with its row number and page within each value of dim. order must be total."""
    return ranked(df, dim, order).withColumn("page", (F.floor((F.col("rn") - 1) / size) + 1).cast("bigint"))


def page_index(df: DataFrame, dim: str, size: int = 200) -> DataFrame:
    """(dim, page, links, previous, next): the pages of each value, counted without sorting rows."""
    totals = df.groupBy(dim).agg(F.count(F.lit(1)).alias("n")).withColumn("pages", F.ceil(F.col("n") / size))
    pages = totals.select(dim, "n", "pages", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    return pages.select(
        dim,
        F.col("page").cast("bigint").alias("page"),
        F.least(F.lit(size), F.col("n") - (F.col("page") - 1) * size).cast("bigint").alias("links"),
        F.when(F.col("page") > 1, F.col("page") - 1).cast("bigint").alias("previous"),
        F.when(F.col("page") < F.col("pages"), F.col("page") + 1).cast("bigint").alias("next"),
    )


def top_of_group(df: DataFrame, group: str, order: list, cap: int = 250) -> DataFrame:
    """The first `cap` rows of each group with their rank and whether more exist."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).filter(F.col("rn") <= cap)
    sizes = df.groupBy(group).agg((F.count(F.lit(1)) > cap).alias("overflow"))
    return ranked.join(sizes, group)
