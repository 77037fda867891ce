"""Exact selection of the rows of lowest hash, without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the hash histogram of one group.
BINS = 4096


def priority(key: Column | str, salt: str) -> Column:
    """A 60-bit number from SHA-256 of salt and key: the same on every run, engine and partitioning."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), col.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def lowest_by_hash(df: DataFrame, key: str, quotas: DataFrame, group: str, salt: str, bins: int = BINS) -> DataFrame:
    """The `take` rows of each group with the lowest priority(key).

    df has unique keys; quotas has one row (group, take) for each group. A histogram of at
    most `bins` rows a group says which bins lie wholly inside the quota; only the one bin
    at the edge is ranked, so that a group of a third of all rows never meets one task.
    Groups without a quota give no rows, a quota above the group's size gives all of them.
    """
    width = (1 << 60) // bins
    rows = df.withColumn("_prio", priority(key, salt)).withColumn("_bin", F.floor(F.col("_prio") / F.lit(width)).cast("int"))
    hist = rows.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        hist.withColumn("_cum", F.sum("_n").over(upto))
        .join(quotas.select(F.col(group), F.col("take").cast("bigint").alias("_take")), group)
        .withColumn("_left", F.col("_take") - (F.col("_cum") - F.col("_n")))
        .filter(F.col("_left") > 0)
        .select(group, "_bin", "_left", "_n")
    )
    marked = rows.join(filled, [group, "_bin"])
    whole = marked.filter(F.col("_left") >= F.col("_n"))
    edge = (
        marked.filter(F.col("_left") < F.col("_n"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_prio", key)))
        .filter(F.col("_rank") <= F.col("_left"))
        .drop("_rank")
    )
    return whole.unionByName(edge).drop("_bin", "_left", "_n", "_prio")
