"""Writers: JSON artifacts, the partitioned raw store, managed blocks, copies, the log."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaloom.operators.paging import ranked
from actaloom.session import cut, file_system

#: Marks of the managed part of a page, and of its frontmatter.
BEGIN, END = "<!-- GRAPH:BEGIN -->", "<!-- GRAPH:END -->"
HEAD_BEGIN, HEAD_END = "# GRAPH:BEGIN", "# GRAPH:END"


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls left out; any number of files."""
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str, name: str = "documents") -> None:
    """{name: [rows]} as one JSON text of any size: the files of the folder, one after another, hold it, a row a line."""
    rows = ranked(df.select(F.to_json(F.struct(*df.columns)).alias("json"), F.lit(0).alias("_all")).withColumn("_id", F.monotonically_increasing_id()), "_all", ["json", "_id"], "place")
    body = rows.select("place", F.concat(F.when(F.col("place") > 1, F.lit(",")).otherwise(F.lit("")), F.col("json")).alias("line"))
    spark = df.sparkSession
    ends = spark.createDataFrame([(0, f"{{{json.dumps(name)}:["), (2**62, "]}")], "place bigint, line string")
    body.unionByName(ends).repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def write_raw_store(df: DataFrame, path: str, key: str = "id") -> None:
    """Adds the rows whose key the immutable store lacks, one folder for each website and year; a second write adds nothing."""
    spark = df.sparkSession
    fs, p = file_system(spark, path)
    rows = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    if fs.exists(p):
        rows = cut(rows.join(spark.read.parquet(path).select(F.col(key).cast(df.schema[key].dataType)), key, "left_anti"))
    rows.repartition("website", "year", F.pmod(F.xxhash64(key), F.lit(16))).write.mode("append").partitionBy("website", "year").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_block(page: Column, block: Column, begin: str = BEGIN, end: str = END) -> Column:
    """page with the text between the block's marks replaced, the rest kept; marks are added at the end if absent."""
    start, stop = F.instr(page, begin), F.instr(page, end)
    body = F.concat(F.lit(begin + "\n"), block, F.lit("\n" + end))
    inside = F.concat(F.substr(page, F.lit(1), start - 1), body, F.substr(page, stop + F.lit(len(end)), F.length(page)))
    return F.when((start > 0) & (stop > start), inside).otherwise(F.concat(page, F.lit("\n\n"), body))


def replace_head_block(page: Column, block: Column) -> Column:
    """page with the managed lines of its frontmatter replaced, or put before its end if there are none; a page without frontmatter stays."""
    lines = F.split(page, "\n", -1)
    fence = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "---").cast("int") + 1
    new = F.concat(F.array(F.lit(HEAD_BEGIN)), F.split(block, "\n", -1), F.array(F.lit(HEAD_END)))
    rest = lambda a: F.slice(lines, a, F.greatest(F.size(lines) - a + 1, F.lit(0)))
    a, b = F.array_position(lines, HEAD_BEGIN).cast("int"), F.array_position(lines, HEAD_END).cast("int")
    held = (a > 1) & (b > a) & (b < fence)
    out = F.when(held, F.concat(F.slice(lines, F.lit(1), a - 1), new, rest(b + 1))).otherwise(F.concat(F.slice(lines, F.lit(1), F.greatest(fence - 1, F.lit(0))), new, rest(fence)))
    return F.when((F.element_at(lines, 1) == "---") & (fence > 1), F.array_join(out, "\n")).otherwise(page)


def write_pages(df: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Writes one file for each row, its path below root, in parallel tasks to a shared folder; returns their number. content: text or bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rel, text in zip(b["path"], b["content"]):
                to = Path(root, rel)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(text if isinstance(text, bytes) else text.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content")).filter("path is not null and content is not null")
    return rows.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_files(manifest: DataFrame, source: str, target: str) -> int:
    """Copies the manifest's files (rel) in parallel tasks to a shared folder; returns their number."""

    def run(rows):  # noqa: ANN001, ANN202
        n = 0
        for r in rows:
            to = Path(target, r["rel"])
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(Path(source, r["rel"]), to)
            n += 1
        yield n

    return sum(manifest.select("rel").rdd.mapPartitions(run).collect())
