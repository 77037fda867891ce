"""Readers: CSV corpus, JSON lines, markdown pages, PDF folders, file sizes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actaloom.functions.identity import content_hash, relative_path, stem
from actaloom.functions.text import frontmatter_list, frontmatter_value, full_text, section
from actaloom.operators.merge import incremental_status
from actaloom.operators.texts import one_text
from actaloom.session import cut, file_system

_TEXT = ["id", "title", "filename", "folder", "year", "website", "topic", "topic_raw", "rel_raw", "rel_source"]
CATALOG = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT] + [T.StructField("pdf_path", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))])
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("assertion_id", "subject", "predicate", "object", "evidence", "method", "review_state")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row a document; quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by an explicit schema; unknown keys are left out, absent ones are null."""
    return spark.read.schema(schema).json(path)


#: Keys of a source page's frontmatter that hold lists.
LISTS = ("tags", "aliases", "categories", "sectors", "doctrines", "cited_instruments", "duplicate_of")


def read_pages(spark: SparkSession, path: str, keys: tuple[str, ...] = ("id", "website", "year"), sections: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(path, a column for each key, one for each section, text) of markdown pages with frontmatter.

    keys named in LISTS are arrays. sections: column -> (heading, heading of the next section).
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.col("_metadata.file_path"))
    value = F.col("value")
    heads = [(frontmatter_list if k in LISTS else frontmatter_value)(value, k).alias(k) for k in keys]
    parts = [section(value, *names).alias(column) for column, names in (sections or {}).items()]
    return rows.select("path", *heads, *parts, full_text(value).alias("text"))


def page_values(catalog: DataFrame, pages: DataFrame, value: Column, name: str, rel: str = "rel_raw", text: str = "text") -> DataFrame:
    """catalog with `name`: an expression over the text of its page, computed where the text lies; a missing page reads as "".

    value is an expression over the column `text`; only its result is shuffled.
    """
    found = one_text(pages, rel, text).select(F.col("rel").alias(rel), F.coalesce("text", F.lit("")).alias("text")).select(rel, value.alias(name)).dropDuplicates([rel])
    empty = catalog.sparkSession.range(1).select(F.lit("").alias("text")).select(value.alias("_empty")).first()[0]
    return catalog.join(found, rel, "left").withColumn(name, F.coalesce(name, F.lit(empty)))


def page_text(catalog: DataFrame, pages: DataFrame, rel: str = "rel_raw") -> DataFrame:
    """catalog with the text of its page; a missing page reads as "". The texts themselves are joined; see page_values for what is computed of them."""
    return page_values(catalog, pages, F.col("text"), "text", rel)


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files under root, paths relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"))


def input_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each input file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_pdfs(spark: SparkSession, root: str, extractor: Callable[[bytes], str]) -> DataFrame:
    """Catalog rows of root/<website>/<year>/[folders]/<file>.pdf with the text that `extractor` makes of the bytes."""

    @F.pandas_udf("string")
    def extract(content: pd.Series) -> pd.Series:
        return content.map(extractor)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    rel = relative_path(F.col("path"), root)
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    rows = files.select(rel.alias("pdf_path"), name.alias("filename"), stem(name).alias("title"), parts[0].alias("website"), F.when(F.size(parts) > 2, parts[1]).otherwise(F.lit("unknown")).alias("year"), extract("content").alias("text"))
    return rows.withColumn("content_hash", content_hash(F.col("text")))


def import_pdfs(spark: SparkSession, root: str, store: str, extractor: Callable[[bytes], str]) -> tuple[DataFrame, DataFrame]:
    """(catalog, protected) after one import of root into the store: new files are added, changed texts reported and never written.

    catalog: all files of the store; protected: pdf_path of those whose text differs from the
    stored one. A second run over the same files adds nothing.
    """
    rows = cut(read_pdfs(spark, root, extractor))
    fs, p = file_system(spark, store)
    old = spark.read.schema(rows.schema).parquet(store) if fs.exists(p) else spark.createDataFrame([], rows.schema)
    status = cut(incremental_status(old, rows, "pdf_path", "content_hash"))
    rows.join(status.filter("status = 'written'").select("pdf_path"), "pdf_path", "left_semi").write.mode("append").parquet(store)
    return spark.read.schema(rows.schema).parquet(store), status.filter("status = 'protected'").select("pdf_path")
