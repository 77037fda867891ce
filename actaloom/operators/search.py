"""Ranked full-text search over a stored inverted index of words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actaloom.session import file_system, run_dir

K1, B = 1.2, 0.75
#: Folders that the postings are spread over by their word; a query reads those of its words only.
BUCKETS = 16
WORD = re.compile(r"[^\W_]+")


def words(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf)."""
    rows = df.filter(F.col(text).isNotNull()).select(key, F.explode(words(F.col(text))).alias("word"))
    return rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))


def query_words(query: str) -> list[str]:
    return sorted(set(WORD.findall(query.lower())))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """postings: (key, word, tf, len, bucket); docs and mean: number and mean length of the texts."""

    postings: DataFrame
    key: str
    docs: int
    mean: float


def build_index(df: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the index of df to path, in one pass: a posting for each row and word, sorted by word in each folder.

    Each text also has a posting of no word, by which the texts and their lengths are counted.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, tf, size = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = WORD.findall(t.lower())
                count = Counter(w)
                at += [i] * (len(count) + 1)
                found += [None, *count]
                tf += [0, *count.values()]
                size += [len(w)] * (len(count) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(tf, pa.int64()), pa.array(size, pa.int32())], names=[key, "word", "tf", "len"])

    rows = df.filter(F.col(text).isNotNull()).select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, word string, tf bigint, len int")
    placed = rows.withColumn("bucket", bucket(F.col("word"))).repartition(F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("bucket", "word")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    texts = stored_postings(df.sparkSession, path, key, kind).filter(F.col("word").isNull() & (F.col("bucket") == bucket(F.lit(None).cast("string"))))
    texts.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def stored_postings(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    return spark.read.schema(f"`{key}` {kind}, word string, tf bigint, len int, bucket int").parquet(f"{path}/postings")


def indexed(df: DataFrame, key: str, text: str) -> Index:
    """The index of a table of files, built once in an application for the state that the files are in."""
    spark = df.sparkSession
    state = []
    for f in sorted(df.inputFiles()):
        fs, p = file_system(spark, f)
        s = fs.getFileStatus(p)
        state.append((f, s.getLen(), s.getModificationTime()))
    path = f"{run_dir(spark)}/index-{hashlib.sha256(repr((state, key, text)).encode()).hexdigest()[:24]}"
    fs, done = file_system(spark, f"{path}/totals/_SUCCESS")
    if not state or not fs.exists(done):
        build_index(df, key, text, path)
    return read_index(spark, path, key, df.schema[key].dataType.simpleString())


def read_index(spark: SparkSession, path: str, key: str, kind: str) -> Index:
    """The index at path; kind: type of the key."""
    total = spark.read.parquet(f"{path}/totals").first()
    return Index(stored_postings(spark, path, key, kind), key, total["docs"], total["mean"] or 0.0)


def bm25(index: Index, query: str) -> DataFrame:
    """(key, score) of all rows that hold every word of the query; score rounded to six places.

    Reads the postings of the query's words alone. An empty query matches nothing.
    """
    asked, spark = query_words(query), index.postings.sparkSession
    hits = index.postings.filter(F.col("word").isin(asked))
    places = sorted({r["b"] for r in spark.createDataFrame([(w,) for w in asked], "w string").select(bucket(F.col("w")).alias("b")).collect()})
    hits = hits.filter(F.col("bucket").isin(places))  # folders left out before any file is read
    held = {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a word of the query
    if not asked or len(held) < len(asked):
        return index.postings.limit(0).select(index.key, F.lit(0.0).alias("score"))
    idf = F.create_map(*(F.lit(x) for w in asked for x in (w, float(held[w]))))[F.col("word")]
    part = F.log(1 + (F.lit(float(index.docs)) - idf + 0.5) / (idf + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(index.mean)))
    scored = hits.select(index.key, part.alias("part")).groupBy(index.key).agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("n"))
    return scored.filter(F.col("n") == len(asked)).select(index.key, F.round("score", 6).alias("score"))


def top_hits(scored: DataFrame, key: str, k: int = 100) -> DataFrame:
    """The k best rows with the number of all matches; ties go to the lesser key."""
    total = scored.agg(F.count(F.lit(1)).alias("matches"))
    return scored.orderBy(F.desc("score"), key).limit(k).crossJoin(F.broadcast(total))  # one row
