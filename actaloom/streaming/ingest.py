"""Structured Streaming: idempotent ingest and windowed counts (an extension; the batch operators define the semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaloom.operators.merge import incremental_status
from actaloom.session import cut, file_system


def ingest_batch(batch: DataFrame, path: str, key: str, digest: str) -> DataFrame:
    """Writes the batch's new keys to the store at path; returns the status of every key of the batch.

    Keys whose content differs from the stored one are reported as protected and not written.
    Repeated keys of a batch count once. A repeated batch writes nothing.
    """
    spark = batch.sparkSession
    rows = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
    fs, store = file_system(spark, path)
    stored = spark.read.schema(rows.schema).parquet(path) if fs.exists(store) else spark.createDataFrame([], rows.schema)
    status = cut(incremental_status(stored, rows, key, digest).filter(F.col("status") != "absent"))
    rows.join(status.filter(F.col("status") == "written").select(key), key, "left_semi").write.mode("append").parquet(path)
    return status


def ingest_stream(stream: DataFrame, path: str, key: str, digest: str, checkpoint: str):  # noqa: ANN201
    """A query that runs ingest_batch on every micro-batch until the input is used up."""
    return stream.writeStream.foreachBatch(lambda df, _: ingest_batch(df, path, key, digest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, value, n) with rows later than the watermark left out."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", window), value).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), value, "n")


def run_windowed(spark: SparkSession, path: str, schema: object, ts: str, value: str, out: str, checkpoint: str) -> DataFrame:
    """windowed_counts over the parquet files of a folder, as a stream that ends with its input; returns what was appended."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = windowed_counts(stream, ts, value).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
