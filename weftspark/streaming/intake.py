"""Structured Streaming intake: windowed counts and content that is processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.plans.tables import new_path


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now into a written table of the shared folder, with a checkpoint; read it back."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet folder, or of one file by way of its folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def windowed_counts(stream: DataFrame, at: str, by: str, size: str, late: str) -> DataFrame:
    """Counts by tumbling window, written once the watermark has passed the window's end."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def once(stream: DataFrame, content: str) -> DataFrame:
    """Rows whose content hash was not seen before, in this run or an earlier one with the same checkpoint."""
    return stream.withColumn("content_hash", F.sha2(content, 256)).dropDuplicates(["content_hash"])


def with_dead_letters(stream: DataFrame, fine: str, name: str) -> DataFrame:
    """Both tables of a run, with ``state``: rows for which ``fine`` holds as 'done', all others (an unknown result too) as 'failed'.

    Each micro-batch is written once under its number, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")

    def take(batch: DataFrame, number: int) -> None:
        done = F.coalesce(F.expr(fine), F.lit(False))
        batch.withColumn("state", F.when(done, "done").otherwise("failed")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", out).parquet(out).drop("batch")
