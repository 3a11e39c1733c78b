"""Streaming twins of batch aggregates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a folder of this machine only where that is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def exactly(path: str) -> str:
    """A pattern that matches this path alone: the file source takes folders or patterns."""
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, path: str, late: str) -> DataFrame:
    """Events with the start of their day, in the session's time zone, as event time."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(exactly(path))
    return rows.withColumn("day", F.to_date("ts").cast("timestamp")).withWatermark("day", late)


def run_once(rows: DataFrame, folder: str, keep) -> None:
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()


def day_bars(spark: SparkSession, path: str, late: str = "40 days") -> DataFrame:
    """d, symbol, vol, amount, high, low of an event stream, from all files now at path.

    State holds one row a day and type, until `late` after its day. Each batch writes its changed rows
    under its own number, so a batch that runs again replaces its files; the last state of each key is
    the result."""
    folder = shared_folder(spark)
    bars = event_stream(spark, path, late).groupBy("day", F.col("event_type").alias("symbol")).agg(F.count("*").alias("vol"), F.sum("value").alias("amount"), F.max("value").alias("high"), F.min("value").alias("low"))

    def keep(batch: DataFrame, n: int) -> None:
        out = batch.select(F.to_date("day").alias("d"), "symbol", "vol", "amount", "high", "low")
        out.withColumn("seq", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/bars/batch={n}")

    run_once(bars, folder, keep)
    told = spark.read.parquet(f"{folder}/bars")
    return told.groupBy("d", "symbol").agg(F.max_by(F.struct("vol", "amount", "high", "low"), "seq").alias("x")).select("d", "symbol", "x.*")


def deduped(spark: SparkSession, path: str, keys: list[str], late: str = "40 days") -> DataFrame:
    """The first event of each key, as a stream drops the others within the watermark."""
    folder = shared_folder(spark)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    rows = event_stream(spark, path, late).dropDuplicatesWithinWatermark(keys)
    rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch", "day")


def latest_states(spark: SparkSession, path: str, key: str, late: str = "40 days") -> DataFrame:
    """key, last_type, last_value, n: an upsert by key kept up by a stream; the state is a row a key."""
    folder = shared_folder(spark)
    rows = event_stream(spark, path, late).groupBy(key).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x"), F.count("*").alias("n"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.select(key, F.col("x.event_type").alias("last_type"), F.col("x.value").alias("last_value"), "n", F.lit(n).cast("long").alias("seq")).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    run_once(rows, folder, keep)
    told = spark.read.parquet(f"{folder}/rows")
    return told.groupBy(key).agg(F.max_by(F.struct("last_type", "last_value", "n"), "seq").alias("x")).select(key, "x.*")
