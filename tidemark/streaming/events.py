"""Structured Streaming over event files: windows with late data, first row per key, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import scratch


def open_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of one table, a folder or a single file, with their present schema."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return spark.readStream.schema(schema).parquet(path)


def open_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def daily_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events by day and type; rows later than ``late`` behind the latest are dropped once their window is closed, and with them its state, in append and update mode."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    counted = at.withWatermark("at", late).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "event_type", "n")


def first_per_key(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key that arrives.

    With ``late``, keys are forgotten so long after their time (column ts); without it the state
    holds every key, as replays may come at any time."""
    if late is None:
        return events.dropDuplicates(keys)
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.dropDuplicatesWithinWatermark(keys).drop("at")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, events) of runs of events whose neighbours are within ``gap``."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def drain(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is, then stop, and give its result.

    ``append``: rows as they are final. ``update``: groups by ``keys`` as they change, so that
    the watermark may drop closed ones from the state; the last form of each counts.
    ``complete``: all groups anew with each batch, of which the last counts. Everything is
    written to the shared folder."""
    spark = stream.sparkSession
    folder = f"{scratch(spark)}-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/out")
    elif mode == "update":
        query = writer.foreachBatch(lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part-{number}")).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest)).select(*stream.columns)
