"""Streams of records and events: month counts, deduplication, sessions.

Each function turns a streaming frame into a streaming frame; :func:`run` drains
what is there now into a table of the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def events(spark: SparkSession, sf_dir: str, per_trigger: int | None = None) -> DataFrame:
    """The events as a stream; event time in UTC."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines of JSON as a stream of records; broken lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def period_counts(stream: DataFrame, period: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events of each type by fixed period; what is later than ``lateness`` is dropped and shows in the query's metrics."""
    counted = stream.withWatermark("ts", lateness).groupBy(F.window("ts", period).alias("w"), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_counts(stream: DataFrame, period: str = "2 days", slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events of each type by periods that overlap: an extra, not a behaviour that was rebuilt."""
    counted = stream.withWatermark("ts", lateness).groupBy(F.window("ts", period, slide).alias("w"), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def month_counts(stream: DataFrame) -> DataFrame:
    """Calendar months have no fixed length, so they are a key, not a window."""
    return stream.groupBy(F.date_trunc("month", "ts").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = "30 days") -> DataFrame:
    """The first of each key; a key is forgotten when the watermark has passed it."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Runs of a user's events with no longer pause than ``gap``."""
    return stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drains the stream and returns what it wrote. With ``complete`` the last batch is the result."""
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{where}/out")


def late_rows(query) -> int:
    """Rows that a finished query dropped as later than its watermark allows."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def run_until(stream: DataFrame, enough, stop=lambda: False) -> DataFrame:
    """Appends batch by batch until what is written is ``enough``, a function of all written rows, or ``stop`` says so; later batches are skipped.

    A batch that has begun is written whole.
    """
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema, done = stream.schema, [False]

    def append(batch: DataFrame, number: int) -> None:
        if done[0] or stop():
            return
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")
        done[0] = enough(spark.read.schema(schema).parquet(f"{where}/out"))

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{where}/out") if done[0] else _written(spark, schema, f"{where}/out")


def _written(spark: SparkSession, schema, path: str) -> DataFrame:
    """What is there, or nothing where no batch was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if there else spark.createDataFrame([], schema)


class Breaker:
    """Skips periods after a source has refused: ``cool`` of them, then it is tried again."""

    def __init__(self, cool: int = 4):
        self.cool, self.left = cool, 0

    def open(self) -> bool:
        """Whether the period at hand is skipped; each call is one period."""
        if self.left:
            self.left -= 1
            return True
        return False

    def refused(self) -> None:
        self.left = self.cool
