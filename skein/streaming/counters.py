"""Live counters of a stream: metrics that Spark observes batch by batch, gathered into a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: The name under which a stream's counters are observed.
OBSERVED = "counters"


def counted(stream: DataFrame, **counters: Column) -> DataFrame:
    """The stream as it is, with the number of rows and of those that each condition holds for observed on the way."""
    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(name) for name, c in counters.items()))


class Counters(StreamingQueryListener):
    """``batches()``: ``query, batch, counter, n``, with rows dropped as too late under ``late``; register with ``spark.streams.addListener``."""

    SCHEMA = "query string, batch long, counter string, n long"

    def __init__(self) -> None:
        self.lock, self.rows = threading.Lock(), []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        found = {k: int(v) for k, v in (p.observedMetrics[OBSERVED].asDict() if OBSERVED in p.observedMetrics else {}).items()}
        if p.stateOperators:
            found["late"] = sum(int(o.numRowsDroppedByWatermark) for o in p.stateOperators)
        with self.lock:
            self.rows += [(p.name or str(p.id), p.batchId, k, v) for k, v in found.items()]

    def batches(self, spark: SparkSession) -> DataFrame:
        """One row per batch and counter so far: as many as the query had batches, not rows."""
        with self.lock:
            return spark.createDataFrame(list(self.rows), self.SCHEMA)

    def totals(self, spark: SparkSession) -> DataFrame:
        """``query, counter, n`` over all batches."""
        return self.batches(spark).groupBy("query", "counter").agg(F.sum("n").alias("n"))
