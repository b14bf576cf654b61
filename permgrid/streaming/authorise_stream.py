"""Decide access requests as they arrive.

Structured Streaming over event files; each micro-batch is decided with the batch job
(``effective_permission``) against grants and memberships read fresh for that batch, so grant
edits act from the next batch on.  A request that is delivered again within ``delay`` is decided
once; the ids of that time are all the state there is.  Events behind the watermark are late:
they are not decided, and :func:`undecided` lists them.

The sink writes each batch to its own ``batch_id=<n>`` folder with overwrite, so a
batch replayed after a failure replaces its own output (exactly-once with the
checkpoint).  ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permgrid.operators.authorise import action_allowed, effective_permission
from permgrid.sources import fixtures as fx


DECISIONS = "request_id long, action string, effective string, allowed boolean"


def start_authorise_stream(spark: SparkSession, source_dir: str, glob: str, schema,
                           to_requests: Callable[[DataFrame], DataFrame],
                           snapshot: Callable[[], tuple[DataFrame, DataFrame]],
                           out_dir: str, available_now: bool = True, max_files: int = 1000,
                           id_col: str = "event_id", time_col: str = "ts", delay: str = "1 day"):
    path = os.path.join(out_dir, "decisions")

    def decide(batch: DataFrame, batch_id: int) -> None:
        memberships, grants = snapshot()
        d = effective_permission(to_requests(batch.withColumn(time_col, F.col(time_col).cast(schema[time_col].dataType))), memberships, grants)
        (d.select("request_id", "action", "effective", action_allowed().alias("allowed"))
          .write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}")))

    # the folder is there even when no batch comes
    spark.createDataFrame([], DECISIONS).write.mode("overwrite").parquet(os.path.join(path, "batch_id=-1"))
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", max_files).parquet(source_dir)
              .withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col]))
    w = stream.writeStream.foreachBatch(decide).option("checkpointLocation", os.path.join(out_dir, "_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_decisions(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(DECISIONS + ", batch_id int").parquet(os.path.join(out_dir, "decisions")).drop("batch_id")


def undecided(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests that the stream has not decided: not seen yet, or late."""
    return requests.join(decisions.select("request_id"), "request_id", "left_anti")


def stream_authorise(spark: SparkSession, sf_dir: str, out_dir: str) -> DataFrame:
    """Run T1 over the events of ``sf_dir``, every tenth of them delivered twice, until caught up."""
    events = fx.table(spark, sf_dir, "events")
    landing = os.path.join(out_dir, "landing")
    events.unionByName(events.where(F.col("event_id") % 10 == 0)).write.parquet(landing)
    q = start_authorise_stream(
        spark, landing, "*.parquet", events.schema, fx.requests_from_events,
        lambda: (fx.memberships(spark, sf_dir), fx.grants(spark, sf_dir)), out_dir)
    q.awaitTermination()
    return read_decisions(spark, out_dir)
