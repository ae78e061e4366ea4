"""Incremental runs over new panel files.

The operators are batch operators (the studied workload has no streams, windows over event
time or late data).  This adapter only lets a job run over panel files as they land, using
Structured Streaming's file source with ``availableNow`` and ``foreachBatch``; progress is kept
in the streaming checkpoint, so a restarted run resumes where it stopped.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.io import PANEL_SCHEMA_WITH_FLAG


def run_on_new_files(spark: SparkSession, source_dir: str, handle: Callable[[DataFrame, int], None],
                     checkpoint: str, fmt: str = "parquet", schema=PANEL_SCHEMA_WITH_FLAG):
    """Call ``handle(batch_df, batch_id)`` for every group of new files, then stop."""
    stream = spark.readStream.schema(schema).format(fmt).option("header", True).load(source_dir)
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
