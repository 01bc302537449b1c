"""Cells kept up by a stream of canonical events (an extension: the archive itself is a batch).

Folding is associative, so each micro-batch is folded by itself and written as an increment; a
reader merges increments by regrouping. A batch that is replayed overwrites its own increment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..plans.layout import View


def keep_cells(events: DataFrame, width: int, view: View, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts writing increments of ``view`` from a stream of events."""

    def increment(batch: DataFrame, number: int) -> None:
        state.cells(batch, width, view.dimensions, view.measures).write.mode("overwrite").parquet(f"{path}/increment={number}")

    writer = events.writeStream.foreachBatch(increment).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_cells(spark: SparkSession, path: str, view: View) -> DataFrame:
    """All increments merged."""
    return state.regroup(spark.read.parquet(path), view.dimensions, view.measures)
