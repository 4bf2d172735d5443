"""Running forecast metrics and running cube sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics


def running_metrics(stream: DataFrame, group: list[str]) -> DataFrame:
    """Metrics of all rows (y, yhat) so far by group; write in complete or update mode. The state is the sums of each group."""
    sums = stream.groupBy(*group).agg(*metrics.named(metrics.error_sums()))
    return sums.select(*group, *metrics.named(metrics.finals()), F.col("n").cast("long").alias("points"))


def step_sums(stream: DataFrame, *, time_col: str = "ts", late: str = "30 minutes", step: str = "15 minutes") -> DataFrame:
    """(start, bus, event_type, total) of each step, once no event of it can arrive any more; append mode."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, step).alias("w"), "bus", "event_type").agg(F.sum("cents").alias("total")).select(F.col("w.start").alias("start"), "bus", "event_type", "total")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """Take all that is there into a table in memory, and stop; for tests and small reports."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q
