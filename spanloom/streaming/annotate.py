"""Row-local operators over a stream of texts, and keyed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def annotate_stream(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and append its rows as Parquet. A batch that is run again after a
    failure overwrites its own folder, so that its rows count once."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a key in tumbling windows; rows later than the watermark are dropped, as in any bounded state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
