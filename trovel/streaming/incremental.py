"""Incremental work on Structured Streaming: resumable steps, append once per key, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str], *, settings: str = "", files_at_once: int = 10) -> StreamingQuery:
    """Runs step over the Parquet files in source that no run has seen, and appends rows of new keys to sink.

    A batch that is tried again after a loss finds its keys in the sink and appends nothing twice. settings (a model's name,
    say) are stored beside the checkpoint by the first run; a run with others is an error, as its rows would not fit.
    """
    mark = spark.createDataFrame([(settings,)], "settings string")
    try:
        before = spark.read.json(f"{checkpoint}/settings", schema="settings string").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = None
    if before is None:
        mark.write.json(f"{checkpoint}/settings")
    elif before.settings != settings:
        raise ValueError(f"begun with settings {before.settings!r}, not {settings!r}")

    def append(batch: DataFrame, _: int) -> None:
        rows = step(batch).dropDuplicates(keys)
        try:
            rows = rows.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def tumbling(events: DataFrame, length: str, late: str, *, time: str = "ts", by: list[str] = ()) -> DataFrame:
    """Counts and sums of value by window; rows later than the watermark are dropped once their window is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, length: str, step: str, late: str, *, time: str = "ts", by: list[str] = ()) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, length, step), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str, *, time: str = "ts", by: list[str]) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def once_within(events: DataFrame, keys: list[str], late: str, *, time: str = "ts") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
