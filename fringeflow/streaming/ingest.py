"""Layers that arrive as files, appended to a store once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import append_layers


def arriving(spark: SparkSession, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, so many files at most in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def append_once(layers: DataFrame, store: str, checkpoint: str, key: str = "pair") -> StreamingQuery:
    """Append each batch's new keys to the store; a batch that is run again after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        append_layers(batch.sparkSession, batch, store, key)

    return layers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, time: str, keys: list[str], value: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and count per window and key; rows later than the watermark are left out by the engine."""
    w = F.window(time, window)
    out = events.withWatermark(time, late).groupBy(w, *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "mean", "n")
