"""Materialized views kept up by Structured Streaming: each micro-batch of source rows goes through the view into the target.

As with insert triggers, a batch sees its own rows only, so aggregates are partial rows that the target's
engine merges at reading. A batch is applied under a token from its number: repeated after a failure, it is applied once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.replay import Target, ViewFn, short_hash


def maintain(source: DataFrame, view: ViewFn, target: Target, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; ``once`` takes what is there and ends."""

    def apply(batch: DataFrame, number: int) -> None:
        target.apply(short_hash(name, str(number)), view(batch))

    writer = source.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(source: DataFrame, time: str, width: str, lateness: str, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Event-time windows with a watermark; times without zone are taken as UTC, since watermarks need a zone."""
    stream = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    out = stream.groupBy(F.window(time, width).alias("_w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("_w.start").alias("start"), *keys, *aggregates)
