"""Closed bars from a stream of ticks.

A bar is sent on once, when the watermark has passed its end: event time windows, append mode. What
comes later than ``late`` behind the newest tick is dropped, as Structured Streaming does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.bars import NS, period


def closed_bars(ticks: DataFrame, instrument: str, ts: str, price: Column, order: Column, timeframe: str, source: str, quantity: Column | None = None, late: str = "1 hour") -> DataFrame:
    """Bars of a streaming (or static) table of ticks, with the columns of ``sources.bars``.

    Ticks without a price or a time take no part. State is one row for each instrument and open window.
    """
    step = period(timeframe)
    rows = ticks.select(F.col(instrument).cast("string").alias("instrument_id"), F.col(ts).cast("timestamp").alias("at"), price.cast("double").alias("price"), order.alias("tick"), (quantity if quantity is not None else F.lit(None)).cast("double").alias("quantity")).where("price IS NOT NULL AND at IS NOT NULL")
    grouped = rows.withWatermark("at", late).groupBy("instrument_id", F.window("at", f"{step} seconds"))
    made = grouped.agg(F.min_by("price", "tick").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tick").alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trade_count"))
    opened = (F.unix_seconds("window.start") * NS).alias("open_time_ns")
    return made.select("instrument_id", F.lit(timeframe).alias("timeframe"), opened, (F.unix_seconds("window.start") * NS + step * NS).alias("close_time_ns"), "open", "high", "low", "close", F.lit(True).alias("is_closed"), F.lit(source).alias("source"), "volume", F.lit(None).cast("double").alias("quote_volume"), "trade_count")


def until_now(spark: SparkSession, bars: DataFrame, name: str) -> DataFrame:
    """Run a streaming table of bars over all that has come so far, and read what it has written.

    Sink and checkpoint lie in the shared folder, so a restarted query goes on where it was.
    """
    path = shared_path(spark, name)
    query = bars.writeStream.format("parquet").outputMode("append").option("path", f"{path}/bars").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{path}/bars")
