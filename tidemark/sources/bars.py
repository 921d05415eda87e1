"""Bars from tables of ticks.

A bar row: instrument_id, timeframe, open_time_ns, close_time_ns, open, high, low, close, is_closed,
source, volume, quote_volume, trade_count. Times are nanoseconds since 1970 UTC in a long, as Spark's
timestamps stop at microseconds. A value that is not available is null; it is never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000
#: Nominal seconds of each timeframe.
SECONDS = {"M1": 60, "M5": 300, "H1": 3_600, "H4": 14_400, "D1": 86_400, "W1": 604_800}

SERIES = ["instrument_id", "timeframe"]


def period(timeframe: str) -> int:
    """Seconds of a timeframe whose bars start at multiples of it since 1970: all but weeks."""
    if timeframe == "W1":
        raise ValueError("weekly bars are made from daily ones")
    return SECONDS[timeframe]


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp; no session time zone enters."""
    return F.unix_date(F.to_date(F.col(ts))).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def bars_from_ticks(ticks: DataFrame, instrument: str, ts: str, price: Column, order: Column, timeframe: str, source: str, quantity: Column | None = None) -> DataFrame:
    """One bar for each instrument and period with a tick; ``order`` tells first from last.

    Only a partial aggregation is shuffled: a row for each instrument and period of each task. Weeks don't
    start at multiples of the epoch; ``resample.weekly`` makes them.
    """
    step = period(timeframe)
    rows = ticks.select(F.col(instrument).cast("string").alias("instrument_id"), (F.floor(epoch_seconds(ts) / step) * step * NS).alias("open_time_ns"), price.cast("double").alias("price"), order.alias("tick"), (quantity if quantity is not None else F.lit(None)).cast("double").alias("quantity")).where("price IS NOT NULL AND open_time_ns IS NOT NULL")
    made = rows.groupBy("instrument_id", "open_time_ns").agg(F.min_by("price", "tick").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tick").alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trade_count"))
    return made.select("instrument_id", F.lit(timeframe).alias("timeframe"), "open_time_ns", (F.col("open_time_ns") + step * NS).alias("close_time_ns"), "open", "high", "low", "close", F.lit(True).alias("is_closed"), F.lit(source).alias("source"), "volume", F.lit(None).cast("double").alias("quote_volume"), "trade_count")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str, timeframe: str = "D1") -> DataFrame:
    return bars_from_ticks(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", F.col("o_totalprice"), F.col("o_orderkey"), timeframe, "orders")


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "H1") -> DataFrame:
    return bars_from_ticks(read(spark, sf_dir, "events"), "event_type", "ts", F.col("value"), F.col("event_id"), timeframe, "events", F.lit(1.0))


def lineitem_bars(spark: SparkSession, sf_dir: str, timeframe: str = "D1") -> DataFrame:
    """Price per unit by brand. (order, line) repeats, so further columns break ties."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    ticks = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").join(parts, "l_partkey")
    return bars_from_ticks(ticks, "p_brand", "l_shipdate", F.try_divide("l_extendedprice", "l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), timeframe, "lineitem", F.col("l_quantity"))
