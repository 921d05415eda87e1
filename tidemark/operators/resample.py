"""Longer bars from shorter ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import NS, SERIES

DAY_NS = 86_400 * NS
WEEK_NS = 7 * DAY_NS
#: 1970-01-01 was a Thursday: Mondays are 4 days after a multiple of a week.
MONDAY_NS = 4 * DAY_NS
#: Bars close up to so much before the next Monday and still end their week.
TOLERANCE_NS = 1_000_000


def all_or_nothing(c: str):
    """A sum only if every part is available."""
    return F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)


def week_start_ns(open_time_ns: str = "open_time_ns"):
    return F.expr(f"({open_time_ns} - {MONDAY_NS}) - pmod({open_time_ns} - {MONDAY_NS}, {WEEK_NS}L) + {MONDAY_NS}")


def weekly(daily: DataFrame) -> DataFrame:
    """ISO weeks of closed D1 bars. The last week of a series comes out only if it has ended: a later
    week is there, or its last bar closes at the next Monday."""
    rows = daily.where("timeframe = 'D1' AND is_closed").withColumn("week_ns", week_start_ns())
    weeks = rows.groupBy("instrument_id", "week_ns").agg(F.min("open_time_ns").alias("open_time_ns"), F.max("close_time_ns").alias("close_time_ns"), F.min_by("open", "open_time_ns").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time_ns").alias("close"), F.min_by("source", "open_time_ns").alias("source"), all_or_nothing("volume"), F.count("*").alias("days"))
    latest = F.max("week_ns").over(Window.partitionBy("instrument_id"))
    ended = (F.col("week_ns") < F.col("latest")) | (F.col("close_time_ns") + TOLERANCE_NS >= F.col("week_ns") + WEEK_NS)
    return weeks.withColumn("latest", latest).where(ended).select("instrument_id", F.lit("W1").alias("timeframe"), "open_time_ns", "close_time_ns", "open", "high", "low", "close", F.lit(True).alias("is_closed"), "source", "volume", F.lit(None).cast("double").alias("quote_volume"), F.lit(None).cast("long").alias("trade_count"), "days")


def by_count(bars: DataFrame, size: int, timeframe: str) -> DataFrame:
    """Every ``size`` bars in a row make one; a partial tail is dropped. Gaps and clocks play no part."""
    by = Window.partitionBy("instrument_id").orderBy("open_time_ns")
    rows = bars.withColumn("bucket", F.floor((F.row_number().over(by) - 1) / size))
    made = rows.groupBy("instrument_id", "bucket").agg(F.min("open_time_ns").alias("open_time_ns"), F.max("close_time_ns").alias("close_time_ns"), F.min_by("open", "open_time_ns").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time_ns").alias("close"), F.bool_and("is_closed").alias("is_closed"), F.min_by("source", "open_time_ns").alias("source"), all_or_nothing("volume"), all_or_nothing("quote_volume"), all_or_nothing("trade_count"), F.count("*").alias("parts"))
    return made.where(F.col("parts") == size).select("instrument_id", F.lit(timeframe).alias("timeframe"), "open_time_ns", "close_time_ns", "open", "high", "low", "close", "is_closed", "source", "volume", "quote_volume", "trade_count")


#: Bars of which timeframe make one of which other, and how many.
RULES = {("M1", "M5"): 5, ("M1", "H1"): 60, ("M5", "H1"): 12, ("H1", "H4"): 4}


def resample(bars: DataFrame, from_frame: str, to_frame: str) -> DataFrame:
    if (from_frame, to_frame) == ("D1", "W1"):
        return weekly(bars)
    return by_count(bars.where(F.col("timeframe") == from_frame), RULES[from_frame, to_frame], to_frame)


def closed_weekly_once(bars: DataFrame, timeframe: str) -> DataFrame:
    """D1 becomes W1, W1 stays: applying it twice is applying it once."""
    if timeframe == "W1":
        return bars
    if timeframe == "D1":
        return weekly(bars)
    raise ValueError(f"no weekly bars from {timeframe}")


def by_clock(bars: DataFrame, timeframe: str, seconds: int) -> DataFrame:
    """Bars aligned to the clock, whatever number of shorter bars they have."""
    step = seconds * NS
    rows = bars.select("instrument_id", F.expr(f"open_time_ns - pmod(open_time_ns, {step}L)").alias("slot"), F.col("open_time_ns").alias("part_ns"), "open", "high", "low", "close")
    made = rows.groupBy("instrument_id", "slot").agg(F.min_by("open", "part_ns").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "part_ns").alias("close"), F.count("*").alias("parts"))
    return made.select("instrument_id", F.lit(timeframe).alias("timeframe"), F.col("slot").alias("open_time_ns"), (F.col("slot") + step).alias("close_time_ns"), "open", "high", "low", "close", "parts")
