"""Row and series checks. Problems are columns or rows, never silent drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import NS, SERIES

DAY_NS = 86_400 * NS


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def bar_violation() -> Column:
    """The first rule that a bar breaks, or null: identity, times, finite prices, their order."""
    finite = _finite("open") & _finite("high") & _finite("low") & _finite("close")
    shape = (F.col("low") <= F.col("high")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    negative = (F.coalesce("volume", F.lit(0.0)) < 0) | (F.coalesce("quote_volume", F.lit(0.0)) < 0) | (F.coalesce("trade_count", F.lit(0)) < 0)
    return (
        F.when((F.trim(F.coalesce("instrument_id", F.lit(""))) == "") | (F.trim(F.coalesce("source", F.lit(""))) == ""), "MISSING_IDENTITY")
        .when(F.col("close_time_ns") <= F.col("open_time_ns"), "INVALID_TIME")
        .when(~finite, "NON_FINITE")
        .when(~shape, "MALFORMED_OHLC")
        .when(negative, "NEGATIVE_VOLUME")
    )


def cadence_anomalies(bars: DataFrame, least_days: int = 1, most_days: int = 1) -> DataFrame:
    """Neighbouring bars whose opens are not between the two numbers of days apart."""
    by = Window.partitionBy(*SERIES).orderBy("open_time_ns")
    gap = F.col("open_time_ns") - F.col("previous_open_ns")
    return bars.select(*SERIES, "open_time_ns", F.lag("open_time_ns").over(by).alias("previous_open_ns")).withColumn("gap_ns", gap).where((F.col("gap_ns") < least_days * DAY_NS) | (F.col("gap_ns") > most_days * DAY_NS))


def series_status(bars: DataFrame, least_bars: int = 60) -> DataFrame:
    """One row for each series: bars, and the first check that fails, or OK.

    A failing series is a row with a reason, so one bad series does not stop the others.
    """
    by = Window.partitionBy(*SERIES).orderBy("close_time_ns")
    rows = bars.select(*SERIES, "is_closed", "close_time_ns", "open", "high", "low", "close", (F.lead("close_time_ns").over(by) == F.col("close_time_ns")).alias("repeats"))
    positive = _finite("open") & _finite("high") & _finite("low") & _finite("close") & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    found = rows.groupBy(*SERIES).agg(F.count("*").alias("bars"), F.bool_and("is_closed").alias("closed"), F.bool_or(F.coalesce("repeats", F.lit(False))).alias("repeated"), F.bool_and(positive).alias("sound"))
    status = F.when(~F.col("closed"), "OPEN_BAR").when(F.col("repeated"), "NOT_INCREASING").when(~F.col("sound"), "INVALID_PRICE").when(F.col("bars") < least_bars, "INSUFFICIENT_BARS").otherwise("OK")
    return found.select(*SERIES, "bars", status.alias("status"))


def observations(bars: DataFrame) -> DataFrame:
    """omega: a bar's range over the previous close; expected: the previous omega (NaN for the first).

    One row less than bars in each series.
    """
    by = Window.partitionBy(*SERIES).orderBy("close_time_ns")
    omega = (F.col("high") - F.col("low")) / F.col("previous")
    rows = bars.select(*SERIES, "close_time_ns", "high", "low", F.lag("close").over(by).alias("previous")).where("previous IS NOT NULL").select(*SERIES, F.col("close_time_ns").alias("timestamp_ns"), omega.alias("omega"))
    again = Window.partitionBy(*SERIES).orderBy("timestamp_ns")
    return rows.withColumn("expected", F.coalesce(F.lag("omega").over(again), F.lit(float("nan"))))


def admitted_timeframes(requested: Column, supported: Column) -> Column:
    """Requested timeframes that are supported, in the order asked for; none asked: all supported."""
    return F.when(F.size(requested) == 0, supported).otherwise(F.filter(requested, lambda x: F.array_contains(supported, x)))


def request_problems(timeframes: Column, overrides: Column, mode: Column, supported: tuple[str, ...] = ("D1", "W1")) -> Column:
    """Why each of a table of requests is refused: duplicate timeframes, unsupported ones, overrides and previews,
    in this order; null where it is served."""
    frames = F.coalesce(timeframes, F.array().cast("array<string>"))
    known = F.array(*map(F.lit, supported))
    return F.when(F.size(F.array_distinct(frames)) != F.size(frames), "DUPLICATE_TIMEFRAME").when(F.exists(frames, lambda f: ~F.array_contains(known, f)), "UNSUPPORTED_TIMEFRAME").when(F.size(overrides) > 0, "OVERRIDES_NOT_ALLOWED").when(mode == "LIVE_PREVIEW", "PREVIEW_NOT_ALLOWED")


def readiness(profiles: DataFrame, corpus: DataFrame) -> DataFrame:
    """For each profile (instrument_id, timeframe, loaded, valid) whether it can be served, and why not.

    ``corpus``: instrument_id and status of each audited file; a rejected or missing file is not served.
    """
    both = profiles.join(corpus.select("instrument_id", F.col("status").alias("corpus_status")), "instrument_id", "left")
    why = F.when(~F.coalesce("loaded", F.lit(False)), "PROFILE_MISSING").when(~F.coalesce("valid", F.lit(False)), "PROFILE_INVALID").when(F.col("corpus_status").isNull(), "CORPUS_MISSING").when(F.col("corpus_status") == "REJECTED", "CORPUS_REJECTED").otherwise("READY")
    return both.select("instrument_id", "timeframe", why.alias("readiness"))
