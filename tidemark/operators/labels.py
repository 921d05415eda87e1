"""First-passage labels: which of two volatility-scaled barriers a bar's future meets first.

Only the label looks forward, and never past ``horizon`` bars; volatility looks back only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .selection import quantiles

def by():
    """Each series in order."""
    return Window.partitionBy(*SERIES).orderBy("close_time_ns")


#: What keeps the edges of a frame of a series' own size between two rows.
EDGE = 2.0**-20


def _own(call: str, size: str, ahead: bool) -> Column:
    """``call`` over the next ``size`` rows, or the last ones with this one. ``size`` is a column, below 2^20 and
    equal in all rows of a series: rows are placed at their number divided by it, so that every frame is 1 wide."""
    frame = f"{EDGE}D FOLLOWING AND {1 + EDGE}D FOLLOWING" if ahead else f"{1 - EDGE}D PRECEDING AND CURRENT ROW"
    return F.expr(f"{call} OVER (PARTITION BY {', '.join(SERIES)} ORDER BY row_in_series / {size} RANGE BETWEEN {frame})")


def with_volatility(bars: DataFrame, lookback: int | str) -> DataFrame:
    """Median of the positive finite ranges over the previous close of the last ``lookback`` bars (a number, or
    a column that is equal in all bars of a series).

    The first bar of a series has none. A frame of ``lookback`` rows is all that is held.
    """
    previous = F.lag("close").over(by())
    ratio = F.try_divide(F.col("high") - F.col("low"), previous)
    sound = F.when((ratio > 0) & ~F.isnan(ratio) & (ratio != float("inf")), ratio)
    middle = _own("percentile(range_ratio, 0.5D)", lookback, False) if isinstance(lookback, str) else F.percentile("range_ratio", F.lit(0.5)).over(by().rowsBetween(1 - lookback, 0))
    return bars.withColumn("range_ratio", sound).withColumn("row_in_series", F.row_number().over(by())).withColumn("volatility", F.when(F.col("row_in_series") > 1, middle)).drop("range_ratio")


def symmetric_barrier(bars: DataFrame, lookback: int | str, horizon: int | str, train_bars: int | None = None, train: Column | None = None) -> DataFrame:
    """One row for each series: the median excursion, up or down, in units of volatility.

    Paths are clipped at the end of the first ``train_bars`` bars, or of those where ``train`` holds (all, if
    None), so late bars use shorter ones.
    """
    rows = with_volatility(bars, lookback)
    if train_bars is not None:
        rows = rows.where(F.col("row_in_series") <= train_bars)
    if train is not None:
        rows = rows.where(train)
    top, bottom = (_own("max(high)", horizon, True), _own("min(low)", horizon, True)) if isinstance(horizon, str) else (F.max("high").over(by().rowsBetween(1, horizon)), F.min("low").over(by().rowsBetween(1, horizon)))
    paths = rows.select(*SERIES, "row_in_series", "close", "volatility", top.alias("top"), bottom.alias("bottom")).where("row_in_series > 1 AND volatility IS NOT NULL AND top IS NOT NULL")
    up = F.greatest(F.try_divide(F.col("top"), F.col("close")) - 1, F.lit(0.0)) / F.col("volatility")
    down = F.greatest(1 - F.try_divide(F.col("bottom"), F.col("close")), F.lit(0.0)) / F.col("volatility")
    pooled = paths.select(*SERIES, F.explode(F.array(up, down)).alias("excursion"))
    return quantiles(pooled, SERIES, "excursion", {"barrier": 0.5}).withColumnRenamed("n", "excursions").where("barrier > 0")


def first_passage(bars: DataFrame, lookback: int | str, horizon: int | str, upper: float | Column, lower: float | Column) -> DataFrame:
    """Each bar with volatility, its label and the bars until it is met.

    Both barriers in one bar, or none within the horizon: RANGE. A future that ends before the
    horizon without a hit is CENSORED and has no label. The origin is the bar's own close; the first
    bar that counts is the next one.
    """
    rows = with_volatility(bars, lookback)  # all bars are a future, those without a volatility too
    future = _own("collect_list(struct(high, low))", horizon, True) if isinstance(horizon, str) else F.collect_list(F.struct("high", "low")).over(by().rowsBetween(1, horizon))
    most = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    lift = lambda m: m if isinstance(m, Column) else F.lit(m)
    held = rows.withColumn("future", future).where((F.size("future") > 0) & F.col("volatility").isNotNull()).withColumns({"upper": F.col("close") * (1 + F.col("volatility") * lift(upper)), "lower": F.col("close") * (1 - F.col("volatility") * lift(lower))})
    hits = F.transform("future", lambda b: (b["high"] >= F.col("upper")) | (b["low"] <= F.col("lower")))
    at = F.array_position(hits, True).cast("int")
    bar = F.element_at("future", F.col("at"))
    met = F.when((bar["high"] >= F.col("upper")) & (bar["low"] > F.col("lower")), "UP").when((bar["high"] < F.col("upper")) & (bar["low"] <= F.col("lower")), "DOWN").otherwise("RANGE")
    full = F.size("future") >= most
    return held.withColumn("at", at).select(*SERIES, "close_time_ns", "close", "volatility", F.when(F.col("at") > 0, met).when(full, "RANGE").otherwise("CENSORED").alias("direction"), F.when(F.col("at") > 0, F.col("at")).when(full, most).alias("first_passage_bars"), F.size("future").alias("observed_bars"))
