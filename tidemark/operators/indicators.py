"""Windowed indicators. Every value depends on the bar itself and earlier ones only.

What is a plain trailing window is a Spark window. Recurrences (EMA, Wilder's smoothing) are a blocked
scan over each series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .scan import factor, scan, smoothed

#: Bars that a direction needs at least.
LEAST_BARS = 60

EMAS = (12, 20, 26, 50)
WILDER = 14

INDICATORS = ["ema12", "ema20", "ema26", "ema50", "macd_line", "macd_signal", "macd_histogram", "rsi14", "atr14", "adx14"]


def _true_range(high: np.ndarray, low: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def _recurrences(block: dict[str, np.ndarray], first: int, before: dict[str, float], carries: list[np.ndarray]):
    """The indicators of one block as a stage of ``scan``: EMAs, gains, losses and ATR first; then the
    MACD signal and the smoothed ratios of movement to ATR; then the mean of DX.

    EMA is seeded by the mean of its first ``period`` values, Wilder's mean by that of the first 14 after
    row 0. The signal starts one bar after its ninth line value: its seed is the mean of the first nine,
    and row 34 shows the seed itself. RSI is 100 where there was no loss, a flat series included. Each
    directional ratio 100 DM / ATR is smoothed, not DM alone; once ATR is 0 a ratio is NaN for good and DX
    is 0 from there on.
    """
    h, l, c = block["high"], block["low"], block["close"]  # noqa: E741
    n = len(c)
    place = np.arange(first, first + n)
    prior = {k: np.concatenate([[before[k] if first else block[k][0]], block[k][:-1]]) for k in ("high", "low", "close")}
    move = c - prior["close"]
    tr = np.where(place == 0, 0.0, _true_range(h, l, prior["close"]))
    up, down = h - prior["high"], prior["low"] - l
    inputs = [*[(c, 0, p, "ema") for p in EMAS], *[(x, 1, WILDER, "wilder") for x in (np.maximum(move, 0.0), np.maximum(-move, 0.0), tr)]]

    def step(kind: str, period: int):
        if kind == "ema":
            k = 2.0 / (period + 1.0)
            return lambda s, v: v * k + s * (1.0 - k)
        return lambda s, v: (s * (period - 1.0) + v) / period

    keep = lambda kind, period: 1.0 - 2.0 / (period + 1.0) if kind == "ema" else (period - 1.0) / period
    stage = len(carries)
    if stage == 0:
        return {}, [(factor(n, first, b, p, keep(k, p)), float(smoothed(x, first, b, p, step(k, p), 0.0)[-1])) for x, b, p, k in inputs]
    found = [np.where(place >= b + p - 1, smoothed(x, first, b, p, step(k, p), s), np.nan) for (x, b, p, k), s in zip(inputs, carries[0].tolist(), strict=True)]
    emas, (gain, loss, atr) = dict(zip(EMAS, found, strict=False)), found[len(EMAS) :]
    line = emas[12] - emas[26]
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(np.isnan(loss), np.nan, np.where(loss > 0, 100.0 - 100.0 / (1.0 + gain / loss), 100.0))
        ratios = [np.where(place <= WILDER, m, 100.0 * m / atr) for m in (np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0))]
        at = WILDER - first  # where the ratios are seeded
        seed = lambda s, v: float(np.float64(100.0 * ((s + v) / WILDER)) / atr[at])
        signal_step, signal_seed = lambda s, v: v * 0.2 + s * 0.8, lambda s, v: s / 9.0

        def second(signal: float, plus: float, minus: float) -> list[np.ndarray]:
            return [smoothed(np.nan_to_num(line), first, 25, 10, signal_step, signal, signal_seed), *[smoothed(x, first, 1, WILDER, step("wilder", WILDER), s, seed) for x, s in zip(ratios, (plus, minus), strict=True)]]

        if stage == 1:
            seeded = 100.0 / WILDER / atr[at] if 0 <= at < n and atr[at] else 1.0
            return {}, [(factor(n, first, 25, 10, 0.8, 1 / 9), float(second(0.0, 0.0, 0.0)[0][-1])), *[(factor(n, first, 1, WILDER, keep("wilder", WILDER), seeded), float(x[-1])) for x in second(0.0, 0.0, 0.0)[1:]]]
        signal, plus, minus = second(*carries[1].tolist())
        dx = np.where((place >= WILDER) & (plus + minus > 0), 100.0 * np.abs(plus - minus) / (plus + minus), 0.0)
        dx = np.nan_to_num(dx)
    if stage == 2:
        return {}, [(factor(n, first, WILDER, WILDER, keep("wilder", WILDER)), float(smoothed(dx, first, WILDER, WILDER, step("wilder", WILDER), 0.0)[-1]))]
    adx = np.where(place >= 2 * WILDER - 1, smoothed(dx, first, WILDER, WILDER, step("wilder", WILDER), float(carries[2][0])), np.nan)
    signal = np.where(place >= 34, signal, np.nan)
    return dict(zip(INDICATORS, [emas[12], emas[20], emas[26], emas[50], line, signal, line - signal, rsi, atr, adx], strict=True)), []


def recurrences(bars: DataFrame) -> DataFrame:
    """Each bar's close with its INDICATORS, null until they are available; any length of series is spread
    over tasks (see ``scan``)."""
    return scan(bars, "close_time_ns", ["high", "low", "close"], _recurrences, 3, INDICATORS, ["close"])


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of ``period`` closes and ``width`` population deviations around it."""
    by = Window.partitionBy(*SERIES).orderBy("close_time_ns").rowsBetween(1 - period, 0)
    full = F.count("close").over(by) == period
    middle, dev = F.avg("close").over(by), F.stddev_pop("close").over(by)
    return bars.select(*SERIES, "close_time_ns", F.when(full, middle).alias("bollinger_middle"), F.when(full, middle + width * dev).alias("bollinger_upper"), F.when(full, middle - width * dev).alias("bollinger_lower"))


def indicator_table(bars: DataFrame) -> DataFrame:
    """All indicators of every bar, the slope of EMA20 too."""
    by = Window.partitionBy(*SERIES).orderBy("close_time_ns")
    return recurrences(bars).join(bollinger(bars), [*SERIES, "close_time_ns"]).withColumn("ema20_slope", F.col("ema20") - F.lag("ema20").over(by))


def _vote(c: str, up: Column) -> Column:
    return F.when(F.col(c).isNull(), "UNAVAILABLE").when(up, "UP").otherwise("DOWN")


def direction_votes(table: DataFrame) -> DataFrame:
    """Votes, range detection and direction of every row of an indicator table.

    An equal value votes down, but for RSI at 50. Range needs a weak trend (ADX under 20) and EMAs
    within half an ATR. A two-two tie goes by the slope.
    """
    both = F.when(F.col("ema20").isNotNull() & F.col("ema50").isNotNull(), F.col("ema20") - F.col("ema50"))
    votes = table.withColumn("spread", both).withColumns({
        "vote_trend": _vote("spread", F.col("spread") > 0),
        "vote_slope": _vote("ema20_slope", F.col("ema20_slope") > 0),
        "vote_macd": _vote("macd_histogram", F.col("macd_histogram") > 0),
        "vote_rsi": _vote("rsi14", F.col("rsi14") >= 50),
        "ema_separation_atr": F.when(F.col("atr14") > 0, F.try_divide(F.abs("spread"), F.col("atr14"))),
    })
    names = ("vote_trend", "vote_slope", "vote_macd", "vote_rsi")
    count = lambda d: sum((F.when(F.col(n) == d, 1).otherwise(0) for n in names), F.lit(0))
    is_range = F.coalesce((F.col("adx14") < 20) & (F.col("ema_separation_atr") < 0.5), F.lit(False))
    counted = votes.withColumns({"up_votes": count("UP"), "down_votes": count("DOWN"), "is_range": is_range})
    direction = F.when(F.col("is_range"), "RANGE").when(F.col("up_votes") > F.col("down_votes"), "UP").when(F.col("down_votes") > F.col("up_votes"), "DOWN").when(F.col("vote_slope") == "UP", "UP").otherwise("DOWN")
    return counted.withColumn("direction", direction).drop("spread")


def counter_reading(table: DataFrame) -> DataFrame:
    """Exhaustion: RSI extremes first, then a close beyond a band, then an extension over 2 ATR."""
    rsi_extreme = F.when(F.col("rsi14") >= 70, "DOWN").when(F.col("rsi14") <= 30, "UP")
    band = F.when(F.col("close") > F.col("bollinger_upper"), "DOWN").when(F.col("close") < F.col("bollinger_lower"), "UP")
    extension = F.when((F.col("atr14") > 0) & F.col("ema20").isNotNull(), F.try_divide(F.col("close") - F.col("ema20"), F.col("atr14")))
    far = F.when(F.col("ema_extension") > 2, "DOWN").when(F.col("ema_extension") < -2, "UP")
    return table.withColumns({"rsi_extreme": rsi_extreme, "bollinger_position": band, "ema_extension": extension}).withColumn("counter_reading", F.coalesce("rsi_extreme", "bollinger_position", far, F.lit("NONE")))


def technical_direction(bars: DataFrame, least_bars: int = LEAST_BARS) -> DataFrame:
    """The last bar of each series with indicators, votes, direction and counter-reading.

    Series with fewer bars than ``least_bars`` give no row; ``series_status`` says why.
    """
    by = Window.partitionBy(*SERIES)
    judged = counter_reading(direction_votes(indicator_table(bars)))
    numbered = judged.withColumns({"bars_used": F.count("*").over(by), "latest": F.max("close_time_ns").over(by)})
    return numbered.where((F.col("close_time_ns") == F.col("latest")) & (F.col("bars_used") >= least_bars)).drop("latest")


def contrast(technical: DataFrame, structural: DataFrame) -> DataFrame:
    """Structural readings set beside the technical direction of each series. They describe, they do
    not decide: NEUTRAL where there is a reading and a direction, UNAVAILABLE elsewhere.

    ``structural``: instrument_id, timeframe, coherence, recurrence, prior_memory (any may be null).
    """
    both = technical.select(*SERIES, "direction").join(structural.select(*SERIES, "coherence", "recurrence", "prior_memory"), SERIES, "left")

    def item(name: str, quality: Column) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("reading"), F.col(name).alias("value"), quality.alias("quality")))

    coherent = F.when(F.col("coherence") >= 0.5, "coherent").otherwise("incoherent")
    recurrent = F.when(F.col("recurrence") >= 0.3, "recurrent").otherwise("non_recurrent")
    evidence = F.filter(F.array(item("coherence", coherent), item("recurrence", recurrent), item("prior_memory", F.lit("strictly prior"))), lambda x: x.isNotNull())
    judged = both.select(*SERIES, "direction", evidence.alias("evidence"))
    there = (F.size("evidence") > 0) & F.col("direction").isNotNull() & (F.col("direction") != "UNAVAILABLE")
    return judged.withColumn("state", F.when(there, "NEUTRAL").otherwise("UNAVAILABLE"))
