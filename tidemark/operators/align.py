"""Joins along time: equal timestamps, as-of, bands, disjoint unions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .resample import WEEK_NS, week_start_ns


#: Bands of time in a block of ``greedy_band``.
BLOCK = 1024


def refuse(condition: Column, message: str | Column) -> Column:
    """A filter that lets all rows through and raises where ``condition`` holds; unlike a column, it is
    not dropped when nothing downstream reads it."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.raise_error(text).cast("boolean")).otherwise(True)


def frames_with_bars(frames: DataFrame, bars: DataFrame) -> DataFrame:
    """Each frame with the bar that closes at its timestamp; a frame without one raises.

    Bars that repeat a close time would double frames, so they raise as well.
    """
    keyed = bars.groupBy(*SERIES, F.col("close_time_ns").alias("timestamp_ns")).agg(F.count("*").alias("same"), F.min("close").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"))
    joined = frames.join(keyed, [*SERIES, "timestamp_ns"], "left")
    there = joined.where(refuse(F.col("same").isNull(), F.concat(F.lit("no bar closes at "), F.col("timestamp_ns").cast("string"))))
    return there.where(refuse(F.col("same") > 1, "two bars close at one time")).drop("same")


def prior_week(daily: DataFrame, weekly: DataFrame, value: str) -> DataFrame:
    """Each daily row with the latest weekly ``value`` of a strictly earlier ISO week.

    As-of without a range join: weeks carry the start of the next week that has a row, so the two
    sides meet in one union, and a running last() over weeks finds the row.
    """
    d = daily.select(*SERIES, "timestamp_ns", week_start_ns("timestamp_ns").alias("week_ns"))
    last = weekly.select("instrument_id", "timestamp_ns", F.col(value).alias("value"), week_start_ns("timestamp_ns").alias("week_ns")).groupBy("instrument_id", "week_ns").agg(F.max(F.struct("timestamp_ns", "value")).alias("w"))
    weeks = d.select("instrument_id", "week_ns").distinct().join(last, ["instrument_id", "week_ns"], "full")
    before = Window.partitionBy("instrument_id").orderBy("week_ns").rowsBetween(Window.unboundedPreceding, -1)
    carried = weeks.select("instrument_id", "week_ns", F.last("w", ignorenulls=True).over(before).alias("prior"))
    return d.join(carried, ["instrument_id", "week_ns"]).select(*SERIES, "timestamp_ns", F.col("prior.timestamp_ns").alias("prior_timestamp_ns"), F.col("prior.value").alias("prior_value"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, strict: bool = False, most_ns: int | None = None) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its timestamp (strictly, if asked).

    Union and one window: a single shuffle on the keys, no pairs.
    """
    a = left.select(*keys, F.col(ts), F.lit(1 if not strict else -1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(None).cast("long").alias("at"))
    b = right.select(*keys, F.col(ts), F.lit(0).alias("side"), F.col(value).alias("v"), F.col(ts).alias("at"))
    by = Window.partitionBy(*keys).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("hit", F.last(F.when(F.col("side") == 0, F.struct("at", "v")), ignorenulls=True).over(by)).where("side <> 0")
    near = F.lit(True) if most_ns is None else F.col(ts) - F.col("hit.at") <= most_ns
    return found.select(*keys, ts, F.when(near, F.col("hit.at")).alias(f"{value}_at"), F.when(near, F.col("hit.v")).alias(value))


def greedy_band(left: DataFrame, right: DataFrame, keys: list[str], most_ns: int) -> DataFrame:
    """One-to-one pairs in order: the two next rows pair if they are at most ``most_ns`` apart, else
    the earlier one is passed over. One missing row can shift all later pairs; that is the rule.

    Where two neighbouring times of both sides together are more than ``most_ns`` apart, no pair crosses, so
    the rule starts afresh: each stretch between such gaps is a task's group of its own. The gaps come from
    times by blocks of ``BLOCK`` bands, of which only the first and last row go through an ordered window.
    A stretch without a gap is one group, whatever its length. Repeated times are rows of their own; rows
    with a null time, or a null in the keys, pair with nothing.
    """
    schema = ", ".join([*(f"{k} string" for k in keys), "left_ns long", "right_ns long"])
    sides = [df.select(*[F.col(c).cast("string").alias(c) for c in keys], F.col("timestamp_ns").cast("long").alias("t"), F.lit(i).alias("side")) for i, df in enumerate((left, right))]
    rows = sides[0].unionByName(sides[1]).where(F.concat(*keys, F.col("t").cast("string")).isNotNull()).withColumn("block", F.floor(F.col("t") / F.lit(min(max(most_ns, 1) * BLOCK, 2**62))))
    # Starts of stretches inside a block, and whether its first row is one by the last row before the block.
    inside = Window.partitionBy(*keys, "block").orderBy("t", "side")
    ends = rows.groupBy(*keys, "block").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    joint = ends.select(*keys, "block", (F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("block")) <= most_ns).alias("goes_on"))
    steps = rows.withColumn("starts", F.coalesce(F.col("t") - F.lag("t").over(inside) > most_ns, F.lit(False)).cast("long")).withColumn("part", F.sum("starts").over(inside))
    # A block's last stretch and the next block's first one are the same where the blocks are joint.
    last = steps.groupBy(*keys, "block").agg(F.max("part").alias("parts")).join(joint, [*keys, "block"])
    order = Window.partitionBy(*keys).orderBy("block")
    fresh = F.when(F.coalesce(F.col("goes_on"), F.lit(False)), 0).otherwise(1)
    numbered = last.withColumn("stretch", F.sum(fresh + F.col("parts")).over(order) - F.col("parts"))
    marked = steps.join(numbered.select(*keys, "block", "stretch"), [*keys, "block"]).select(*keys, (F.col("stretch") + F.col("part")).alias("stretch"), "t", "side")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = (sorted(g.loc[g["side"] == i, "t"].tolist()) for i in (0, 1))
        i = j = 0
        pairs = []
        key = tuple(g.iloc[0][k] for k in keys)
        while i < len(x) and j < len(y):
            if abs(x[i] - y[j]) <= most_ns:
                pairs.append((*key, x[i], y[j]))
                i, j = i + 1, j + 1
            elif x[i] < y[j]:
                i += 1
            else:
                j += 1
        return pd.DataFrame(pairs, columns=[*keys, "left_ns", "right_ns"])

    return marked.groupBy(*keys, "stretch").applyInPandas(run, schema)


def exact_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal timestamps: a plain join."""
    return left.select(*keys, "timestamp_ns").join(right.select(*keys, "timestamp_ns"), [*keys, "timestamp_ns"])


def union_pool(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Union of two sample tables; a key in both (or twice) raises."""
    every = a.unionByName(b)
    n = F.count("*").over(Window.partitionBy(*key))
    return every.withColumn("n", n).where(refuse(F.col("n") > 1, "a sample comes twice")).drop("n")


def append_later(source: DataFrame, extension: DataFrame) -> DataFrame:
    """``source`` and ``extension``; an extension bar not later than all of its series' source raises."""
    last = source.groupBy(*SERIES).agg(F.max("close_time_ns").alias("source_last"))
    checked = extension.join(last, SERIES, "left").where(refuse(F.col("close_time_ns") <= F.col("source_last"), "the extension overlaps its source"))
    return source.unionByName(checked.select(source.columns))


def complete_cases(frames: DataFrame, vector: str, labelled: DataFrame, key: list[str]) -> DataFrame:
    """Frames whose vector has no null and that have a label: a semi join on the key."""
    return frames.where(F.forall(vector, lambda x: x.isNotNull())).join(labelled.select(key), key, "left_semi")


def cross_scale(scales: DataFrame) -> DataFrame:
    """Plurality of the directions of an instrument's timeframes (instrument_id, timeframe, direction).

    A tie is UNRESOLVED, yet a reference direction (UP, then DOWN, then RANGE) still tells who agrees.
    UNAVAILABLE is not counted.
    """
    fineness = F.array_position(F.array(*map(F.lit, ("M1", "M5", "H1", "H4", "D1", "W1"))), F.col("timeframe"))
    counts = scales.groupBy("instrument_id").agg(*[F.count_if(F.col("direction") == d).alias(d.lower()) for d in ("UP", "DOWN", "RANGE")], F.array_sort(F.collect_list(F.struct(fineness.alias("rank"), "timeframe", "direction"))).alias("all"))  # six at most
    up, down, rng = F.col("up"), F.col("down"), F.col("range")
    dominant = F.when((up > down) & (up > rng), "UP").when((down > up) & (down > rng), "DOWN").when((rng > up) & (rng > down), "RANGE").otherwise("UNRESOLVED")
    reference = F.when(F.col("dominant_direction") != "UNRESOLVED", F.col("dominant_direction")).when((up >= down) & (up >= rng), "UP").when((down >= up) & (down >= rng), "DOWN").when(rng > 0, "RANGE").otherwise("UNRESOLVED")
    judged = counts.withColumn("dominant_direction", dominant).withColumn("reference", reference)
    agree = F.filter("all", lambda s: s["direction"] == F.col("reference"))
    differ = F.filter("all", lambda s: (s["direction"] != F.col("reference")) & (s["direction"] != "UNAVAILABLE"))
    named = judged.withColumns({"agree": agree, "differ": differ})
    a, d = F.size("agree"), F.size("differ")
    word = F.when((d == 0) & (a > 0), "UNANIMOUS").when(a > d, "MAJORITY").when((a == d) & (a > 0), "SPLIT").otherwise("UNAVAILABLE")
    list_of: Column = lambda c: F.array_join(F.transform(c, lambda s: s["timeframe"]), ",")
    return named.select("instrument_id", "dominant_direction", word.alias("agreement"), list_of("agree").alias("agreeing"), list_of("differ").alias("disagreeing"), F.try_element_at(F.transform("agree", lambda s: s["timeframe"]), F.lit(1)).alias("dominant_scale"))


__all__ = ["WEEK_NS", "append_later", "asof", "complete_cases", "cross_scale", "exact_pairs", "frames_with_bars", "greedy_band", "prior_week", "union_pool"]
