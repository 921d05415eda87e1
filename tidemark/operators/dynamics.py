"""How a state moves: velocities, prior z-scores, ages and streaks, daily against weekly.

Input rows: instrument_id, timeframe, timestamp_ns, delta, lambda, state, values array<double>.
All windows; ages and streaks are gaps and islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .align import prior_week

def by():
    """Each series in order."""
    return Window.partitionBy(*SERIES).orderBy("timestamp_ns")
def earlier():
    """The strictly prior rows of each series."""
    return by().rowsBetween(Window.unboundedPreceding, -1)

DERIVATIVES = ("delta_velocity", "delta_acceleration", "delta_reversal")
STATISTICS = ("pressure_z", "momentum_z", "transition_z", "regime_age", "momentum_streak", "pressure_recovery")
MULTISCALE = ("scale_dispersion", "scale_coherence", "scale_dispersion_change")
#: The nested variants: what each adds to the base vector.
VARIANTS = {"A": (), "B": DERIVATIVES, "C": DERIVATIVES + STATISTICS, "D": DERIVATIVES + STATISTICS + MULTISCALE}


def prior_z(x: str) -> Column:
    """z-score against the strictly prior rows: null with fewer than two, 0 if they don't vary."""
    n, mean, dev = F.count(x).over(earlier()), F.avg(x).over(earlier()), F.stddev_pop(x).over(earlier())
    return F.when((n >= 2) & F.col(x).isNotNull(), F.when(dev > 0, F.try_divide(F.col(x) - mean, dev)).otherwise(0.0))


def pairwise_rms(a: Column, b: Column) -> Column:
    """Root mean square difference over the places where both arrays have a value."""
    both = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda d: d.isNotNull())
    return F.when(F.size(both) > 0, F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(both), F.lit(1))))


def cosine(a: Column, b: Column) -> Column:
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, x: s + x)
    xx, yy = total(lambda p: p["x"] * p["x"]), total(lambda p: p["y"] * p["y"])
    return F.when((xx > 0) & (yy > 0), F.try_divide(total(lambda p: p["x"] * p["y"]), F.sqrt(xx * yy)))


def _run_length(change: str, name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the place of each row in its run; a true ``change`` begins a run."""
    island = F.sum(F.when(F.coalesce(change, F.lit(True)), 1).otherwise(0)).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).withColumn(name, F.row_number().over(Window.partitionBy(*SERIES, "island").orderBy("timestamp_ns"))).drop("island")


def features(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """The twelve added features of each daily row beside what they are made of."""
    rows = daily.select(*SERIES, "timestamp_ns", "delta", "state", "values", (1.0 - F.col("lambda")).alias("pressure"))
    rows = rows.withColumn("delta_velocity", F.col("delta") - F.lag("delta").over(by()))
    before = F.lag("delta_velocity").over(by())
    rows = rows.withColumns({"delta_acceleration": F.col("delta_velocity") - before, "velocity_before": before})
    opposed = F.signum("delta_velocity") * F.signum("velocity_before") < 0
    rows = rows.withColumn("delta_reversal", F.when(F.col("velocity_before").isNotNull() & F.col("delta_velocity").isNotNull(), F.when(opposed, F.least(F.abs("delta_velocity"), F.abs("velocity_before"))).otherwise(0.0)))
    rows = rows.withColumn("transition", pairwise_rms(F.col("values"), F.lag("values").over(by())))
    rows = rows.withColumns({"pressure_z": prior_z("pressure"), "momentum_z": prior_z("delta_velocity"), "transition_z": prior_z("transition"), "pressure_recovery": F.lag("pressure").over(by()) - F.col("pressure")})
    rows = rows.withColumns({"new_regime": F.col("state") != F.lag("state").over(by()), "new_sign": F.signum("delta_velocity") != F.signum("velocity_before")})
    rows = _run_length("new_regime", "regime_age", rows)
    rows = _run_length("new_sign", "momentum_streak", rows).withColumn("momentum_streak", F.when(F.col("delta_velocity").isNotNull(), F.col("momentum_streak")))
    week = prior_week(daily, weekly, "values").select(*SERIES, "timestamp_ns", F.col("prior_value").alias("week_values"))
    rows = rows.join(week, [*SERIES, "timestamp_ns"], "left")
    six = lambda c: F.slice(c, 1, 6)
    rows = rows.withColumns({"scale_dispersion": pairwise_rms(six("values"), six("week_values")), "scale_coherence": cosine(six("values"), six("week_values"))})
    return rows.withColumn("scale_dispersion_change", F.col("scale_dispersion") - F.last("scale_dispersion", ignorenulls=True).over(earlier()))


def variant(rows: DataFrame, name: str) -> DataFrame:
    """The vector of one nested variant: base values, then what the variant adds."""
    added = [F.col(c).cast("double") for c in VARIANTS[name]]
    values = F.concat("values", F.array(*added)) if added else F.col("values")
    return rows.select(*SERIES, "timestamp_ns", values.alias("vector"))


def cosine_of_pairs(pairs: DataFrame) -> DataFrame:
    """Pooled cosine of aligned vectors (keys: pair): one number for each pair of series.

    Only places where both are finite count, and rows where either side is all zero do not.
    """
    rows = pairs.select("pair", F.filter(F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])).alias("p"))
    total = lambda f: F.aggregate(F.transform("p", f), F.lit(0.0), lambda s, x: s + x)
    sums = rows.select("pair", total(lambda p: p["x"] * p["y"]).alias("xy"), total(lambda p: p["x"] * p["x"]).alias("xx"), total(lambda p: p["y"] * p["y"]).alias("yy")).where("xx > 0 AND yy > 0")
    return sums.groupBy("pair").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.count("*").alias("rows")).select("pair", "rows", (F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("similarity"))


def agreement(valid: Column, same: Column) -> Column:
    """ALIGNED if more rows match than not; a tie diverges; no valid row: UNAVAILABLE."""
    yes, no = F.count_if(valid & same), F.count_if(valid & ~same)
    return F.when((yes == 0) & (no == 0), "UNAVAILABLE").when(yes > no, "ALIGNED").otherwise("DIVERGING")


def relation(similarity: Column, words: list[Column]) -> Column:
    """The relation of two series from their similarity and up to four agreements, first rule wins."""
    count = lambda w: sum((F.when(x == w, 1).otherwise(0) for x in words), F.lit(0))
    aligned, diverging = count("ALIGNED"), count("DIVERGING")
    return F.when((similarity >= 0.7) & (aligned >= 3) & (diverging == 0), "STRONG_ALIGNMENT").when((similarity >= 0.4) & (aligned >= 1) & (diverging == 0), "WEAK_ALIGNMENT").when((aligned == 0) & (diverging >= 2), "DIVERGENCE").when(similarity >= 0.5, "WEAK_ALIGNMENT").otherwise("UNAVAILABLE")
