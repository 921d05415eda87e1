"""Reports over samples, neighbours and scored cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairwise
from .pairwise import AllPairs
from .selection import quantiles

#: Quantiles of every distance report.
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def distance_stats(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count and exact linear quantiles of ``value`` for each group that has one."""
    return quantiles(rows, group, value, dict(zip(("least", "p10", "p25", "p50", "p75", "most"), QUANTILES, strict=True)))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The upper middle of whole numbers: the element at n div 2 in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("here"))  # a row for each different value
    by = Window.partitionBy(*group)
    upto = counts.select(*group, value, "here", F.sum("here").over(by.orderBy(value)).alias("upto"), F.sum("here").over(by).alias("n"))
    place = F.floor(F.col("n") / 2) + 1
    return upto.where((F.col("upto") >= place) & (F.col("upto") - F.col("here") < place)).select(*group, F.col(value).alias("upper_median"))


def guarded_corr(x: str, y: str) -> Column:
    """Population correlation; null with fewer than two pairs or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    dx, dy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    return F.when((F.count_if(both) >= 2) & (dx > 0) & (dy > 0), F.try_divide(F.covar_pop(x, y), dx * dy))


def availability(samples: DataFrame, vector: str = "vector") -> DataFrame:
    """For each dimension: rows and the share, in basis points, that have a value."""
    cells = samples.select(F.posexplode(vector).alias("axis", "x"))
    return cells.groupBy("axis").agg(F.count("*").alias("rows"), F.floor((F.count("x") * 10_000 + F.floor(F.count("*") / 2)) / F.count("*")).cast("long").alias("available_bp"))


def compactness(pairs: AllPairs, ks: tuple[int, ...] = (5, 10, 20), causal: bool = False) -> DataFrame:
    """Nearest of the same class, nearest of another, and the share of the same class in the top k.

    With ``causal`` only earlier samples count.
    """
    share = [F.try_divide(F.count_if(F.col("same") & (F.col("rank") <= k)), F.count_if(F.col("rank") <= k)).alias(f"same_share_{k}") for k in ks]
    return pairwise.nearest(pairs, max(ks), causal, share)


def class_geometry(pairs: AllPairs) -> DataFrame:
    """For each query and class: quantiles of distance and the rank of the nearest of the class."""
    return pairwise.class_stats(pairs, dict(zip(("least", "p10", "p25", "p50", "p75", "most"), QUANTILES, strict=True)))


def top_dimensions(met: DataFrame, top: int = 5) -> DataFrame:
    """Which dimensions make up each query's distances: mean share over its neighbours, largest first.

    ``met`` is from ``samples.neighbours``. Equal shares go by the lower dimension; a neighbour at
    distance 0 contributes nothing.
    """
    squares = F.zip_with(F.zip_with("q_vector", "l_vector", lambda a, b: (a - b) * (a - b)), "q_mask", lambda d, m: F.when(m, d).otherwise(0.0))
    cells = met.select(F.col("q_sample_id").alias("query_id"), "l_sample_id", F.posexplode(squares).alias("axis", "square"))
    total = F.sum("square").over(Window.partitionBy("query_id", "l_sample_id"))
    share = cells.withColumn("share", F.when(total > 0, F.try_divide(F.col("square"), total)).otherwise(0.0))
    mean = share.groupBy("query_id", "axis").agg(F.avg("share").alias("mean_share"))
    by = Window.partitionBy("query_id").orderBy(F.round("mean_share", 12).desc(), "axis")
    return mean.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top)


def rank_variants(scores: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` with place in each group, best first: skill, balanced accuracy, calibration error, coverage
    (these to 12 places), fewer dimensions, name of the variant."""
    order = [F.round("skill", 12).desc(), F.round("balanced_accuracy", 12).desc(), F.round("calibration_error", 12), F.round("coverage", 12).desc(), F.asc("dimensions"), F.asc("variant")]
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))  # a row for each variant
