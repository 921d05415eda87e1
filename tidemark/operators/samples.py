"""Robust normalisation and distances of masked feature vectors.

A sample row: sample_id, vector array<double> (null where a dimension is not available). Masks are
arrays of booleans; rows are comparable only if their masks are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .metric_index import MetricIndex
from .selection import quantiles


def fit_normalization(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """axis, median, scale, effective: one row for each dimension.

    The scale is the median absolute deviation, else half the range, else 1; a constant dimension is
    not effective. Exact quantiles with a bounded state (see ``selection``). With ``by``, one row for each of
    its groups and dimension.
    """
    by = by or []
    cells = samples.select(*by, F.posexplode("vector").alias("axis", "x"))
    key = [*by, "axis"]
    centre = stored(quantiles(cells, key, "x", {"low": 0.0, "median": 0.5, "high": 1.0}), "centres")
    off = cells.join(centre.select(*key, "median"), key).select(*key, F.abs(F.col("x") - F.col("median")).alias("off"))
    spread = quantiles(off, key, "off", {"mad": 0.5}).drop("n")
    axes = cells.select(*key).distinct().join(centre, key, "left").join(spread, key, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    wide = F.coalesce(F.col("high") - F.col("low"), F.lit(0.0))
    return axes.select(*key, "median", F.when(F.coalesce("mad", F.lit(0.0)) > 0, F.col("mad")).when(wide > 0, wide / 2).otherwise(1.0).alias("scale"), (wide > 0).alias("effective"))


def _literal(normalization: DataFrame) -> tuple[Column, Column, Column]:
    rows = sorted(normalization.collect(), key=lambda r: r.axis)  # one row for each dimension
    return F.lit([r["median"] for r in rows]), F.lit([r["scale"] for r in rows]), F.lit([r["effective"] for r in rows])


def normalize(samples: DataFrame, normalization: DataFrame) -> DataFrame:
    """``samples`` with vector scaled (null as 0.0), mask (available and effective) and mask_key."""
    median, scale, effective = _literal(normalization)
    mask = F.zip_with("vector", effective, lambda x, e: x.isNotNull() & e)
    scaled = F.zip_with(F.zip_with("vector", median, lambda x, m: x - m), scale, lambda d, s: F.coalesce(d / s, F.lit(0.0)))
    return samples.withColumn("mask", mask).withColumn("vector", scaled).withColumn("mask_key", F.array_join(F.transform("mask", lambda m: F.when(m, "1").otherwise("0")), ""))


def masked_distance(a: str, b: str, mask: str) -> Column:
    """Root mean square over the dimensions of the mask; none: infinity."""
    squares = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), mask, lambda d, m: F.when(m, d).otherwise(0.0))
    active = F.size(F.filter(mask, lambda m: m))
    return F.when(active == 0, float("inf")).otherwise(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.greatest(active, F.lit(1))))


def neighbours(queries: DataFrame, library: DataFrame, k: int, most: float | Column | None = None, eligible: str = "all") -> DataFrame:
    """q_ and l_ columns, rank and distance: the k nearest of equal mask within ``most``.

    ``queries`` and ``library`` come from ``normalize``. ``eligible`` says which rows count: "all", "others"
    than the query itself, or "matured" ones, whose at and known_at are both before the query's at. Exact;
    see ``metric_index``.
    """
    return MetricIndex(library).search(queries, k, most, eligible)[0]


def kth_distance(queries: DataFrame, library: DataFrame, k: int, eligible: str = "all") -> DataFrame:
    """query_id, distance of the k-th nearest of equal mask (of the last, if there are fewer)."""
    met = neighbours(queries, library, k, None, eligible)
    return met.groupBy(F.col("q_sample_id").alias("query_id")).agg(F.max("distance").alias("kth_distance"), F.count("*").alias("n"))


CLASSES = ("UP", "RANGE", "DOWN")
#: Square root of the double epsilon: distances under it weigh alike.
FLOOR = 2.0**-26


def basis_points(up: Column, centre: Column, down: Column) -> Column:
    """Three shares of 10,000 by largest remainder; remainder ties go in class order; no mass: all RANGE."""
    total = up + centre + down
    sound = (total > 0) & ~F.isnan(total) & (total != float("inf"))
    exact = F.array(*[F.when(sound, x / F.when(total > 0, total).otherwise(1.0) * 10_000).otherwise(0.0) for x in (up, centre, down)])
    whole = F.transform(exact, lambda x: F.floor(x))
    rest = F.lit(10_000) - F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x)
    order = F.transform(F.array_sort(F.transform(exact, lambda x, i: F.struct((F.floor(x) - x).alias("less"), i.alias("axis")))), lambda s: s["axis"])
    given = F.transform(whole, lambda x, i: x + F.when(F.array_position(order, i) <= rest, 1).otherwise(0))
    return F.when(sound, given).otherwise(F.array(F.lit(0).cast("long"), F.lit(10_000).cast("long"), F.lit(0).cast("long")))


def vote(met: DataFrame, least: int, power: float = 1.0) -> DataFrame:
    """Each query's vote of its neighbours: support, basis points, winner and edge.

    ``met`` is from ``neighbours``, its library having ``direction``. Queries with fewer than
    ``least`` neighbours abstain and give no row. A tie goes to UP, then RANGE, then DOWN.
    """
    weight = 1.0 / F.pow(F.greatest("distance", F.lit(FLOOR)), F.lit(power))
    mass = [F.sum(F.when(F.col("l_direction") == c, weight).otherwise(0.0)).alias(f"mass_{c.lower()}") for c in CLASSES]
    counted = met.groupBy(F.col("q_sample_id").alias("query_id")).agg(F.count("*").alias("support"), *mass).where(F.col("support") >= least)
    bp = counted.withColumn("bp", basis_points(F.col("mass_up"), F.col("mass_range"), F.col("mass_down")))
    named = bp.select("*", F.col("bp")[0].alias("up_bp"), F.col("bp")[1].alias("range_bp"), F.col("bp")[2].alias("down_bp")).drop("bp")
    ranked = F.sort_array(F.array("up_bp", "range_bp", "down_bp"), asc=False)
    winner = F.when((F.col("up_bp") >= F.col("range_bp")) & (F.col("up_bp") >= F.col("down_bp")), "UP").when(F.col("range_bp") >= F.col("down_bp"), "RANGE").otherwise("DOWN")
    return named.withColumns({"winner": winner, "edge_bp": ranked[0] - ranked[1]})


def weighted_horizon(met: DataFrame, votes: DataFrame, power: float = 1.0, seconds: int = 86_400) -> DataFrame:
    """Weighted quartiles of the first-passage bars of each winner's neighbours: the first value whose
    cumulative weight reaches the quantile."""
    weight = 1.0 / F.pow(F.greatest("distance", F.lit(FLOOR)), F.lit(power))
    mine = met.join(votes.select(F.col("query_id").alias("q_sample_id"), "winner"), "q_sample_id").where(F.col("l_direction") == F.col("winner")).select(F.col("q_sample_id").alias("query_id"), F.col("l_first_passage_bars").alias("bars"), weight.alias("weight"), "rank")
    by = Window.partitionBy("query_id")  # k rows at most
    run = mine.withColumns({"reached": F.sum("weight").over(by.orderBy("bars", "rank").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("weight").over(by)})
    quantile = lambda q: F.min(F.when(F.col("reached") >= F.col("total") * q, F.col("bars")))
    return run.groupBy("query_id").agg(quantile(0.25).alias("p25_bars"), quantile(0.5).alias("median_bars"), quantile(0.75).alias("p75_bars")).withColumn("median_seconds", F.col("median_bars").cast("long") * seconds)
