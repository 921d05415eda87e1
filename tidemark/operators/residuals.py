"""Corrections of probability forecasts by what a feature tells about their error.

Rows are cases with p_up, p_range, p_down, actual and features. A fit on validation rows standardises the
feature, takes the mean error of each class (intercept) and the least-squares slope of what remains on the
standardised feature. It is applied without the intercept and with the feature held within the range that
it had in validation, and the result is put back on the simplex: negative shares become 0, the rest is
rescaled. All of it is one aggregation for each group and fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import ORDER

NAMES = tuple(d.lower() for d in ORDER)


def forecasts(cases: DataFrame) -> DataFrame:
    """Resolved cases with their shares as p_up, p_range and p_down."""
    return cases.where("up_bp IS NOT NULL").withColumns({f"p_{n}": F.col(f"{n}_bp") / 10_000.0 for n in NAMES})


def _error(n: str) -> Column:
    return F.when(F.col("actual") == n.upper(), 1.0).otherwise(0.0) - F.col(f"p_{n}")


def fit(rows: DataFrame, feature: str, by: list[str]) -> DataFrame:
    """One row for each group whose feature varies: n, mean, dev (population), low and high (standardised
    range), and intercept and slope of each class."""
    known = rows.where(F.col(feature).isNotNull())
    stats = known.groupBy(*by).agg(F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("dev")).where("dev > 0 AND dev < double('infinity')")
    z = (F.col(feature) - F.col("mean")) / F.col("dev")
    scaled = known.join(stats, by).withColumn("z", z)
    sums = scaled.groupBy(*by, "mean", "dev").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"), *[F.sum(_error(n)).alias(f"se_{n}") for n in NAMES], *[F.sum(F.col("z") * _error(n)).alias(f"sze_{n}") for n in NAMES])
    intercept = {n: F.col(f"se_{n}") / F.col("n") for n in NAMES}
    slope = {n: F.when(F.col("szz") > 0, (F.col(f"sze_{n}") - intercept[n] * F.col("sz")) / F.col("szz")).otherwise(0.0) for n in NAMES}
    return sums.select(*by, "n", "mean", "dev", "low", "high", *[intercept[n].alias(f"intercept_{n}") for n in NAMES], *[slope[n].alias(f"slope_{n}") for n in NAMES])


def apply(rows: DataFrame, feature: str, fitted: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` of the fitted groups with p_up, p_range and p_down corrected; without a feature they stay."""
    met = rows.join(fitted.select(*by, "mean", "dev", "low", "high", *[f"slope_{n}" for n in NAMES]), by)
    z = F.greatest(F.least((F.col(feature) - F.col("mean")) / F.col("dev"), F.col("high")), F.col("low"))
    moved = {n: F.greatest(F.col(f"p_{n}") + F.col(f"slope_{n}") * z, F.lit(0.0)) for n in NAMES}
    total = moved["up"] + moved["range"] + moved["down"]
    share = {n: F.when(F.col(feature).isNull(), F.col(f"p_{n}")).when((total > 0) & (total < float("inf")), moved[n] / total).otherwise(1 / 3) for n in NAMES}
    return met.withColumns({f"p_{n}": x for n, x in share.items()}).select(*rows.columns)


def brier() -> Column:
    """The Brier score of a row's shares."""
    parts = [_error(n) * _error(n) for n in NAMES]
    return parts[0] + parts[1] + parts[2]


def sequential(validation: DataFrame, evaluation: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """For each group the evaluation cases and four Brier scores: as forecast, corrected by the first
    feature, by the second, and by the second fitted on what the first correction leaves."""
    one, two = fit(validation, first, by), fit(validation, second, by)
    after = fit(apply(validation, first, one, by), second, by)
    # The second fit's support is that of the feature, whatever the forecasts are.
    scored = {"brier": evaluation, "brier_first": apply(evaluation, first, one, by), "brier_second": apply(evaluation, second, two, by), "brier_both": apply(apply(evaluation, first, one, by), second, after, by)}
    out = None
    for name, rows in scored.items():
        part = rows.groupBy(*by).agg(F.count("*").alias("cases"), F.avg(brier()).alias(name))
        out = part if out is None else out.join(part.drop("cases"), by)
    return out
