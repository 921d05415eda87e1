"""Scores of a held-out set: reliability, recall, Wilson bounds, Brier scores, gates.

A case row: predicted, actual, up_bp, range_bp, down_bp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z = 1.959963984540054

ORDER = ("UP", "RANGE", "DOWN")


def ratio_bp(part: Column, whole: Column) -> Column:
    """Half-up basis points in whole numbers; 0 of 0 is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor((part * 10_000 + F.floor(whole / 2)) / F.greatest(whole, F.lit(1)))).cast("long")


def wilson_lower_bp(part: Column, whole: Column) -> Column:
    """Lower end of the 95 % Wilson interval, rounded to basis points."""
    n = F.greatest(whole, F.lit(1)).cast("double")
    p, z2 = part / n, Z * Z
    low = ((p + z2 / (2 * n)) - Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(F.greatest(F.least(low, F.lit(1.0)), F.lit(0.0)) * 10_000 + 0.5).cast("long"))


def reliability(cases: DataFrame) -> DataFrame:
    """For each predicted class: cases, how many are right, their share and its Wilson bound."""
    counted = cases.groupBy(F.col("predicted").alias("direction")).agg(F.count("*").alias("cases"), F.count_if(F.col("predicted") == F.col("actual")).alias("correct"))
    return counted.withColumns({"precision_bp": ratio_bp(F.col("correct"), F.col("cases")), "lower_bp": wilson_lower_bp(F.col("correct"), F.col("cases"))})


def recall(cases: DataFrame) -> DataFrame:
    counted = cases.groupBy(F.col("actual").alias("direction")).agg(F.count("*").alias("cases"), F.count_if(F.col("predicted") == F.col("actual")).alias("correct"))
    return counted.withColumn("recall_bp", ratio_bp(F.col("correct"), F.col("cases")))


def brier(actual: str = "actual", bp: tuple[str, str, str] = ("up_bp", "range_bp", "down_bp")) -> Column:
    parts = [F.pow(F.col(c) / 10_000.0 - F.when(F.col(actual) == d, 1.0).otherwise(0.0), 2) for c, d in zip(bp, ORDER, strict=True)]
    return parts[0] + parts[1] + parts[2]


def summary(cases: DataFrame, library: DataFrame) -> DataFrame:
    """One row: accuracy, truncated balanced accuracy, Brier score, climatology, skill, calibration.

    ``library`` gives the class frequencies (column ``direction``) that climatology forecasts.
    """
    share = library.agg(F.count("*").alias("n"), *[F.count_if(F.col("direction") == d).alias(d.lower()) for d in ORDER])
    freq = [F.try_divide(F.col(d.lower()), F.col("n")) for d in ORDER]
    balanced = recall(cases).agg(F.floor(F.sum("recall_bp") / F.greatest(F.count("*"), F.lit(1))).alias("balanced_accuracy_bp"))
    hits = [F.count_if(F.col("actual") == d).alias(f"actual_{d.lower()}") for d in ORDER]
    mean = [F.avg(F.col(c) / 10_000.0).alias(f"mean_{d.lower()}") for c, d in zip(("up_bp", "range_bp", "down_bp"), ORDER, strict=True)]
    total = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("predicted") == F.col("actual")).alias("correct"), F.coalesce(F.avg(brier()), F.lit(0.0)).alias("brier"), *hits, *mean)
    one = total.join(F.broadcast(share), F.lit(1) == F.lit(1)).join(F.broadcast(balanced), F.lit(1) == F.lit(1))  # one row each
    squares = sum((f * f for f in freq[1:]), freq[0] * freq[0])
    weighted = sum((F.col(f"actual_{d.lower()}") * f for d, f in zip(ORDER[1:], freq[1:], strict=True)), F.col("actual_up") * freq[0])
    climate = F.when((F.col("cases") == 0) | (F.col("n") == 0), 0.0).otherwise(1 + squares - 2 * weighted / F.greatest(F.col("cases"), F.lit(1)))
    gap = sum((F.abs(F.col(f"mean_{d.lower()}") - F.try_divide(F.col(f"actual_{d.lower()}"), F.col("cases"))) for d in ORDER), F.lit(0.0)) / 3
    out = one.withColumn("climatology", climate)
    return out.select("cases", "correct", ratio_bp(F.col("correct"), F.col("cases")).alias("accuracy_bp"), F.coalesce("balanced_accuracy_bp", F.lit(0)).cast("long").alias("balanced_accuracy_bp"), "brier", "climatology", F.when(F.col("climatology") > 0, 1 - F.col("brier") / F.col("climatology")).alias("skill"), gap.alias("calibration_error"))


def confusion(cases: DataFrame) -> DataFrame:
    """All nine pairs of classes with their counts, zeros kept."""
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.count_if((F.col("actual") == a) & (F.col("predicted") == p)).alias("cases")) for a in ORDER for p in ORDER]
    return cases.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def publish(votes: DataFrame, skill: float, edge_bp: int, reliability_bp: dict[str, int], eligible: bool = True, least_reliability_bp: int = 5_000) -> DataFrame:
    """Each vote's gate, in order: support, eligibility, skill, edge, reliability; else PUBLISHED."""
    trusted = F.create_map(*[F.lit(x) for d in ORDER for x in (d, reliability_bp.get(d, 0))])
    gate = F.when(F.col("winner").isNull(), "NO_SUPPORT").when(F.lit(not eligible), "NOT_ELIGIBLE").when(F.lit(skill <= 0), "NO_SKILL").when(F.col("edge_bp") < edge_bp, "EDGE_TOO_SMALL").when(trusted[F.col("winner")] < least_reliability_bp, "UNRELIABLE").otherwise("PUBLISHED")
    return votes.withColumn("gate", gate).withColumn("published", F.when(F.col("gate") == "PUBLISHED", F.col("winner")).otherwise("UNRESOLVED"))
