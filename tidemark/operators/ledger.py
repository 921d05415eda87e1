"""Costs and benefits of a structure over time, each relative to its own strictly prior magnitudes.

Input rows: instrument_id, timeframe, timestamp_ns, xi, A, lambda, theta, G of the kernel, and coherence
and contraction of the observer (null where it has none). Everything is a window over one series; what is
"prior" is strictly prior. Channels for which no evidence exists (functional gain, external integration,
verified outcome) are not available in any row and have no column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES

# Rows of a window and of a reference, weight of a row against the next newer one, least
# rows that a mean or a reference needs.
WINDOW = 32
DECAY = 0.9394130628134758
SUPPORT = 8

COSTS = ("retained_friction", "accumulated_debt", "capacity_consumption", "excess_persistence", "adverse_trend")
BENEFITS = ("structural_recovery", "adaptive_organization_level")
#: The differences that have two known sides.
DIFFERENTIALS = {f"friction_vs_{b.split('_')[1]}": ("retained_friction", b) for b in BENEFITS}


def _by():
    return Window.partitionBy(*SERIES).orderBy("timestamp_ns")


def _faded(values: Column) -> Column:
    """Mean of a list in time order, each value weighing DECAY times the next newer one."""
    weight = lambda i: F.pow(F.lit(DECAY), (F.size(values) - i - 1).cast("double"))
    add = lambda s, x: s + x
    return F.try_divide(F.aggregate(F.transform(values, lambda x, i: x * weight(i)), F.lit(0.0), add), F.aggregate(F.transform(values, lambda x, i: weight(i)), F.lit(0.0), add))


def raw_channels(rows: DataFrame) -> DataFrame:
    """The seven channels of each row, before they are made relative."""
    held = _by().rowsBetween(1 - WINDOW, 0)
    whole = _by().rowsBetween(Window.unboundedPreceding, 0)
    organized = F.col("coherence") * (1 - F.col("contraction"))
    out = rows.select(
        *SERIES,
        "timestamp_ns",
        F.collect_list("xi").over(held).alias("xis"),
        F.collect_list(F.greatest(-F.col("G"), F.lit(0.0))).over(held).alias("falls"),
        F.greatest(F.col("A") - F.first("A").over(held), F.lit(0.0)).alias("accumulated_debt"),
        F.greatest(F.first("lambda").over(whole) - F.col("lambda"), F.lit(0.0)).alias("capacity_consumption"),
        F.avg((F.col("xi") > F.col("theta")).cast("double")).over(held).alias("excess_persistence"),
        F.greatest(F.col("lambda") - F.min("lambda").over(held), F.lit(0.0)).alias("structural_recovery"),
        F.when(F.count(organized).over(held) >= SUPPORT, F.avg(organized).over(held)).alias("adaptive_organization_level"),
    )
    return out.withColumns({"retained_friction": _faded(F.col("xis")), "adverse_trend": _faded(F.col("falls"))}).select(*SERIES, "timestamp_ns", *COSTS, *BENEFITS)


def relative(value: Column) -> Column:
    """|x| / (|x| + median of |x| over the WINDOW strictly prior rows).

    Null where x is, where fewer than SUPPORT prior values are known, and where the median is 0 but x isn't.
    """
    prior = _by().rowsBetween(-WINDOW, -1)
    size = F.abs(value)
    usual = F.when(F.count(size).over(prior) >= SUPPORT, F.percentile(size, F.lit(0.5)).over(prior))
    return F.when(usual > 0, size / (size + usual)).when((usual == 0) & (size == 0), 0.0)


def ledger(rows: DataFrame) -> DataFrame:
    """Raw and relative channels, and of each known difference value, change and exposure.

    The change is null unless the row before has the difference too; the exposure sums the positive
    differences so far, a missing one adding nothing.
    """
    raw = raw_channels(rows)
    made = raw.withColumns({f"relative_{c}": relative(F.col(c)) for c in (*COSTS, *BENEFITS)})
    made = made.withColumns({d: F.col(f"relative_{c}") - F.col(f"relative_{b}") for d, (c, b) in DIFFERENTIALS.items()})
    whole = _by().rowsBetween(Window.unboundedPreceding, 0)
    added = {}
    for d in DIFFERENTIALS:
        added[f"{d}_trend"] = F.col(d) - F.lag(d).over(_by())
        added[f"{d}_exposure"] = F.coalesce(F.sum(F.greatest(F.col(d), F.lit(0.0))).over(whole), F.lit(0.0))
    return made.withColumns(added)
