"""Walk-forward scoring: every query sees only what was known before it.

A candidate row: instrument_id, timeframe, at (its time), known_at (when its outcome was known), vector
(null where a dimension isn't available), direction. Training rows fit the normalisation, validation rows
the distance limit and the power, evaluation rows are scored. A row may serve a query as a neighbour, and
in the class frequencies that it is held against, only if its time and the time its outcome became known
are both before the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.bars import SERIES
from . import samples as S
from .metric_index import MetricIndex
from .scoring import ORDER, ratio_bp
from .selection import select_places, sizes

TRAIN, VALIDATION, EVALUATION = "TRAIN", "VALIDATION", "EVALUATION"


def candidates(frames: DataFrame, bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames (SERIES, timestamp_ns, vector) that have an outcome, with the time it was known: the close
    of the bar that the first passage ended in."""
    by = Window.partitionBy(*SERIES).orderBy("close_time_ns")
    numbered = bars.select(*SERIES, "close_time_ns", F.row_number().over(by).alias("n"))
    told = labels.where("direction <> 'CENSORED'").select(*SERIES, "close_time_ns", "direction", "first_passage_bars").join(numbered, [*SERIES, "close_time_ns"])
    ends = numbered.select(*SERIES, F.col("n").alias("end"), F.col("close_time_ns").alias("known_at"))
    known = told.withColumn("end", F.col("n") + F.col("first_passage_bars")).join(ends, [*SERIES, "end"])
    return known.select(*SERIES, F.col("close_time_ns").alias("timestamp_ns"), "direction", "known_at").join(frames, [*SERIES, "timestamp_ns"]).withColumnRenamed("timestamp_ns", "at")


def split(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """``rows`` with part. Of a series' n ``frames`` (SERIES, at) the last isqrt(n) times are for evaluation,
    as many before them for validation. The edges are two order statistics of each series."""
    values, size = sizes(frames, SERIES, "at")
    held = F.floor(F.sqrt(F.col("n"))).cast("long")
    edges = size.select("*", F.explode(F.array(F.struct(F.lit("last").alias("target"), held.alias("back")), F.struct(F.lit("middle").alias("target"), (2 * held).alias("back")))).alias("e"))
    found = select_places(values, SERIES, edges.select(*SERIES, "e.target", F.greatest(F.col("n") - F.col("e.back"), F.lit(0)).alias("place"), "n", "low", "high"))
    both = found.groupBy(*SERIES).agg(*[F.max(F.when(F.col("target") == t, F.col("value"))).alias(f"edge_{t}") for t in ("middle", "last")])
    part = F.when(F.col("at") >= F.col("edge_last"), EVALUATION).when(F.col("at") >= F.col("edge_middle"), VALIDATION).otherwise(TRAIN)
    return rows.join(both, SERIES).withColumn("part", part).drop("edge_middle", "edge_last")


def scaled(rows: DataFrame) -> DataFrame:
    """``rows`` normalised by their series' training rows, with sample_id (their time), mask and mask_key (one
    for each series and mask), and ``effective``: the dimensions that vary in training."""
    return scale(rows, S.fit_normalization(rows.where(F.col("part") == TRAIN), SERIES))


def scale(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``scaled`` by a fitted normalisation; a series without one gives no row."""
    spec = fitted.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("axis", "median", "scale", "effective"))).alias("axes"))  # a row for each dimension
    mask = F.zip_with("vector", "axes", lambda x, a: x.isNotNull() & a["effective"])
    vector = F.zip_with("vector", "axes", lambda x, a: F.coalesce((x - a["median"]) / a["scale"], F.lit(0.0)))
    met = rows.join(spec, SERIES).withColumns({"mask": mask, "vector": vector, "effective": F.size(F.filter("axes", lambda a: a["effective"]))}).drop("axes")
    bits = F.array_join(F.transform("mask", lambda m: F.when(m, "1").otherwise("0")), "")
    return met.withColumn("mask_key", F.concat_ws("|", *SERIES, bits)).withColumn("sample_id", F.col("at"))


def settings(rows: DataFrame) -> DataFrame:
    """k and least_support of each series, from its number of training rows."""
    n = rows.where(F.col("part") == TRAIN).groupBy(*SERIES).agg(F.count("*").alias("train"))
    k = F.greatest(F.floor(F.sqrt("train")), F.lit(1)).cast("int")
    bits = F.length(F.bin("train"))
    return n.select(*SERIES, "train", k.alias("k"), F.least(bits, k).cast("int").alias("least_support"))


def frequencies(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(SERIES, at, up, range, down, library): outcomes known before each query, by class.

    An outcome counts once both its clocks are before the query, so it is an event at the later of the two;
    counts are prefix sums in that order, and a query takes the last event strictly before it.
    """
    events = rows.select(*SERIES, F.greatest("at", "known_at").alias("t"), F.lit(1).alias("kind"), *[(F.col("direction") == d).cast("long").alias(d.lower()) for d in ORDER])
    asked = queries.select(*SERIES, F.col("at").alias("t"), F.lit(0).alias("kind"), *[F.lit(0).cast("long").alias(d.lower()) for d in ORDER])
    # At equal times the query (kind 0) comes first: what is known at its own time doesn't count.
    by = Window.partitionBy(*SERIES).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.unionByName(asked).select(*SERIES, "t", "kind", *[F.coalesce(F.sum(d.lower()).over(by), F.lit(0)).alias(d.lower()) for d in ORDER]).where("kind = 0").drop("kind").distinct()
    return sums.withColumnRenamed("t", "at").withColumn("library", sum((F.col(d.lower()) for d in ORDER), F.lit(0)))


def judged(met: DataFrame, queries: DataFrame, plan: DataFrame, power: float | Column) -> DataFrame:
    """Each query with its vote at a power (a number or a column of ``met``): predicted (UNRESOLVED without support), the basis points and
    the number of neighbours."""
    weight = 1.0 / F.pow(F.greatest("distance", F.lit(S.FLOOR)), F.lit(power))
    mass = [F.sum(F.when(F.col("l_direction") == c, weight).otherwise(0.0)).alias(c.lower()) for c in ORDER]
    counted = met.groupBy(*[F.col(f"q_{c}").alias(c) for c in SERIES], F.col("q_at").alias("at")).agg(F.count("*").alias("neighbours"), *mass)
    bp = counted.withColumn("bp", S.basis_points(F.col("up"), F.col("range"), F.col("down"))).select(*SERIES, "at", "neighbours", "bp")
    both = queries.select(*SERIES, "at", F.col("direction").alias("actual")).join(bp, [*SERIES, "at"], "left").join(plan.select(*SERIES, "least_support"), SERIES)
    voted = F.coalesce(F.col("neighbours") >= F.col("least_support"), F.lit(False))
    up, centre, down = (F.when(voted, F.col("bp")[i]) for i in range(3))
    winner = F.when(~voted, "UNRESOLVED").when((up >= centre) & (up >= down), "UP").when(centre >= down, "RANGE").otherwise("DOWN")
    return both.select(*SERIES, "at", "actual", winner.alias("predicted"), up.alias("up_bp"), centre.alias("range_bp"), down.alias("down_bp"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def metrics(rows: DataFrame, group: list[str] = SERIES) -> DataFrame:
    """Of cases with the frequencies known before them, one row for each series: observations, resolved, coverage, correct, accuracy, balanced accuracy, Brier
    score, that of the causal class frequencies, skill (0 if that is 0) and classwise calibration error."""
    there = F.col("predicted") != "UNRESOLVED"
    hit = {d: F.when(F.col("actual") == d, 1.0).otherwise(0.0) for d in ORDER}
    square = lambda p, d: (p - hit[d]) * (p - hit[d])
    own = sum((square(F.col(f"{d.lower()}_bp") / 10_000.0, d) for d in ORDER), F.lit(0.0))
    usual = sum((square(F.when(F.col("library") > 0, F.col(d.lower()) / F.col("library")).otherwise(0.0), d) for d in ORDER), F.lit(0.0))
    right = there & (F.col("predicted") == F.col("actual"))
    of = {d: F.count_if(there & (F.col("actual") == d)) for d in ORDER}
    recalls = [F.when(of[d] > 0, ratio_bp(F.count_if(right & (F.col("actual") == d)), of[d])) for d in ORDER]
    total = rows.groupBy(*group).agg(
        F.count("*").alias("observations"), F.count_if(there).alias("resolved"), F.count_if(right).alias("correct"),
        F.coalesce(F.avg(F.when(there, own)), F.lit(0.0)).alias("brier"), F.coalesce(F.avg(F.when(there, usual)), F.lit(0.0)).alias("climatology"),
        F.array(*recalls).alias("recalls"), *[F.avg(F.when(there, F.col(f"{d.lower()}_bp") / 10_000.0)).alias(f"mean_{d.lower()}") for d in ORDER], *[F.avg(F.when(there, hit[d])).alias(f"share_{d.lower()}") for d in ORDER],
    )
    known = F.filter("recalls", lambda x: x.isNotNull())
    balanced = F.when(F.size(known) > 0, F.floor(F.aggregate(known, F.lit(0).cast("long"), lambda s, x: s + x) / F.greatest(F.size(known), F.lit(1)))).otherwise(0) / 10_000.0
    gap = sum((F.abs(F.col(f"mean_{d.lower()}") - F.col(f"share_{d.lower()}")) for d in ORDER), F.lit(0.0)) / 3
    skill = F.when(F.col("climatology") > 0, 1 - F.col("brier") / F.col("climatology")).otherwise(0.0)
    return total.select(*group, "observations", "resolved", (F.col("resolved") / F.col("observations")).alias("coverage"), "correct", F.when(F.col("resolved") > 0, F.col("correct") / F.greatest("resolved", F.lit(1))).otherwise(0.0).alias("accuracy"), balanced.alias("balanced_accuracy"), "brier", "climatology", skill.alias("skill"), F.coalesce(gap, F.lit(0.0)).alias("calibration_error"))


def merit() -> Column:
    """Better is larger: skill, balanced accuracy, calibration error turned round, coverage; to 12 places, so
    that the order of a sum decides nothing."""
    names = ("skill", "balanced_accuracy", "calibration_error", "coverage")
    return F.struct(*[F.round(-F.col(n) if n == "calibration_error" else F.col(n), 12).alias(n) for n in names])


def walk_forward(rows: DataFrame, frames: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(validation cases, evaluation cases, settings) of ``candidates``; ``frames`` (SERIES, at) set the
    split, the candidates themselves if None.

    The distance limit of a series is the largest k-th distance (of the last neighbour, if fewer) that a
    validation query has to matured training rows. Power 2 is taken if its validation metrics are strictly
    better in the order skill, balanced accuracy, calibration error, coverage. Validation queries see matured
    training and validation rows, evaluation queries all matured rows.
    """
    rows = stored(rows, "rows")
    parted = stored(split(rows, frames if frames is not None else rows), "parted")
    ready = stored(scaled(parted), "candidates")
    dimensions = ready.groupBy(*SERIES).agg(F.max("effective").alias("dimensions"))
    plan = stored(settings(ready).join(dimensions, SERIES), "settings")
    every = stored(ready.join(plan, SERIES), "planned")
    validation, evaluation = (every.where(F.col("part") == p) for p in (VALIDATION, EVALUATION))
    most_k = plan.agg(F.max("k")).first()[0]
    if most_k is None:
        raise ValueError("no training rows")
    train = MetricIndex(every.where(F.col("part") == TRAIN))
    far, _ = train.search(validation, most_k, None, "matured")
    last = far.where("rank <= q_k").groupBy(*[F.col(f"q_{c}").alias(c) for c in SERIES], "q_at").agg(F.max("distance").alias("kth"))
    limits = last.where("kth < double('infinity')").groupBy(*SERIES).agg(F.max("kth").alias("most")).where("most > 0")
    plan = stored(plan.join(limits, SERIES), "limits")
    bounded = lambda q: q.join(plan.select(*SERIES, "most"), SERIES)

    index = MetricIndex(every)
    seen = stored(index.search(bounded(validation), most_k, F.col("most"), "matured")[0].where("rank <= q_k").select(*[f"q_{c}" for c in (*SERIES, "at")], "l_direction", "l_part", "distance"), "met")
    climate = stored(frequencies(validation.select(*SERIES, "at"), every.where(F.col("part") != EVALUATION)), "climate")
    by_power = {p: stored(judged(seen, bounded(validation), plan, p), "validation") for p in (1.0, 2.0)}
    with_climate = lambda c, k: c.join(k, [*SERIES, "at"])
    one, two = (metrics(with_climate(by_power[p], climate)).select(*SERIES, merit().alias(f"m{int(p)}")) for p in (1.0, 2.0))
    plan = stored(plan.join(one, SERIES, "left").join(two, SERIES, "left").withColumn("power", F.when(F.col("m2") > F.col("m1"), 2.0).otherwise(1.0)).drop("m1", "m2"), "powers")
    chosen = by_power[1.0].join(plan.where("power = 1").select(*SERIES), SERIES).unionByName(by_power[2.0].join(plan.where("power = 2").select(*SERIES), SERIES))

    met = stored(index.search(bounded(evaluation), most_k, F.col("most"), "matured")[0].where("rank <= q_k").select(*[f"q_{c}" for c in (*SERIES, "at")], "l_direction", "distance"), "met")
    found = [judged(met, bounded(evaluation), plan, p).join(plan.where(F.col("power") == p).select(*SERIES), SERIES) for p in (1.0, 2.0)]
    later = frequencies(evaluation.select(*SERIES, "at"), every)
    return with_climate(chosen, climate), with_climate(found[0].unionByName(found[1]), later), plan
