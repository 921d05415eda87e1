"""Fitting a neighbour model: derived parameters, temporal split, power and gates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples as S
from . import scoring


@dataclass(frozen=True)
class Parameters:
    lookback: int
    horizon: int
    held_out: int
    k: int
    least_support: int


def parameters(bars: int, frames: int) -> Parameters:
    """All sizes follow from the numbers of bars and frames; the logarithm is a bit length."""
    held = math.isqrt(frames)
    train = max(1, frames - 2 * held)
    k = math.isqrt(train)
    return Parameters(max(2, math.isqrt(bars)), max(2, bars.bit_length()), held, k, min(train.bit_length(), k))


def temporal_split(rows: DataFrame, held: int, order: str = "sample_id") -> DataFrame:
    """part: the last ``held`` rows are TEST, those before VALIDATION, the rest TRAIN.

    The edges are two order statistics, so rows are not numbered through one task.
    """
    edges = [r[order] for r in rows.select(order).orderBy(F.desc(order)).limit(2 * held).collect()]  # 2 * held numbers
    if len(edges) < 2 * held or not held:
        raise ValueError("too few rows for the split")
    test, validation = edges[held - 1], edges[2 * held - 1]
    return rows.withColumn("part", F.when(F.col(order) >= test, "TEST").when(F.col(order) >= validation, "VALIDATION").otherwise("TRAIN"))


def fit(samples: DataFrame, bars: int | None = None) -> dict:
    """A model from samples (sample_id, vector, direction, first_passage_bars) in order of sample_id.

    Normalisation comes from training rows alone. Power 2 is taken only if it is right strictly more
    often on validation rows. The edge gate is the upper median of the edges of right validation
    votes. The test score uses training and validation rows as its library.
    """
    n = samples.count()
    p = parameters(bars or n, n)
    split = temporal_split(samples, p.held_out)
    norm = S.fit_normalization(split.where("part = 'TRAIN'"))
    scaled = S.normalize(split, norm)
    train, validation, test = (scaled.where(F.col("part") == x) for x in ("TRAIN", "VALIDATION", "TEST"))
    far = S.kth_distance(validation, train, p.k).agg(F.percentile("kth_distance", F.lit(0.5)).alias("x")).first().x

    def cases(queries: DataFrame, library: DataFrame, power: float) -> DataFrame:
        votes = S.vote(S.neighbours(queries, library, p.k, far), p.least_support, power)
        return votes.join(queries.select(F.col("sample_id").alias("query_id"), F.col("direction").alias("actual")), "query_id").withColumnRenamed("winner", "predicted")

    by_power = {w: cases(validation, train, w) for w in (1.0, 2.0)}
    right = {w: c.where("predicted = actual").select("edge_bp") for w, c in by_power.items()}
    power = 2.0 if right[2.0].count() > right[1.0].count() else 1.0
    edges = sorted(r.edge_bp for r in right[power].collect())  # one number for each validation row
    library = train.unionByName(validation)
    final = cases(test, library, power)
    score = scoring.summary(final, library).first()
    trust = {r.direction: r.precision_bp for r in scoring.reliability(by_power[power]).collect()}  # three rows
    return {"parameters": p, "normalization": norm, "library": library, "max_distance": far, "power": power, "edge_bp": edges[len(edges) // 2] if edges else 10_000, "reliability_bp": trust, "score": score.asDict(), "test_cases": final}
