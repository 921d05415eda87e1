"""Order statistics by refined histograms against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection

SHARES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.75, "e": 1.0}


@pytest.mark.parametrize("limit", [1, 7, 65_536])
def test_quantiles_equal_sorting(spark, monkeypatch, limit):
    monkeypatch.setattr(selection, "LIMIT", limit)
    monkeypatch.setattr(selection, "CUTS", 5)
    rng = np.random.default_rng(0)
    groups = {"normal": rng.normal(size=300), "ties": rng.integers(0, 3, 200).astype(float), "one": np.array([4.0]), "same": np.full(90, -2.5), "wide": np.concatenate([rng.normal(size=50) * 1e-12, [1e12, -1e12]]), None: rng.random(40)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("none", None), ("ties", float("nan"))]
    got = {r.g: r for r in selection.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g].n == len(x) and [got[g][k] for k in SHARES] == pytest.approx(np.quantile(x, list(SHARES.values())).tolist(), rel=1e-12, abs=1e-300), g


def test_large_groups_keep_a_bounded_state(spark, monkeypatch):
    """Three groups of 100,000: what is sorted at the end is LIMIT rows at most for each range."""
    monkeypatch.setattr(selection, "LIMIT", 1000)
    rows = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    held, inside = [], selection._inside
    monkeypatch.setattr(selection, "_inside", lambda x, r, g: held.append(inside(x, r, g)) or held[-1])
    got = {r.g: r.m for r in selection.quantiles(rows, ["g"], "v", {"m": 0.5}).collect()}
    want = {r.g: r.m for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert got == pytest.approx(want)
    assert held[-1].groupBy("g", "low", "high").count().agg(F.max("count")).first()[0] <= 1000 and len(held) == 2


def test_an_empty_table(spark):
    assert selection.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", SHARES).count() == 0
