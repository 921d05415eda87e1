"""Profiles as models: sizes of each series, refusals, save and load."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels
from tidemark.operators.model import ProfileEstimator, ProfileModel
from tidemark.session import shared_path

BARS = "instrument_id string, timeframe string, close_time_ns long, open double, high double, low double, close double"


def made(spark, sizes, seed=1):
    """Random walks of ``sizes`` bars, and frames of three ratios, one of them often null."""
    rng = random.Random(seed)
    bars, frames = [], []
    for name, n in sizes.items():
        price = 100.0
        for i in range(n):
            price *= math.exp(rng.gauss(0, 0.01))
            high, low = price * (1 + rng.random() * 0.01), price * (1 - rng.random() * 0.01)
            bars.append((name, "D1", i * 86_400, price, high, low, price))
            frames.append((name, "D1", i * 86_400, [rng.random(), rng.gauss(0, 1), None if rng.random() < 0.2 else rng.random()]))
    return spark.createDataFrame(bars, BARS), spark.createDataFrame(frames, "instrument_id string, timeframe string, timestamp_ns long, vector array<double>")


def test_sizes_of_each_series_equal_fixed_ones(spark):
    bars, _ = made(spark, {"a": 90, "b": 40})
    own = bars.withColumn("lookback", F.when(F.col("instrument_id") == "a", 9).otherwise(6)).withColumn("horizon", F.when(F.col("instrument_id") == "a", 7).otherwise(5))
    for name, lookback, horizon in (("a", 9, 7), ("b", 6, 5)):
        mine = own.where(F.col("instrument_id") == name)
        key = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert key(labels.with_volatility(own, "lookback").where(F.col("instrument_id") == name)) == key(labels.with_volatility(mine, lookback))
        assert key(labels.first_passage(own, "lookback", "horizon", 0.7, 0.7).where(F.col("instrument_id") == name)) == key(labels.first_passage(mine, lookback, horizon, 0.7, 0.7))
        early = F.col("close_time_ns") < 30 * 86_400
        assert key(labels.symmetric_barrier(own, "lookback", "horizon", train=early).where(F.col("instrument_id") == name)) == key(labels.symmetric_barrier(mine, lookback, horizon, 30))


@pytest.fixture(scope="module")
def fit(spark):
    bars, frames = made(spark, {"long": 150, "short": 12})
    flat = spark.createDataFrame([("flat", "D1", i * 86_400, 1.0, 1.0, 1.0, 1.0) for i in range(40)], BARS)
    still = flat.select("instrument_id", "timeframe", F.col("close_time_ns").alias("timestamp_ns"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("vector"))
    return bars, frames, ProfileEstimator(bars.unionByName(flat)).fit(frames.unionByName(still).withColumn("close", F.lit("extra")))


def test_fit_save_load_and_refusals(spark, fit):
    _, frames, fitted = fit
    frames = frames.where("instrument_id = 'long'")
    assert {r.instrument_id: r.reason for r in fitted.refused.collect()} == {"short": "FEW_BARS", "flat": "NO_BARRIER"}
    (row,) = fitted.settings.collect()
    assert (row.lookback, row.horizon, row.k, row.least_support) == (12, 8, math.isqrt(row.train), min(row.train.bit_length(), row.k))
    assert row.split_ns == (150 - 12) * 86_400 and row.test + row.validation + row.train == fitted.library.count() + row.test
    path = shared_path(spark, "model")
    fitted.save(path)
    again = ProfileModel.load(spark, path)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(again.transform(frames)) == key(fitted.transform(frames)) and again.transform(frames).count() == 150
    with pytest.raises(Exception, match="already exists"):
        fitted.save(path)
    with pytest.raises(ValueError, match="two frames"):
        again.transform(frames.unionByName(frames))


def test_later_outcomes_change_no_parameter(fit):
    bars, frames, fitted = fit
    other = bars.withColumns({c: F.when(F.col("close_time_ns") >= 138 * 86_400, F.col(c) * 1.5).otherwise(F.col(c)) for c in ("high", "low", "close")})
    one, two = fitted.settings.first(), ProfileEstimator(other).fit(frames).settings.first()
    for name in ("barrier", "split_ns", "dimensions"):
        assert one[name] == two[name]


def test_empty_tables_and_a_frame_without_a_bar(spark):
    bars, frames = made(spark, {"long": 20})
    empty = ProfileEstimator(bars.limit(0)).fit(frames.limit(0))
    assert empty.settings.count() == 0 and empty.transform(frames).count() == 0
    with pytest.raises(Exception, match="no bar closes"):
        ProfileEstimator(bars.where("close_time_ns > 0")).fit(frames)
