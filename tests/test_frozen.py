"""Registered fits: refused if changed, never refitted, scored once."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import frozen, residuals

SCHEMA = "instrument_id string, timeframe string, at long, actual string, p_up double, p_range double, p_down double, x double"


def cases(spark, first, last):
    rows = [("a", "D1", i, "UP" if i % 3 else "DOWN", 0.5, 0.3, 0.2, None if i == 33 else float(i % 7) if i < 30 else float(i)) for i in range(first, last)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def fits(spark, tmp_path):
    early = cases(spark, 0, 30)
    frozen.register(residuals.fit(early, "x", frozen.SERIES), "x", early.groupBy(*frozen.SERIES).agg(F.max("at").alias("boundary_ns")), f"{tmp_path}/fits")
    return f"{tmp_path}/fits"


def test_a_changed_fit_is_refused_and_none_is_overwritten(spark, fits, tmp_path):
    assert frozen.registered(spark, fits).count() == 1
    row = spark.read.parquet(fits).first()
    body = json.loads(row.document) | {"slope_up": 0.5}
    spark.read.parquet(fits).withColumn("document", F.lit(json.dumps(body))).write.parquet(f"{tmp_path}/changed")
    moved = spark.read.parquet(fits).withColumn("boundary_ns", F.col("boundary_ns") - 5)
    moved.write.parquet(f"{tmp_path}/moved")
    for path in ("changed", "moved"):
        with pytest.raises(ValueError, match="was changed"):
            frozen.registered(spark, f"{tmp_path}/{path}")
    with pytest.raises(Exception, match="exist"):
        frozen.register(residuals.fit(cases(spark, 0, 30), "x", frozen.SERIES), "x", cases(spark, 0, 30).groupBy(*frozen.SERIES).agg(F.max("at").alias("boundary_ns")), fits)


def test_only_later_cases_are_scored_and_a_rerun_adds_nothing(spark, fits, tmp_path):
    fit, out, source = frozen.registered(spark, fits), f"{tmp_path}/scores", f"{tmp_path}/cases"
    stream = lambda: frozen.score_stream(spark.readStream.schema(SCHEMA).parquet(source), fit, "x", out, f"{tmp_path}/progress").awaitTermination()
    read = lambda: sorted((r.at, r.support) for r in spark.read.parquet(out).collect())
    cases(spark, 20, 35).write.parquet(source)
    stream()
    assert read() == [(30, "ABOVE"), (31, "ABOVE"), (32, "ABOVE"), (33, "MISSING"), (34, "ABOVE")]
    stream()
    assert len(read()) == 5
    cases(spark, 32, 38).union(cases(spark, 36, 38)).write.mode("append").parquet(source)
    stream()
    assert [at for at, _ in read()] == list(range(30, 38))
    whole = {r.at: r for r in frozen.score(cases(spark, 0, 38), fit, "x").collect()}
    assert {r.at: (r.brier, r.corrected_brier) for r in spark.read.parquet(out).collect()} == {at: (r.brier, r.corrected_brier) for at, r in whole.items()}
    assert whole[33].brier == whole[33].corrected_brier
