"""Canonical documents in JVM expressions against the Python form, and the checks of profiles."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import profiles as P


def test_numbers_and_texts_equal_the_python_form(spark):
    rng = np.random.default_rng(0)
    numbers = [0.0, -0.0, 1.0, -1.5, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 1.5e-7, 2.5e-300, 1.7976931348623157e308, 0.001, 1e7, 12345678.9, 0.1, 1 / 3, 2.0**53, 1e22, 100.0, 1234.5, -9.999e-5]
    numbers += (rng.normal(size=300) * 10.0 ** rng.integers(-25, 25, 300)).tolist() + rng.integers(-10**9, 10**9, 100).astype(float).tolist()
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r.c for r in rows.select(P.canonical(F.col("x"), rows.schema["x"].dataType).alias("c")).collect()]
    assert got == [canonical.number(x) for x in numbers]
    texts = ["", 'a"b\\c', "\\u000B", "\x00\x0b\x1f\n\t\r\b\f", "é日\U0001f600 /", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.c for r in rows.select(P.canonical(F.col("x"), rows.schema["x"].dataType).alias("c")).collect()] == [canonical.canonical(x) for x in texts]


def test_nested_documents_equal_the_python_form(spark):
    doc = Row(z=[Row(b=True, a=None), Row(b=False, a=1)], A="x", é=[1.5, None], a=2**60, list=[])
    schema = "z array<struct<b: boolean, a: int>>, A string, `é` array<double>, a long, list array<string>"
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = spark.createDataFrame([doc], schema)
        got = rows.select(P.digest(rows, rows.columns).alias("d")).first().d
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert got == canonical.digest({"z": [{"b": True, "a": None}, {"b": False, "a": 1}], "A": "x", "é": [1.5, None], "a": float(2**60), "list": []})


SCHEMA = "profile_id string, version string, engine_version string, instrument_id string, asset_class string, timeframe string, k int, least_support int, most double, power double, barrier_up double, barrier_down double, dimensions int, effective array<boolean>, samples long, last_ns long, untouched_test boolean, split_ns long"
SOUND = (f"crypto:x:BTC:D1:{P.VERSION}", P.VERSION, P.ENGINE, "crypto:x:BTC", "CRYPTO", "D1", 9, 3, 1.25, 2.0, 0.7, 0.7, 2, [True, False], 81, 50, False, 40)


def failed(spark, changed=None, after=None):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = P.signed(spark.createDataFrame([tuple((changed or {}).get(n, v) for n, v in zip(names, SOUND, strict=True))], SCHEMA))
    for n, v in (after or {}).items():
        rows = rows.withColumn(n, F.lit(v).cast(rows.schema[n].dataType))
    return {r["check"] for r in P.checks(rows, 100).where("NOT passed").collect()}


def test_sound_tampered_and_stale_profiles(spark):
    assert failed(spark) == set()
    assert failed(spark, after={"k": 10}) == {"HASH"} and failed(spark, after={"most": 1.5}) == {"HASH"} and failed(spark, after={P.HASH: None}) == {"HASH"}
    assert failed(spark, {"engine_version": "0.9"}) == {"ENGINE"}
    assert failed(spark, {"instrument_id": "crypto:x:ETH"}) == {"IDENTITY"} and failed(spark, {"asset_class": "STOCK"}) == {"ASSET_CLASS"}
    assert failed(spark, {"least_support": 10}) == {"SUPPORT"} and failed(spark, {"power": 0.0}) == {"POWER"} and failed(spark, {"most": None}) == {"DISTANCE"}
    assert failed(spark, {"barrier_down": 0.8}) == {"SYMMETRIC_BARRIER"} and failed(spark, {"effective": [False, False]}) == {"DIMENSIONS"} and failed(spark, {"samples": 0}) == {"SAMPLES"}
    assert failed(spark, {"untouched_test": True}) == {"PROSPECTIVE_TEST"} and failed(spark, {"untouched_test": True, "split_ns": 101}) == set()
    assert failed(spark, {"untouched_test": True, "split_ns": 101, "last_ns": 101}) == {"PROSPECTIVE_TEST"}
