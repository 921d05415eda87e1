"""Small series with known answers, and checks against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical, catalogue
from tidemark.operators import align, calibrate, dynamics, indicators, labels, resample, samples, scoring, structure, validation
from tidemark.sources import bars as B
from tidemark.sources import records

DAY = 86_400 * B.NS
BARS = "instrument_id string, timeframe string, open_time_ns long, close_time_ns long, open double, high double, low double, close double, is_closed boolean, source string, volume double, quote_volume double, trade_count long"


def bars(spark, ohlc, name="x", timeframe="D1", first=4 * DAY, volume=1000.0):
    step = B.SECONDS[timeframe] * B.NS
    rows = [(name, timeframe, first + i * step, first + (i + 1) * step, *map(float, p), True, "test", volume, 10.0 if volume else None, 5 if volume else None) for i, p in enumerate(ohlc)]
    return spark.createDataFrame(rows, BARS)


RISING = [(100 + 0.5 * i + 0.5, 100 + 0.5 * i + 2, 100 + 0.5 * i, 100 + 0.5 * i + 1) for i in range(100)]
FALLING = [(200 - 0.5 * i - 0.5, 200 - 0.5 * i + 1, 200 - 0.5 * i - 2, 200 - 0.5 * i - 1) for i in range(100)]
RANGING = [(b, b + 0.8, b - 0.8, b + 0.5) for b in (100 + 0.5 * math.sin(i) for i in range(100))]


@pytest.mark.parametrize("ohlc,direction", [(RISING, "UP"), (FALLING, "DOWN"), (RANGING, "RANGE")])
def test_directions(spark, ohlc, direction):
    assert indicators.technical_direction(bars(spark, ohlc)).first().direction == direction


def test_overextension_reads_the_other_way_and_short_series_say_so(spark):
    up = [(100 + 2 * i, 100 + 2 * i + 2, 100 + 2 * i - 1, 100 + 2 * i + 1) for i in range(100)]
    down = [(500 - 2 * i, 500 - 2 * i + 1, 500 - 2 * i - 2, 500 - 2 * i - 1) for i in range(100)]
    assert indicators.technical_direction(bars(spark, up)).first().counter_reading == "DOWN"
    assert indicators.technical_direction(bars(spark, down)).first().counter_reading == "UP"
    short = bars(spark, RISING[:10])
    assert indicators.technical_direction(short).count() == 0
    assert validation.series_status(short).first().status == "INSUFFICIENT_BARS"


def test_flat_series_have_defined_indicators(spark):
    last = indicators.technical_direction(bars(spark, [(5, 5, 5, 5)] * 80)).first()
    assert last.rsi14 == 100 and last.adx14 == 0 and last.ema_separation_atr is None


def test_no_indicator_looks_ahead(spark):
    whole = {r.close_time_ns: r for r in indicators.indicator_table(bars(spark, RANGING)).collect()}
    for r in indicators.indicator_table(bars(spark, RANGING[:70])).collect():
        assert r == whole[r.close_time_ns]


def test_observations_do_not_change_with_scale(spark):
    ohlc = [(100 + i, 103 + i, 98 + i, 101 + i) for i in range(20)]
    one = validation.observations(bars(spark, ohlc)).orderBy("timestamp_ns").collect()
    ten = validation.observations(bars(spark, [tuple(10 * v for v in p) for p in ohlc])).orderBy("timestamp_ns").collect()
    assert len(one) == 19 and math.isnan(one[0].expected) and one[1].expected == one[0].omega
    assert np.allclose([r.omega for r in one], [r.omega for r in ten])


def test_intraday_counts_and_missing_volume(spark):
    m1 = bars(spark, [(100 + 0.01 * i, 100 + 0.01 * i + 0.02, 100 + 0.01 * i - 0.02, 100 + 0.01 * i + 0.01) for i in range(123)], timeframe="M1", volume=100.0)
    m5 = resample.resample(m1, "M1", "M5")
    assert m5.count() == 24 and m5.agg(F.min("volume"), F.min("trade_count")).first()[:] == (500.0, 25)
    assert resample.resample(m1, "M1", "H1").count() == 2
    gaps = m1.withColumn("volume", F.when(F.col("open_time_ns") % (7 * 60 * B.NS) != 0, F.col("volume")))
    assert resample.resample(gaps, "M1", "M5").where("volume IS NULL").count() > 0
    with pytest.raises(KeyError):
        resample.resample(m1, "M1", "W1")
    with pytest.raises(ValueError):
        resample.closed_weekly_once(m1, "M1")


def test_a_week_comes_out_once_it_has_ended(spark):
    fortnight = bars(spark, RISING[:14], first=4 * DAY)  # from a Monday
    assert resample.weekly(fortnight).count() == 2
    assert resample.weekly(bars(spark, RISING[:12], first=4 * DAY)).count() == 1
    w = resample.weekly(fortnight).orderBy("open_time_ns").first()
    assert (w.open, w.high, w.low, w.close, w.volume) == (RISING[0][0], RISING[6][1], RISING[0][2], RISING[6][3], 7000.0)
    once = resample.closed_weekly_once(fortnight, "D1")
    assert resample.closed_weekly_once(once, "W1").count() == 2


@pytest.mark.parametrize("future,want", [([(100, 105, 95, 100)] * 2, ("RANGE", 2)), ([(100, 111, 95, 100), (100, 100, 100, 100)], ("UP", 1)), ([(100, 111, 89, 100), (100, 100, 100, 100)], ("RANGE", 1)), ([(100, 101, 99, 100)], ("CENSORED", None))])
def test_first_passage(spark, future, want):
    ohlc = [(100, 100, 100, 100), (100, 105, 95, 100), *future]  # volatility 0.1 at the second bar
    got = labels.first_passage(bars(spark, ohlc), 2, 2, 1.0, 1.0).orderBy("close_time_ns").first()
    assert abs(got.volatility - 0.1) < 1e-12 and (got.direction, got.first_passage_bars) == want


def test_violations_come_in_order(spark):
    row = ("x", "D1", 0, 1, 10.0, 12.0, 9.0, 11.0, True, "s", 1.0, None, None)
    cases = {None: {}, "MISSING_IDENTITY": {0: " "}, "INVALID_TIME": {3: 0}, "NON_FINITE": {5: float("nan")}, "MALFORMED_OHLC": {5: 8.0}, "NEGATIVE_VOLUME": {10: -1.0}}
    for want, change in cases.items():
        r = spark.createDataFrame([tuple(change.get(i, v) for i, v in enumerate(row))], BARS)
        assert r.select(validation.bar_violation().alias("v")).first().v == want


def test_greedy_pairs_shift_when_a_row_is_missing(spark):
    a = spark.createDataFrame([("k", i * DAY) for i in range(6)], "k string, timestamp_ns long")
    b = spark.createDataFrame([("k", i * DAY) for i in range(6) if i != 2], "k string, timestamp_ns long")
    got = [(r.left_ns // DAY, r.right_ns // DAY) for r in align.greedy_band(a, b, ["k"], DAY).orderBy("left_ns").collect()]
    assert got == [(0, 0), (1, 1), (2, 3), (3, 4), (4, 5)]
    assert align.exact_pairs(a, b, ["k"]).count() == 5


def test_joins_refuse_what_is_missing_or_doubled(spark):
    x = bars(spark, RISING[:5])
    frames = x.select("instrument_id", "timeframe", F.col("close_time_ns").alias("timestamp_ns"))
    assert align.frames_with_bars(frames, x).count() == 5
    for bad in (x.limit(3), x.union(x)):
        with pytest.raises(Exception, match="bar"):
            align.frames_with_bars(frames, bad).collect()
    with pytest.raises(Exception, match="twice"):
        align.union_pool(frames, frames, ["timestamp_ns"]).collect()
    with pytest.raises(Exception, match="overlaps"):
        align.append_later(x, x).collect()


def kernel(spark, n=80):
    rows = []
    for i in range(n):
        d = 0.1 + (i % 9) * 0.03
        rows.append(("x", "D1", i * DAY, d, d, 0.2 * d, d * i, 1.0, 2.0, 2 - 0.2 * d, 0.01 * d))
    return spark.createDataFrame(rows, "instrument_id string, timeframe string, timestamp_ns long, delta double, delta_tilde double, xi double, A double, lambda double, theta double, M double, G double")


def test_the_stack_is_causal_and_repeats_itself(spark):
    whole = structure.stack(kernel(spark)).orderBy("timestamp_ns").collect()
    part = structure.stack(kernel(spark, 60)).orderBy("timestamp_ns").collect()
    assert part == whole[:60] and len(whole[0]["values"]) == 14
    memory = structure.exponential_memory(kernel(spark), "delta").orderBy("timestamp_ns").collect()
    assert memory[0].prior_memory is None and all(b.prior_memory == a.memory for a, b in zip(memory, memory[1:], strict=False))


def test_contrast_describes_what_is_there(spark):
    head = spark.createDataFrame([("a", "D1", "UP"), ("b", "D1", "DOWN"), ("c", "D1", "UP")], "instrument_id string, timeframe string, direction string")
    seen = spark.createDataFrame([("a", "D1", 0.5, 0.2, None), ("b", "D1", None, None, None)], "instrument_id string, timeframe string, coherence double, recurrence double, prior_memory double")
    got = {r.instrument_id: (r.state, [e.quality for e in r.evidence]) for r in indicators.contrast(head, seen).collect()}
    assert got == {"a": ("NEUTRAL", ["coherent", "non_recurrent"]), "b": ("UNAVAILABLE", []), "c": ("UNAVAILABLE", [])}


def test_linear_algebra_pieces():
    rng = np.random.default_rng(0)
    x = rng.random((40, 6))
    c, r, n = structure.ridge_coherence(x, 39)
    assert 0 <= c <= 1 and r > 0 and n == 32 and math.isnan(structure.ridge_coherence(x, 5)[0])
    line = np.outer(np.arange(10), np.ones(6)) ** 2
    assert structure.variation_capacity(line) < 1e-6 and 0.5 < structure.variation_capacity(x) <= 1
    assert math.isnan(structure.variation_capacity(x[:3])) and structure.recurrence_intensity(np.zeros((8, 6))) == 0


def test_scores_of_known_cases(spark):
    rows = [("UP", "UP", 10_000, 0, 0), ("UP", "DOWN", 10_000, 0, 0), ("DOWN", "DOWN", 0, 0, 10_000)]
    cases = spark.createDataFrame(rows, "predicted string, actual string, up_bp int, range_bp int, down_bp int")
    library = spark.createDataFrame([("UP",), ("DOWN",)], "direction string")
    s = scoring.summary(cases, library).first()
    assert (s.cases, s.correct, s.accuracy_bp, s.balanced_accuracy_bp) == (3, 2, 6667, 7500) and abs(s.brier - 2 / 3) < 1e-12 and abs(s.climatology - 0.5) < 1e-12
    assert {r.direction: r.precision_bp for r in scoring.reliability(cases).collect()} == {"UP": 5000, "DOWN": 10_000}
    assert scoring.confusion(cases).agg(F.sum("cases"), F.count("*")).first()[:] == (3, 9)
    empty = scoring.summary(cases.limit(0), library).first()
    assert empty.cases == 0 and empty.brier == 0


def test_wilson_and_shares(spark):
    one = spark.range(1)
    assert one.select(scoring.wilson_lower_bp(F.lit(10), F.lit(10)).alias("x")).first().x == 7225
    assert list(one.select(samples.basis_points(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("x")).first().x) == [3334, 3333, 3333]
    assert list(one.select(samples.basis_points(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("x")).first().x) == [0, 10_000, 0]


def test_sizes_follow_from_counts():
    p = calibrate.parameters(800, 511)
    assert (p.lookback, p.horizon, p.held_out) == (28, 10, 22) and (511).bit_length() == 9 and (512).bit_length() == 10


def test_relations(spark):
    one = spark.range(1)
    word = lambda s, *w: one.select(dynamics.relation(F.lit(s), [F.lit(x) for x in w]).alias("r")).first().r
    assert word(0.9, "ALIGNED", "ALIGNED", "ALIGNED", "UNAVAILABLE") == "STRONG_ALIGNMENT"
    assert word(0.45, "ALIGNED", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE") == "WEAK_ALIGNMENT"
    assert word(0.9, "DIVERGING", "DIVERGING", "UNAVAILABLE", "UNAVAILABLE") == "DIVERGENCE"
    assert word(0.1, "ALIGNED", "DIVERGING", "UNAVAILABLE", "UNAVAILABLE") == "UNAVAILABLE"


def test_csv_headers_dates_and_faults(spark, tmp_path):
    def read(text, **more):
        (tmp_path / "a.csv").write_text(text)
        return records.read_daily_csv(spark, str(tmp_path / "a.csv"), "x", "csv", **more).collect()

    got = read(" Time ,CLOSE,Open,high,LOW,vol\n2024-01-02,2,1,3,0.5,0\n03/01/2024,2,1,3,0.5,7\n2024/01/04,2,1,3,0.5,\n")
    assert [r.volume for r in got] == [None, 7.0, None] and [r.open_time_ns - got[0].open_time_ns for r in got] == [0, DAY, 2 * DAY]
    for second in ("2024-01-02", "2023-12-31"):
        with pytest.raises(Exception, match="repeated or go back"):
            read(f"date,open,high,low,close\n2024-01-02,1,2,0,1\n{second},1,2,0,1\n")
    with pytest.raises(Exception, match="malformed"):
        read("date,open,high,low,close\n2024-01-02,1,0,2,1\n")
    assert len(read("date,open,high,low,close\n2024-01-02,1,0,2,1\n2024-01-03,1,2,0,1\n", drop_malformed=True)) == 1
    with pytest.raises(ValueError, match="close"):
        read("date,open,high,low\n2024-01-02,1,2,0\n")
    with pytest.raises(Exception, match="not a finite"):
        read("date,open,high,low,close\n2024-01-02,x,2,0,1\n")
    with pytest.raises(Exception, match="no known format"):
        read("date,open,high,low,close\n2.1.2024,1,2,0,1\n")


def test_replies(spark):
    k = spark.createDataFrame([("x", '[[1000,"1","3","0.5","2","5",1999,"9",4],[2000,1,3,0.5,2,5,2999,9,4]]')], "instrument_id string, reply string")
    (b,) = records.klines(k, F.lit(2500), "M1", "s").collect()
    assert (b.open_time_ns, b.close_time_ns, b.close, b.trade_count) == (1_000_000_000, 1_999_000_000, 2.0, 4)
    a = spark.createDataFrame([("x", '{"status":"OK","results":[{"t":86400000,"o":1,"h":3,"l":0.5,"c":2}]}')], "instrument_id string, reply string")
    (b,) = records.aggregates(a, "s").collect()
    assert b.volume is None and b.close_time_ns == 2 * DAY - 1
    with pytest.raises(Exception, match="reply status"):
        records.aggregates(a.withColumn("reply", F.lit('{"status":"ERROR"}')), "s").collect()
    c = spark.createDataFrame([("g", "A", 5), ("g", "B", 35), ("g", "C", 70), ("h", "A", 5), ("h", "D", -3)], "g string, ticker string, days int")
    assert {r.g: r.ticker for r in records.nearest_contract(c, ["g"]).collect()} == {"g": "B", "h": "A"}


def test_files_and_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"abc")
    import hashlib

    assert records.file_digests(spark, str(tmp_path / "f.csv")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "k.csv").write_text("timestamp_ns,omega,expected,u_lambda,sigma_op\n1,0.5,0.4,,\n2,0.5,0.4,1.5,true\n")
    rows = records.read_kernel_csv(spark, str(tmp_path / "k.csv")).collect()
    assert [(r.u_lambda, r.sigma_op) for r in rows] == [(None, None), (1.5, True)]
    records.write_documents(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "log"), "append")
    records.write_documents(spark.createDataFrame([(2,)], "a int"), str(tmp_path / "log"), "append")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    asked = spark.createDataFrame([("AUTO", False, True), ("AUTO", True, True), ("AUTO", None, None), ("SUPPLIED_CORPUS", True, True)], "r string, l boolean, c boolean")
    assert [tuple(r.s) for r in asked.select(records.chosen_source(F.col("r"), F.col("l"), F.col("c")).alias("s")).collect()] == [("CORPUS", "STALE_DATA"), ("LIVE", "OK"), ("NONE", "UNAVAILABLE"), ("CORPUS", "STALE_DATA")]
    found = spark.createDataFrame([("f", 3, "a", "b", "s", 1)], "file string, rows int, first_day string, last_day string, sha256 string, malformed int")
    want = spark.createDataFrame([("f", 3, "a", "b", "s"), ("g", 1, "a", "b", "s")], "file string, rows int, first_day string, last_day string, sha256 string")
    assert {r.file: r.status for r in records.audit_status(found, want).collect()} == {"f": "ACCEPTED_WITH_EXCLUSIONS", "g": "REJECTED"}


def test_names_and_requests(spark):
    names = spark.createDataFrame([("btc",), ("B T C",), ("same",), ("nope",)], "name string")
    entries = {"a": ["BTC"], "b": ["same"], "c": ["SAME"]}
    got = {r.name: (r.status, r.instrument_ids) for r in catalogue.resolve(names, catalogue.instruments(spark, entries)).collect()}
    assert got == {"btc": ("FOUND", "a"), "B T C": ("FOUND", "a"), "same": ("AMBIGUOUS", "b,c"), "nope": ("UNSUPPORTED", "")}
    asked = spark.createDataFrame([(["D1"], [], "HISTORICAL"), (["D1", "D1"], [], "HISTORICAL"), (["M1"], [], "HISTORICAL"), (None, ["k"], "HISTORICAL"), (["W1"], [], "LIVE_PREVIEW")], "t array<string>, o array<string>, m string")
    assert [r[0] for r in asked.select(validation.request_problems(F.col("t"), F.col("o"), F.col("m"))).collect()] == [None, "DUPLICATE_TIMEFRAME", "UNSUPPORTED_TIMEFRAME", "OVERRIDES_NOT_ALLOWED", "PREVIEW_NOT_ALLOWED"]


def test_weeks_are_not_multiples_of_the_epoch():
    with pytest.raises(ValueError, match="weekly"):
        B.period("W1")


def test_canonical_json():
    numbers = {0.0: "0", -0.0: "0", 1.0: "1", 1e21: "1e+21", 1e-7: "1e-7", 123456.789: "123456.789", 1e20: "100000000000000000000", 0.000001: "0.000001", 5e-324: "5e-324", -1.5: "-1.5", 333333333.33333329: "333333333.3333333"}
    for x, want in numbers.items():
        assert canonical.number(x) == want
    assert canonical.canonical({"b": [1, None, True], "a": "é\n", "€": 1, "😀": 2}) == '{"a":"é\\n","b":[1,null,true],"€":1,"😀":2}'
    assert canonical.digest({}) == "sha256:44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    with pytest.raises(ValueError):
        canonical.number(math.nan)
