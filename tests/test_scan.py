"""The blocked scan against plain loops over a whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, scan, structure


def ema(x, p):
    out, now = [None] * len(x), None
    for i, v in enumerate(x):
        if i == p - 1:
            now = sum(x[:p]) / p
        elif i >= p:
            now = v * 2 / (p + 1) + now * (1 - 2 / (p + 1))
        out[i] = now
    return out


def wilder(x, first, p=14):
    out, now = [None] * len(x), None
    for i, v in enumerate(x):
        if i == first + p - 1:
            now = sum(x[first : i + 1]) / p
        elif i >= first + p:
            now = (now * (p - 1) + v) / p
        out[i] = now
    return out


def plain(h, l, c):  # noqa: E741
    """The indicators of one series, by their definitions."""
    n = len(c)
    e = {p: ema(c, p) for p in (12, 20, 26, 50)}
    line = [a - b if b is not None else None for a, b in zip(e[12], e[26], strict=True)]
    signal = [None] * n
    for i in range(34, n):
        signal[i] = sum(line[25:34]) / 9 if i == 34 else line[i] * 0.2 + signal[i - 1] * 0.8
    step = [0.0, *[b - a for a, b in zip(c, c[1:], strict=False)]]
    gain, loss = wilder([max(x, 0) for x in step], 1), wilder([max(-x, 0) for x in step], 1)
    rsi = [None if b is None else 100 - 100 / (1 + a / b) if b > 0 else 100.0 for a, b in zip(gain, loss, strict=True)]
    tr = [0.0, *[max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, n)]]
    atr = wilder(tr, 1)
    up, down = [0.0, *[h[i] - h[i - 1] for i in range(1, n)]], [0.0, *[l[i - 1] - l[i] for i in range(1, n)]]
    moves = [[max(a, 0.0) if a > b else 0.0 for a, b in zip(x, y, strict=True)] for x, y in ((up, down), (down, up))]
    dx, state = [0.0] * n, [0.0, 0.0]
    for i in range(14, n):
        dead = atr[i] == 0
        for k in (0, 1):
            if i == 14:
                state[k] = float("nan") if dead else 100 * (sum(moves[k][1:15]) / 14) / atr[i]
            else:
                state[k] = float("nan") if dead else (state[k] * 13 + 100 * moves[k][i] / atr[i]) / 14
        dx[i] = 100 * abs(state[0] - state[1]) / sum(state) if sum(state) > 0 else 0.0
    adx = [None if i < 27 else v for i, v in enumerate(wilder(dx, 14))]
    return dict(zip(indicators.INDICATORS, [e[12], e[20], e[26], e[50], line, signal, [None if a is None or b is None else a - b for a, b in zip(line, signal, strict=True)], rsi, atr, adx], strict=True))


@pytest.mark.parametrize("size", [1, 5, 14, 4096])
def test_indicators_in_blocks_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "BLOCK_ROWS", size)
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for name, n in (("a", 130), ("b", 34), ("c", 1), ("d", 61), ("flat", 70)):
        c = np.full(n, 5.0) if name == "flat" else 100 + rng.normal(size=n).cumsum()
        h, l = (c, c) if name == "flat" else (c + rng.random(n), c - rng.random(n))  # noqa: E741
        rows += [(name, "D1", int(i), float(h[i]), float(l[i]), float(c[i])) for i in range(n)]
        for i, values in enumerate(zip(*plain(h.tolist(), l.tolist(), c.tolist()).values(), strict=True)):
            want[name, i] = (c[i], *values)
    rng.shuffle(rows)
    bars = spark.createDataFrame([(str(r[0]), str(r[1]), int(r[2]), float(r[3]), float(r[4]), float(r[5])) for r in rows], "instrument_id string, timeframe string, close_time_ns long, high double, low double, close double")
    got = {(r.instrument_id, r.close_time_ns): tuple(r)[3:] for r in indicators.recurrences(bars).collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert [x is None for x in got[k]] == [x is None for x in values], k
        assert [x for x in got[k] if x is not None] == pytest.approx([x for x in values if x is not None], rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_memory_in_blocks_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "BLOCK_ROWS", size)
    rng = np.random.default_rng(1)
    values = {"a": [None, None, *rng.random(20).tolist(), None, 1.0], "b": [None] * 4, "c": [2.0]}
    rows = spark.createDataFrame([(k, "D1", i, v) for k, x in values.items() for i, v in enumerate(x)], "instrument_id string, timeframe string, timestamp_ns long, x double")
    got = {(r.instrument_id, r.timestamp_ns): (r.prior_memory, r.memory) for r in structure.exponential_memory(rows, "x", 5.0).collect()}
    keep = np.exp(-1 / 5)
    for k, x in values.items():
        z = None
        for i, v in enumerate(x):
            prior = z
            z = z if v is None else keep * (z or 0.0) + (1 - keep) * v
            assert all(a is b is None or a == pytest.approx(b) for a, b in zip(got[k, i], (prior, z), strict=True))


def test_one_long_series_is_spread_over_tasks(spark):
    rows = spark.range(60_000).select(F.lit("a").alias("instrument_id"), F.lit("D1").alias("timeframe"), F.col("id").alias("close_time_ns"), *[(F.sin(F.col("id") / 50.0) * 10 + 100 + d).alias(c) for c, d in (("high", 1.0), ("low", -1.0), ("close", 0.0))])
    cut = scan.blocks(rows, "close_time_ns", ["high", "low", "close"])
    assert sorted((r.first, r.n) for r in cut.select("first", F.size("at").alias("n")).collect()) == [(i, min(scan.BLOCK_ROWS, 60_000 - i)) for i in range(0, 60_000, scan.BLOCK_ROWS)]
    plan = indicators.recurrences(rows)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    c = [100 + 10 * np.sin(i / 50.0) for i in range(60_000)]
    last = indicators.recurrences(rows).where("close_time_ns = 59999").first()
    assert last.ema50 == pytest.approx(ema(c, 50)[-1], rel=1e-9) and last.atr14 == pytest.approx(wilder([0.0, *[2.0 + 0 * x for x in c[1:]]], 1)[-1], rel=1e-2)


def test_an_empty_table(spark):
    bars = spark.createDataFrame([], "instrument_id string, timeframe string, close_time_ns long, high double, low double, close double")
    assert indicators.recurrences(bars).count() == 0
