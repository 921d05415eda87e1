"""Walk-forward scoring, nested variants and residual corrections against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import residuals, walk

NAMES = ("UP", "RANGE", "DOWN")
SERIES = "instrument_id string, timeframe string"


def made(n=150, seed=0, dims=3):
    """(at, known_at, vector, direction): clusters that tell something about the class."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = int(rng.integers(0, 3))
        v = [float(x) for x in rng.normal(size=dims) + (c if rng.random() < 0.6 else 0)]
        if i % 11 == 0:
            v[1] = None
        rows.append((i * 10, (i + int(rng.integers(1, 6))) * 10, v, NAMES[c]))
    return rows


def median(x):
    return float(np.median(x)) if len(x) else 0.0


def basis_points(mass):
    total = sum(mass)
    if not total > 0:
        return [0, 10_000, 0]
    exact = [m / total * 10_000 for m in mass]
    whole = [math.floor(x) for x in exact]
    for i in sorted(range(3), key=lambda i: (math.floor(exact[i]) - exact[i], i))[: 10_000 - sum(whole)]:
        whole[i] += 1
    return whole


def plain(rows):
    """(power, distance limit, {at: (predicted, basis points, class counts, library)}) of one series."""
    n = len(rows)
    held = math.isqrt(n)
    part = ["T"] * (n - 2 * held) + ["V"] * held + ["E"] * held
    train = [r for r, p in zip(rows, part, strict=True) if p == "T"]
    spec = []
    for d in range(len(rows[0][2])):
        x = [r[2][d] for r in train if r[2][d] is not None]
        m = median(x)
        mad, wide = median([abs(v - m) for v in x]), (max(x) - min(x)) if x else 0.0
        spec.append((m, mad if mad > 0 else wide / 2 if wide > 0 else 1.0, wide > 0))
    scaled = [([0.0 if v is None else (v - m) / s for v, (m, s, _) in zip(r[2], spec, strict=True)], tuple(v is not None and e for v, (_, _, e) in zip(r[2], spec, strict=True))) for r in rows]
    k = max(math.isqrt(len(train)), 1)
    least = min(max(len(train).bit_length() - 1, 1), k)

    def near(q, pool, most):
        found = []
        for i in pool:
            if rows[i][0] < rows[q][0] and rows[i][1] < rows[q][0] and scaled[i][1] == scaled[q][1]:
                on = np.array(scaled[q][1])
                d = math.sqrt(((np.array(scaled[i][0]) - np.array(scaled[q][0]))[on] ** 2).sum() / on.sum())
                if d <= most:
                    found.append((d, rows[i][0], i))
        return sorted(found)[:k]

    of = lambda p: [i for i in range(n) if part[i] == p]
    kth = [found[-1][0] for q in of("V") if (found := near(q, of("T"), math.inf))]
    most = max(kth)

    def score(queries, power):
        out = {}
        for q in queries:
            met = near(q, range(n), most)
            known = [rows[i][3] for i in range(n) if rows[i][0] < rows[q][0] and rows[i][1] < rows[q][0]]
            counts = [known.count(c) for c in NAMES]
            if len(met) < least:
                out[rows[q][0]] = ("UNRESOLVED", None, counts, rows[q][3])
                continue
            mass = [sum(1 / max(d, 2.0**-26) ** power for d, _, i in met if rows[i][3] == c) for c in NAMES]
            bp = basis_points(mass)
            out[rows[q][0]] = (NAMES[max(range(3), key=lambda i: (bp[i], -i))], bp, counts, rows[q][3])
        return out

    def merit(cases):
        there = [c for c in cases.values() if c[1]]
        brier = np.mean([sum((b / 10_000 - (a == n)) ** 2 for b, n in zip(bp, NAMES, strict=True)) for _, bp, _, a in there])
        usual = np.mean([sum((x / max(sum(c), 1) - (a == n)) ** 2 for x, n in zip(c, NAMES, strict=True)) for _, _, c, a in there])
        recalls = []
        for name in NAMES:
            mine = [p for p, _, _, a in there if a == name]
            if mine:
                recalls.append((mine.count(name) * 10_000 + len(mine) // 2) // len(mine))
        gap = np.mean([abs(np.mean([bp[i] / 10_000 for _, bp, _, _ in there]) - np.mean([a == n for _, _, _, a in there])) for i, n in enumerate(NAMES)])
        return (1 - brier / usual if usual > 0 else 0.0, sum(recalls) // len(recalls) / 10_000, -gap, len(there) / len(cases))

    one, two = score(of("V"), 1.0), score(of("V"), 2.0)
    power = 2.0 if merit(two) > merit(one) else 1.0
    found = score(of("E"), power)
    return power, most, found, merit(found)


def frame(spark, series):
    rows = [(name, "D1", *r) for name, x in series.items() for r in x]
    return spark.createDataFrame(rows, f"{SERIES}, at long, known_at long, vector array<double>, direction string")


def test_walk_forward_equals_a_plain_loop(spark):
    series = {"a": made(150, 1), "b": made(90, 2), "c": made(120, 3)}
    _, cases, plan = walk.walk_forward(frame(spark, series))
    settings = {r.instrument_id: r for r in plan.collect()}
    got = {(r.instrument_id, r.at): r for r in cases.collect()}
    scores = {r.instrument_id: r for r in walk.metrics(cases).collect()}
    for name, rows in series.items():
        power, most, want, merit = plain(rows)
        assert settings[name].power == power and settings[name].most == pytest.approx(most)
        mine = {at: r for (n, at), r in got.items() if n == name}
        assert mine.keys() == want.keys()
        for at, (predicted, bp, counts, actual) in want.items():
            r = mine[at]
            assert (r.predicted, r.actual, [r.up, r.range, r.down]) == (predicted, actual, counts)
            assert [r.up_bp, r.range_bp, r.down_bp] == (bp or [None] * 3)
        s = scores[name]
        assert (s.skill, s.balanced_accuracy, -s.calibration_error, s.coverage) == pytest.approx(merit)


def test_outcomes_known_at_the_query_do_not_count(spark):
    rows = spark.createDataFrame([("a", "D1", 1, 5, "UP"), ("a", "D1", 2, 3, "DOWN"), ("a", "D1", 5, 6, "RANGE")], f"{SERIES}, at long, known_at long, direction string")
    asked = spark.createDataFrame([("a", "D1", t) for t in (1, 3, 4, 5, 6, 7)], f"{SERIES}, at long")
    got = {r.at: (r.up, r.range, r.down) for r in walk.frequencies(asked, rows).collect()}
    assert got == {1: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 1), 5: (0, 0, 1), 6: (1, 0, 1), 7: (1, 1, 1)}


def test_residual_corrections_equal_numpy(spark):
    rng = np.random.default_rng(4)
    parts = {}
    for part in ("validation", "evaluation"):
        p = rng.dirichlet([2, 2, 2], 80)
        parts[part] = [(str(i % 2), *map(float, q), NAMES[int(rng.integers(0, 3))], float(x), float(y) if i % 9 else None) for i, (q, x, y) in enumerate(zip(p, rng.normal(size=80) * (2 if part == "evaluation" else 1), rng.normal(size=80), strict=True))]
    frames = {k: spark.createDataFrame(v, "g string, p_up double, p_range double, p_down double, actual string, x double, y double") for k, v in parts.items()}
    got = {r.g: r for r in residuals.sequential(frames["validation"], frames["evaluation"], "x", "y", ["g"]).collect()}

    def fit(p, y, z):
        e = y - p
        z0 = (z - np.nanmean(z)) / np.nanstd(z)
        on = ~np.isnan(z0)
        slope = (z0[on, None] * (e[on] - e[on].mean(0))).sum(0) / (z0[on] ** 2).sum()
        return np.nanmean(z), np.nanstd(z), z0[on].min(), z0[on].max(), slope

    def move(p, z, f):
        z0 = np.clip((z - f[0]) / f[1], f[2], f[3])
        q = np.maximum(p + z0[:, None] * f[4], 0)
        q = np.where(q.sum(1, keepdims=True) > 0, q / np.maximum(q.sum(1, keepdims=True), 1e-300), 1 / 3)
        return np.where(np.isnan(z)[:, None], p, q)

    for g in "01":
        v, e = ([r for r in parts[k] if r[0] == g] for k in ("validation", "evaluation"))
        arrays = lambda rows: (np.array([r[1:4] for r in rows]), np.array([[r[4] == n for n in NAMES] for r in rows], float), np.array([r[5] for r in rows]), np.array([np.nan if r[6] is None else r[6] for r in rows]))
        (p, y, x, w), (pe, ye, xe, we) = arrays(v), arrays(e)
        one, two = fit(p, y, x), fit(p, y, w)
        after = fit(move(p, x, one), y, w)
        want = [((q - ye) ** 2).sum(1).mean() for q in (pe, move(pe, xe, one), move(pe, we, two), move(move(pe, xe, one), we, after))]
        assert [got[g].brier, got[g].brier_first, got[g].brier_second, got[g].brier_both] == pytest.approx(want)


def test_a_feature_that_does_not_vary_has_no_fit(spark):
    rows = spark.createDataFrame([("g", 0.2, 0.3, 0.5, "UP", 1.0)] * 5, "g string, p_up double, p_range double, p_down double, actual string, x double")
    assert residuals.fit(rows, "x", ["g"]).count() == 0


def test_empty_candidates_are_an_error(spark):
    with pytest.raises(ValueError):
        walk.walk_forward(frame(spark, {}))
    assert walk.metrics(frame(spark, {}).select("instrument_id", "timeframe", F.lit("UP").alias("actual"), F.lit("UP").alias("predicted"), *[F.lit(0).alias(c) for c in ("up_bp", "range_bp", "down_bp", "up", "range", "down", "library")])).count() == 0
