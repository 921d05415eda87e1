"""The observer against its definition, and on a stream; greedy pairs by stretches against one pass."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.operators import structure as T
from tidemark.session import shared_path
from tidemark.streaming import states

ROW = "instrument_id string, timeframe string, timestamp_ns long, " + ", ".join(f"{a} double" for a in T.AXES)


@pytest.fixture(scope="module")
def paths(spark):
    """Series that wander, circle and stand still in turn."""
    rng, rows = random.Random(3), []
    for name in ("a", "b", "c"):
        x = [0.5] * 6
        for t in range(120):
            if t % 60 < 30:
                x = [min(1.0, max(0.0, v + rng.gauss(0, 0.15))) for v in x]
            elif t % 60 < 50:
                x = [0.5 + 0.4 * math.sin(t * (1 + i % 2) * 0.7 + i) for i in range(6)]
            rows.append((name, "D1", t, *x))
    return T.paths(spark.createDataFrame(rows, ROW))


def defined(rows):
    """(transport, state, coherence, recurrence, contraction, deficit so far) by loops over the whole series."""
    x = [np.array([getattr(r, a) for a in T.AXES]) for r in rows]
    far = lambda a, b: math.sqrt(sum((u - v) ** 2 for u, v in zip(a, b)) / 6)
    middle = lambda v: sorted(v)[len(v) // 2] if len(v) % 2 else (sorted(v)[len(v) // 2 - 1] + sorted(v)[len(v) // 2]) / 2
    near, wide, out = [], [], []
    regime, broken, crystal, first, owed = None, 0, 0, None, 0.0
    for t, r in enumerate(rows):
        w = x[max(0, t - 15) : t + 1]
        gaps = [far(w[i], w[j]) for i in range(len(w)) for j in range(i + 3, len(w))]
        gaps = [g for g in gaps if g > 1e-12]
        near.append(max((max(0.0, 1 - far(w[-1], v) / (0.5 * middle(gaps))) for v in w[:-3]), default=0.0) if gaps else 0.0)
        active = r.ready and r.path_length > 0.5
        coherence = None
        pairs = [(x[i], x[i + 1]) for i in range(max(0, t - 33), t - 1)]
        if active and len(pairs) >= 8:
            a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            # Ridge as plain least squares on rows added for the penalty.
            fit, *_ = np.linalg.lstsq(np.vstack([a, math.sqrt(0.001) * np.eye(6)]), np.vstack([b, np.zeros((6, 6))]), rcond=None)
            moves = [far(*p) for p in pairs if far(*p) > 1e-12]
            coherence = math.exp(-far(x[t - 1] @ fit, x[t]) / max(0.05, middle(moves) if moves else 1e-12))
        steps = np.array([v - u for u, v in zip(w, w[1:]) if far(u, v) > 1e-12])
        value = None
        if r.ready and len(steps) >= 3:
            energy = np.linalg.svd(steps - steps.mean(0), compute_uv=False) ** 2
            share = energy[energy > 1e-12] / energy[energy > 1e-12].sum()
            value = min(1.0, max(0.0, (math.exp(-sum(share * np.log(share))) - 1) / 5)) if len(share) else 0.0
        wide.append(value)
        known = [v for v in wide[-32:] if v is not None]
        contraction = None if value is None else max(0.0, 1 - value / max(known)) if max(known) > 1e-12 else 0.0
        recurrence = sum(near[-16:]) / len(near[-16:]) if active else 0.0
        if coherence is not None and first is None:
            first = t
        if not r.ready or active and coherence is None:
            said, broken, crystal = ("UNRESOLVED", "TRANSPORT_UNRESOLVED"), 0, 0
        elif not active:
            said, broken, crystal, regime = ("INACTIVE", "STAGNANT"), 0, 0, None
        elif coherence >= 0.5:
            shrinks = recurrence >= 0.3 and contraction is not None and contraction >= 0.25
            crystal, broken = crystal + 1 if shrinks else 0, 0
            regime = ("CRYSTALLIZED" if crystal >= 16 else "CRYSTALLIZING") if shrinks else "RECURRENT" if recurrence >= 0.3 else "VIABLE"
            said = ("COHERENT", regime)
        else:
            broken, crystal = broken + 1, 0
            said = ("PROVISIONAL", "VIABLE") if regime == "VIABLE" and broken <= 4 else ("DISRUPTED", "TRANSPORT_DISRUPTED")
        if coherence is not None and t >= first + 16:
            owed += max(0.0, 1 - 2 * coherence)
        out.append((*said, coherence, recurrence, contraction, owed))
    return out


def test_observer_by_its_definition(paths):
    given, got, states_seen = paths.orderBy("timestamp_ns").collect(), T.observer(paths).orderBy("timestamp_ns").collect(), Counter()
    for name in "abc":
        for want, r in zip(defined([g for g in given if g.instrument_id == name]), [g for g in got if g.instrument_id == name], strict=True):
            assert (r.transport, r.state) == want[:2]
            for mine, its in zip((r.coherence, r.recurrence, r.contraction, r.cumulative_deficit), want[2:], strict=True):
                assert (mine is None) == (its is None) and (its is None or abs(mine - its) < 1e-7)
            states_seen[r.state] += 1
    assert len(states_seen) >= 4


def test_stream_in_three_batches_equals_batch(spark, paths):
    states.prepare(spark)
    source, out, progress = (shared_path(spark, x) for x in ("paths", "states", "progress"))
    kept = paths.withColumn("extra", F.lit(1))

    def run():
        stream = spark.readStream.schema(kept.schema).parquet(source)
        states.observer_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 40), (40, 41), (35, 120)):  # the last batch repeats rows
        kept.where(F.col("timestamp_ns").between(low, high - 1)).write.mode("append").parquet(source)
        run()
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    assert key(spark.read.parquet(out)) == key(T.observer(paths))


def test_greedy_band_by_stretches(spark):
    rng = random.Random(5)
    for most in (0, 3, 40):
        sides = [[(k, rng.choice((rng.randrange(0, 400), rng.randrange(0, 60_000)))) for k in ("p", "q") for _ in range(300)] for _ in range(2)]
        want = []
        for k in ("p", "q"):
            x, y = (sorted(t for key, t in s if key == k) for s in sides)
            i = j = 0
            while i < len(x) and j < len(y):
                if abs(x[i] - y[j]) <= most:
                    want.append((k, x[i], y[j]))
                i, j = (i + (x[i] <= y[j] + most), j + (y[j] <= x[i] + most)) if abs(x[i] - y[j]) <= most else (i + (x[i] < y[j]), j + (y[j] < x[i]))
        left, right = (spark.createDataFrame([*s, (None, 5), ("p", None)], "k string, timestamp_ns long") for s in sides)
        got = align.greedy_band(left, right, ["k"], most)
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert align.greedy_band(left.limit(0), right.limit(0), ["k"], 3).count() == 0
