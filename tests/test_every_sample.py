"""The compactness reports ask with every sample, against every other; rounds give what loops over all pairs give."""

import os

import numpy as np
import pytest

from tidemark.operators import audits
from tidemark.operators import pairwise as P
from tidemark.plans import sample_queries as Q

from .test_pairwise import brute, library, pairs

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["compactness", "compactness_causal"])
def test_every_sample_is_asked(spark, name):
    asked = {r.query_id for r in Q.QUERIES[name](spark, DATA).collect()}
    rows = {r.sample_id: r.sample_id % 7 == 0 for r in Q.sample_rows(spark, DATA).collect()}
    first = {min(i for i in rows if rows[i] == mask) for mask in (False, True)}  # nothing is before the first of a mask
    assert asked == set(rows) - (first if name == "compactness_causal" else set())


@pytest.mark.parametrize("causal", [False, True])
@pytest.mark.parametrize("odd", [False, True])
def test_rounds_equal_all_pairs(spark, monkeypatch, causal, odd):
    for name, value in {"ROUND": 150, "ASKED": 16, "WIDE": 64}.items():
        monkeypatch.setattr(P, name, value)
    rows = library(400)
    if odd:
        rows[7] = (7, [float("nan")] * 4, *rows[7][2:])
        rows[8] = (8, [1e200] * 4, *rows[8][2:])
    got = {r.query_id: r for r in audits.compactness(pairs(spark, rows, rows), causal=causal).collect()}
    want = {q: sorted(met, key=lambda y: (np.isnan(y[0]), 0 if np.isnan(y[0]) else y[0], y[1])) for q, met in brute(rows, rows, causal).items()}
    assert got.keys() == want.keys()
    for q, met in want.items():
        own = rows[q][4]
        same = [None if own is None or name is None else own == name for _, _, name in met]
        for kind, column in ((True, "nearest_same"), (False, "nearest_other")):
            far = [d for (d, _, _), s in zip(met, same, strict=True) if s is kind]
            assert got[q][column] == (pytest.approx(far[0], nan_ok=True) if far else None), q
        for k in (5, 10, 20):
            assert got[q][f"same_share_{k}"] == pytest.approx(sum(s is True for s in same[:k]) / len(same[:k])), q


def test_few_pairs_are_measured(spark):
    rng = np.random.default_rng(1)
    vectors, counted = rng.normal(size=(16, 4096)), []

    class Counted(P._Nearest):
        def _measured(self, at, vectors, i, j):
            counted.append(len(i))
            return super()._measured(at, vectors, i, j)

    side = P.Side.__new__(P.Side)
    side.ids, side.vectors, side.classes, side.active, side.state = np.arange(4096), vectors, ["UP"] * 4096, np.arange(16), None
    one = Counted(side, 20, False)
    one.add(side)
    assert sum(counted) < 4096 * 4096 / 50
    want = np.sort(np.sqrt(((vectors[:, :5, None] - vectors[:, None, :]) ** 2).sum(0) / 16), 1)[:, 1:21]
    q, far, _, _ = one.best[0]
    assert np.allclose(far[q < 5].reshape(5, 20), want)
