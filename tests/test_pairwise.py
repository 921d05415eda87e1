"""Reports over all pairs against all distances in loops."""

import numpy as np
import pytest

from tidemark.operators import audits
from tidemark.operators import pairwise as P

SCHEMA = "sample_id int, vector array<double>, mask array<boolean>, mask_key string, direction string"


def library(n=700, seed=4):
    """Rows with three masks, many ties, a rare class and rows without one."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        m = [True, i % 5 > 0, True, True] if i != 13 else [False] * 4
        v = [float(x) if k else 0.0 for x, k in zip(np.round(rng.normal(size=4) * (1 if i % 2 else 40), 0 if i % 3 else 2), m, strict=True)]
        out.append((i, v, m, "".join("1" if k else "0" for k in m), None if i % 31 == 0 else "LONE" if i == 602 else ("UP", "RANGE", "DOWN")[int(rng.integers(3))]))
    return out


def brute(queries, rows, causal=False):
    """Each query's (distance, id, class), nearest first."""
    met = {}
    for i, v, m, key, _ in queries:
        for j, w, _, other, name in rows:
            if other == key and (j < i if causal else j != i):
                d = float(np.sqrt(((np.array(v) - np.array(w))[m] ** 2).sum() / sum(m))) if any(m) else float("inf")
                met.setdefault(i, []).append((d, j, name))
    return {q: sorted(x, key=lambda y: y[:2]) for q, x in met.items()}


@pytest.fixture
def small(monkeypatch):
    for name, value in {"QUERIES": 5, "ROWS": 100, "LIMIT": 4, "WIDE": 16}.items():
        monkeypatch.setattr(P, name, value)


def pairs(spark, queries, rows):
    return P.AllPairs(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA))


def test_class_geometry_equals_all_pairs(spark, small):
    rows = library()
    queries = rows[::20]
    got = {(r.query_id, r.direction): r for r in audits.class_geometry(pairs(spark, queries, rows)).collect()}
    want = {}
    for q, met in brute(queries, rows).items():
        for rank, (d, _, name) in enumerate(met, 1):
            if name is not None:
                want.setdefault((q, name), (rank, []))[1].append(d)
    assert got.keys() == want.keys()
    for key, (rank, far) in want.items():
        r = got[key]
        assert (r.n, r.nearest_rank) == (len(far), rank), key
        assert [r.least, r.p10, r.p25, r.p50, r.p75, r.most] == pytest.approx(np.quantile(far, audits.QUANTILES).tolist()), key


@pytest.mark.parametrize("causal", [False, True])
def test_compactness_equals_all_pairs(spark, small, causal):
    rows = library()
    queries = rows[::20] + [rows[13]]
    got = {r.query_id: r for r in audits.compactness(pairs(spark, queries, rows), causal=causal).collect()}
    want = brute(queries, rows, causal)
    assert got.keys() == want.keys()
    for q, met in want.items():
        own = rows[q][4]
        same = [None if own is None or name is None else own == name for _, _, name in met]
        least = lambda kind: min((d for (d, _, _), s in zip(met, same, strict=True) if s is kind), default=None)  # noqa: E731, B023
        assert got[q].nearest_same == (pytest.approx(least(True)) if least(True) is not None else None)
        assert got[q].nearest_other == (pytest.approx(least(False)) if least(False) is not None else None)
        for k in (5, 10, 20):
            assert got[q][f"same_share_{k}"] == pytest.approx(sum(s is True for s in same[:k]) / len(same[:k]))


def test_nan_comes_last_and_empty_tables_give_nothing(spark, small):
    rows = [(0, [0.0], [True], "1", "UP"), (1, [float("nan")], [True], "1", "DOWN"), (2, [float("inf")], [True], "1", "UP"), (3, [3.0], [True], "1", "UP")]
    got = {r.direction: r for r in audits.class_geometry(pairs(spark, rows[:1], rows)).collect()}
    assert got.keys() == {"UP"} and (got["UP"].n, got["UP"].nearest_rank, got["UP"].least, got["UP"].most) == (2, 1, 3.0, float("inf"))
    near = audits.compactness(pairs(spark, rows[:1], rows)).first()
    assert near.nearest_same == 3.0 and np.isnan(near.nearest_other)
    for queries, lib in (([], rows), (rows, [])):
        assert not audits.class_geometry(pairs(spark, queries, lib)).count() and not audits.compactness(pairs(spark, queries, lib)).count()


def test_only_bounded_rows_leave_a_cell(spark, small):
    rows = library(2000)
    queries = rows[::100]
    met = pairs(spark, queries, rows).fold(lambda q: P._Nearest(q, 5, False), P._Nearest.SCHEMA).count()
    parts = -(-sum(r[3] == queries[0][3] for r in rows) // P.ROWS)  # all queries have this mask
    assert met <= len(queries) * (5 + 2) * parts < sum(len(x) for x in brute(queries, rows).values()) / 10
