"""Neighbours through the metric index against all distances."""

import numpy as np
import pytest

from tidemark.operators import metric_index as X
from tidemark.operators import samples as S

SCHEMA = "sample_id long, vector array<double>, mask array<boolean>, mask_key string, at long, known_at long"


def rows(vectors, masks=None, late=None):
    out = []
    for i, v in enumerate(vectors):
        m = masks[i] if masks is not None else [True] * len(v)
        out.append((i, [float(x) if k else 0.0 for x, k in zip(v, m, strict=True)], [bool(k) for k in m], "".join("1" if k else "0" for k in m), i, i + (int(late[i]) if late is not None else 1)))
    return out


def brute(queries, library, k, most, eligible):
    want = {}
    for q in queries:
        found = []
        for r in library:
            if r[3] != q[3] or (eligible == "others" and r[0] == q[0]) or (eligible == "matured" and not (r[4] < q[4] and r[5] < q[4])):
                continue
            active = np.array(q[2], bool)
            d = float(np.sqrt(((np.array(r[1]) - np.array(q[1]))[active] ** 2).sum() / active.sum())) if active.any() else float("inf")
            if most is None or d <= most:
                found.append((d, r[0]))
        want.update({(q[0], i): x for i, x in enumerate(sorted(found)[:k], 1)})
    return want


def check(spark, queries, library, k, most=None, eligible="all"):
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    met, measured = X.MetricIndex(frame(library)).search(frame(queries), k, most, eligible)
    got = {(r.q_sample_id, r["rank"]): (r.distance, r.l_sample_id) for r in met.collect()}
    want = brute(queries, library, k, most, eligible)
    assert got.keys() == want.keys()
    for key, (d, i) in want.items():
        assert got[key][1] == i and got[key][0] == pytest.approx(d)
    return sum(r.measured for r in measured.collect())


def clustered(n, rng, dims=8):
    centres = rng.normal(size=(40, dims)) * 10
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dims))


def test_clustered_rows_are_mostly_left_unmeasured(spark):
    rng = np.random.default_rng(1)
    library = rows(clustered(4000, rng))
    queries = library[::50]
    assert check(spark, queries, library, 10, None, "others") < 0.3 * len(queries) * len(library)


def test_masks_ties_limits_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 16)
    monkeypatch.setattr(X, "QUERIES", 3)
    monkeypatch.setattr(X, "ROWS_A_PIVOT", 8)
    rng = np.random.default_rng(2)
    v = np.round(clustered(400, rng, 4), 0)  # many equal distances
    masks = [[True] * 4 if i % 3 else [True, False, True, True] for i in range(400)]
    masks[7], masks[8], masks[9] = [False] * 4, [False] * 4, [True, False, False, False]
    library = rows(v, masks, rng.integers(1, 30, 400))
    for most, eligible in ((None, "all"), (1.5, "others"), (None, "matured"), (2.0, "matured")):
        check(spark, library[::7] + library[8:10], library, 6, most, eligible)
    check(spark, library[:3], library, 1000)


def test_equal_rows_empty_tables_and_a_wrong_word(spark):
    library = rows(np.ones((300, 3)))
    check(spark, library[:2], library, 5, None, "others")
    check(spark, [], library, 5)
    check(spark, library[:2], [], 5)
    with pytest.raises(ValueError):
        S.neighbours(spark.createDataFrame(library, SCHEMA), spark.createDataFrame(library, SCHEMA), 3, eligible="later")
