import random
import re

import numpy as np
import pytest

from tidemark.llm import minhash as M

from .test_simhash import components

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(2000)]


def slow_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, from all pairs."""
    sets = [slow_set(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    part = components(len(rows), edges)
    least = {}
    for (d, _), p in zip(rows, part, strict=True):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    return sorted(((d, len(s), least.get(p), d == least.get(p)) for (d, _), s, p in zip(rows, sets, part, strict=True)), key=str)


def edited(words, n):
    words = list(words)
    for _ in range(n):
        at = RNG.randrange(len(words))
        words[at : at + RNG.choice([1, 1, 0, 2])] = [RNG.choice(WORDS)] * RNG.choice([1, 1, 0])
    return " ".join(words)


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in M.minhash_components(docs).collect()), key=str)


def test_shingles_are_those_of_the_text():
    for t in ["", " \t", "One", "one two", "One two\x0bthree", "a b c a b c", "É é\xa0x y Z", "x " * 5000]:
        assert len(M.shingle_set(t)) == len(slow_set(t))
    assert M.shingle_set("A b").tolist() == M.shingle_set("a B").tolist() != M.shingle_set("b a").tolist()
    assert M.linked(M.shingle_set("a b c d e f g"), M.shingle_set("a b c d e f g")) and not M.linked(M.shingle_set("a b c d"), M.shingle_set("a b c e"))


def test_components_equal_all_pairs(spark):
    rows = [(i, " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 150)))) for i in range(120)]
    for g in range(8):
        base = [RNG.choice(WORDS) for _ in range(RNG.choice([8, 30, 100, 400]))]
        rows += [(1000 + 100 * g + i, edited(base, RNG.randrange(0, 1 + len(base) // 25))) for i in range(25)]
    rows += [(5000 + i, "same text for all of these rows") for i in range(30)]
    rows += [(None, rows[130][1]), (None, None), (7, None), (8, ""), (9, " \n "), (10, "Two words"), (11, "two  WORDS"), (7, rows[130][1]), (7, rows[130][1]), (None, "nobody else says this one"), (6000, "long " + " ".join(RNG.choice(WORDS) for _ in range(60_000)))]
    rows += [(6001, rows[-1][1] + " tail")]
    RNG.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_a_group_that_no_hub_brings_together(spark, monkeypatch):
    """Variants linked in chains, with blocks so small that every bucket is split."""
    monkeypatch.setattr(M, "BLOCK", 8)
    base = [RNG.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in RNG.sample(range(90), 3):
            words[at] = RNG.choice(WORDS)
        rows.append((i, " ".join(words)))
    chain = list(base[::-1])
    for i in range(30):
        chain[(3 * i) % 90] = RNG.choice(WORDS)
        rows.append((100 + i, " ".join(chain)))
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d", "x", "y", "z"), (2, "A b c d", "x", "y", "z")], "doc_id long, text string, node string, id string, `check` string")
    assert sorted(map(tuple, M.minhash_components(docs).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


@pytest.mark.parametrize("similarity", [0.85, 0.9])
def test_recall_of_the_tables(similarity):
    """Half keys of pairs built at a similarity: the share that meets in a table is what the docstring says."""
    met = 0
    for _ in range(200):
        n = 300
        shared = round(2 * n * similarity / (1 + similarity))
        words = [RNG.getrandbits(60) for _ in range(2 * n - shared)]
        sets = [np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in (words[:n], words[n - shared :])]
        a, b = map(M.min_values, sets)
        same = (a == b).reshape(-1, M.HALF).all(1)
        met += bool(same[: M.COLLECTION].any() and same[M.COLLECTION :].any()) and bool(M.alike(*(np.frombuffer(M.sketch_of(x), np.uint8)[None] for x in sets), *(np.array([len(x)]) for x in sets), M.LEAST)[0])
    assert met == 200
