"""Unlike long lines with a short phrase in common don't meet; a likely pair leaves its keys once, whatever its sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import lines as D


def _text(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(n))


def _rows(spark, lines, components, shared):
    known = D.sketched(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), D.shingles)
    keys = [(k, 2, i, c, shared) for i, c in enumerate(components) for k in shared]
    return spark.createDataFrame(keys, "key long, many long, id long, component long, keys array<long>").join(known, "id")


def test_a_pair_of_several_keys_leaves_once(spark):
    line = _text(random.Random(1), 200)
    for blocks in (False, True):
        got = D._across(_rows(spark, [line, line + "zz"], [5, 6], [40, 30, 50]), blocks).collect()
        assert [(r.x, r.y) for r in got] == [(0, 1)]


@pytest.mark.parametrize("components", [[5, 6], [6, 5]])
@pytest.mark.parametrize("n", [100, 97, 64, 101])
def test_a_pair_whose_sizes_are_at_the_edge_leaves_once(spark, n, components):
    line = _text(random.Random(n), n * 5 // 4 + 4)
    lines = [line, line[: n + 4]]  # n * 5 // 4 and n shingles, all of the shorter shared
    assert [len({x[i : i + 5] for i in range(len(x) - 4)}) for x in lines] == [n * 5 // 4, n]
    assert D._across(_rows(spark, lines, components, [7, 9])).count() == 1


def test_unlike_long_lines_with_a_phrase_in_common_share_no_key(spark, monkeypatch):
    rng = random.Random(2)
    phrases = [_text(rng, 20) for _ in range(5)]
    lines = []
    for _ in range(40):
        rng.shuffle(phrases)
        lines.append("".join(x for p in phrases for x in (p, _text(rng, 30))))
    lines.append(lines[3] + "zz")
    met = {}

    def seen(df, name, *more):
        out = C.written(df, name, *more)
        if name == "members":
            met["ids"] = {r.id for r in out.select("id").distinct().collect()}
        return out

    monkeypatch.setattr(D, "written", seen)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    assert [d for d in out if out[d] == ""] == [40]
    want = {r.id for r in docs.where("doc_id IN (3, 40)").select(F.xxhash64("text").alias("id")).collect()}
    assert met["ids"] == want
