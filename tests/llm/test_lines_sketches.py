"""Sketches tell long lines apart too, so that few pairs leave a key; scratch tables go with their step."""

import os
import random

from tidemark.llm import common as C
from tidemark.llm import lines as D


def _lines(rng, n, words):
    return [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(words)) for _ in range(n)]


def test_unlike_long_lines_of_a_key_are_no_likely_pairs(spark, monkeypatch):
    rng = random.Random(4)
    texts = _lines(rng, 40, 270)
    texts[20], texts[31] = texts[10] + " more", texts[30] + " more"
    made = {}

    def counted(df, name, *more):
        out = C.written(df, name, *more)
        made[name] = made.get(name, 0) + (out.count() if name in ("stars", "across") else 0)
        return out

    monkeypatch.setattr(D, "written", counted)
    bands = [(i, key, False) for i in range(40) for key in (1, 2)]  # both keys are shared by all
    found = lambda ids, count: spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, check long, line string")
    parts = D.fuzzy_components(spark.createDataFrame(bands, "id long, key long, alone boolean"), found)
    assert {r.id: r.component for r in parts.collect()} == {10: 10, 20: 10, 30: 30, 31: 30}
    assert made["stars"] + made["across"] == 2


def test_scratch_tables_go(spark):
    before = set(os.listdir(f"{C.shared_dir(spark)}/tidemark".removeprefix("file:"))) if os.path.isdir(f"{C.shared_dir(spark)}/tidemark".removeprefix("file:")) else set()
    docs = spark.createDataFrame(list(enumerate(_lines(random.Random(6), 12, 20) * 2)), "doc_id long, text string")
    out = D.dedup_lines(docs)
    left = set(os.listdir(f"{C.shared_dir(spark)}/tidemark".removeprefix("file:"))) - before
    assert {x.split("-")[0] for x in left} == {"drops"}
    assert sum(r.text == "" for r in out.collect()) == 12
