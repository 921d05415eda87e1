"""Whether lines are linked doesn't depend on how many others share their key."""

import random

import pytest

from tidemark.llm import lines as D


@pytest.mark.parametrize("large", [1 << 14, 4])
def test_a_pair_with_one_key_in_a_large_key_is_linked(spark, monkeypatch, large):
    monkeypatch.setattr(D, "LARGE", large)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(40)]
    near = {20: 10, 31: 30, 35: 34}  # one word more
    for copy, of in near.items():
        texts[copy] = texts[of] + " more"
    bands = [(i, 1, False) for i in range(40)] + [(i, 100 + i // 2, False) for i in range(40)]  # the first key is shared by all
    bands = [b for b in bands if not (b[1] > 100 and b[0] in (30, 31, 34, 35))] + [(i, 200 + i, False) for i in (30, 31, 34, 35)] + [(i - 29, 200 + i, False) for i in (30, 31, 34, 35)]

    def found(ids, count):
        return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, check long, line string")

    parts = D.fuzzy_components(spark.createDataFrame(bands, "id long, key long, alone boolean"), found)
    got = {r.id: r.component for r in parts.collect()}
    assert got == {x: of for pair in near.items() for x, of in ((pair[0], pair[1]), (pair[1], pair[1]))}
