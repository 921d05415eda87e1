"""Lines meet in one shuffle of their keys; few links are joined in the driver; long rulers are flattened."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines as D
from tidemark.llm.components import connected_components


def test_lines_meet_in_one_shuffle(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(2)]
    lines.append(lines[0] + "z")
    known = D.sketched(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), D.shingles)
    rows = spark.createDataFrame([(k, 3, i, i, [7, 9]) for k in (7, 9) for i in range(3)], "key long, many long, id long, component long, keys array<long>").join(known, "id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = D._across(rows)
        assert [(r.x, r.y) for r in out.collect()] == [(0, 2)]
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("ReusedExchange") == 1  # the other side


@pytest.mark.parametrize("text", ["-" * 100_000, "ab " + "=" * 13 + " cd", "-----", "------"])
def test_runs_of_rulers_are_five_long(spark, text):
    got = spark.createDataFrame([(text,)], "line string").select(D.flattened(F.col("line"))).first()[0]
    assert not any(c * 6 in got for c in "-=") and {text[i : i + 5] for i in range(len(text) - 4)} == {got[i : i + 5] for i in range(len(got) - 4)}


def test_few_links_are_joined_in_the_driver(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1400)] + [(5, None), (None, 6), (900, 900)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = {tuple(r) for r in connected_components(table).collect()}
    out = connected_components(table, here=1000)
    assert {tuple(r) for r in out.collect()} == want and out.columns == ["node", "component"]
    assert connected_components(table.limit(0), here=1000).collect() == []
