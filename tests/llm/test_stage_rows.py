"""Stages lose no document: null, repeated and very large ids, and further columns with clashing names."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import mixing as M
from tidemark.llm import simhash as S

BIG = 1 << 60
#: Names that the stages use inside, as columns of the documents.
CLASHING = ["keep_id", "touched_id", "drop_lines", "row", "spot", "near_doc", "id", "check", "group", "hit", "mark", "copies", "many", "unit", "class", "salt", "key", "line", "n_words", "kept", "base_failed", "filter_word"]


def _text(seed, lines=4):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 40))) for _ in range(lines))


A, B, C, D = (_text(i) for i in range(4))
NEAR_A = A.replace(A.split()[30], "changed")
ROWS = [(1, A), (1, B), (1, A), (None, NEAR_A), (None, C), (None, None), (2, ""), (BIG + 1, D), (BIG + 3, _text(9)), (BIG + 1, _text(10)), (5, "tiny")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", *[f"{c}{i}" for c in CLASHING]) for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{c}` string" for c in CLASHING]]))


def _pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_dedup_drops_copies_only(spark, docs):
    out = S.near_copies_stage(docs)
    assert out.columns == docs.columns
    want = Counter([(1, A), (1, B), (None, C), (2, ""), (BIG + 1, D), (BIG + 3, ROWS[8][1]), (BIG + 1, ROWS[9][1]), (5, "tiny")])
    assert _pairs(out) == want
    by_print = S.dedup_stage(docs)
    assert by_print.columns == docs.columns and not want - _pairs(by_print)


def test_line_dedup_keeps_every_row(spark, docs):
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(ROWS)
    got = {(r.doc_id, r.row): r.text for r in out.collect()}
    assert got[1, "row1"] == B and got[BIG + 1, "row7"] == D and got[BIG + 1, "row9"] == ROWS[9][1] and got[None, "row5"] is None
    assert got[None, "row3"] == NEAR_A and got[1, "row0"] == got[1, "row2"] == ""  # a null id comes first


def test_mix_takes_whole_rows(spark, docs):
    taken = M.mix(docs)
    assert taken.count() == len(ROWS) and {r.doc_id for r in taken.collect()} == {d for d, _ in ROWS}
    staged = M.mix_stage(docs)
    assert staged.columns == docs.columns
    words = sum(len((t or "").split()) for _, t in ROWS)
    got = staged.collect()
    assert sum(len((r.text or "").split()) for r in got) == words  # one source: its target is its size
    assert _pairs(staged) == Counter(ROWS)
    assert Counter(r.row for r in got) == Counter(f"row{i}" for i in range(len(ROWS)))


def test_quality_and_packing_keep_ids(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from tidemark.llm import packing, quality

    kept = quality.filter_stage(docs, labels)
    assert kept.columns == docs.columns
    assert _pairs(kept) == Counter((d, t) for d, t in ROWS if len((t or "").split()) >= 20)
    packed = packing.pack_documents(docs).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in ROWS)


def test_a_very_long_line_is_one_line(spark):
    line = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, line), (2, line.replace("word500 ", "other ")), (3, "-" * 100_000), (4, "-" * 50)]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert out == {1: line, 2: "", 3: "-" * 100_000, 4: ""}
