"""The registered queries and the pipeline on a small set of tables, against brute force."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import queries as Q
from tidemark.llm import simhash as S

from .test_other_ops import slow_lines
from .test_quality import brute
from .test_simhash import components, slow_fingerprint
from .test_tokens import check_packing, ids_of

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(900)]


def _text(n):
    return "\n".join(" ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(20, 60))) for _ in range(n))


def _documents():
    rows = [(i, _text(RNG.randrange(1, 5)), "en", f"src{RNG.randrange(3)}") for i in range(70)]
    base = _text(4)
    rows += [(100 + i, base, "en", "hot") for i in range(25)]  # exact copies
    for i in range(10):  # near copies
        words = base.split(" ")
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        rows.append((200 + i, " ".join(words), "en", "hot"))
    rows += [(300, None, None, None), (301, "", "en", "src0"), (302, "few words", "en", "src1"), (303, " ".join(f"{RNG.choice(WORDS)}###" for _ in range(80)), "en", "src2"), (304, "same words again and again in line " * 30, "en", "src2"), (305, f"{_text(1)} Released under the MIT License.", "en", "src1")]
    rows += [(400 + i, f"{_text(1)} vileword {_text(1)} nastyword", "en", "src1") for i in range(15)]
    return rows


DOCS = _documents()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(*r, None if r[1] is None else len(r[1])) for r in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int("###" not in (r[1] or "")), int("vileword" in (r[1] or ""))) for r in DOCS]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(0)
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(400, 8)))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, tables, number):
    (name,) = [n for n in Q.queries() if n.startswith(f"op{number}_")]
    return Q.queries()[name](spark, tables).collect()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


def test_op1(spark, tables):
    assert {(r.doc_id, r.licence) for r in run(spark, tables, 1)} == {(305, "mit-short")}


def test_op2(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, 2)}
    assert len(got) == len(DOCS) and all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_op3(spark, tables):
    want, at = {}, 0
    for d, t, *_ in sorted(DOCS):
        ids = np.array([*ids_of("word_bpe_49k.json", t or ""), 1], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, tables, 3)} == want


def test_op4(spark, tables):
    docs = sorted(DOCS)
    fps = [slow_fingerprint(r[1] or "") for r in docs]
    parts = components(len(docs), S.brute_force(fps))
    want = {r[0]: (f"{f:016x}", docs[p][0]) for r, f, p in zip(docs, fps, parts, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, tables, 4)} == want


def test_op5(spark, tables):
    for r in run(spark, tables, 5):
        text = next(t for d, t, *_ in DOCS if d == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_op6(spark, tables):
    x = np.array([r.embedding for r in spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()])
    hits = 0
    got = run(spark, tables, 6)
    for q in range(0, 400, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.argsort(far, kind="stable") if i != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(mine) == 10 and all(r.score == far[r.vec_id] for r in mine)
        hits += len(set(best) & {r.vec_id for r in mine})
    assert hits >= 36


def test_op7(spark, tables):
    want = slow_lines([r[:2] for r in DOCS])
    got = {r.doc_id: r.text for r in run(spark, tables, 7)}
    assert sum(got[d] != want[d] for d in want) == 0


def test_op8(spark, tables):
    got = run(spark, tables, 8)
    sizes = {r[0]: len((r[1] or "").split()) for r in DOCS}
    assert {r.doc_id: r.size for r in got} == sizes and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, run(spark, tables, 8)), key=repr)


def test_op9(spark, tables):
    for r in run(spark, tables, 9):
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id < 7 else ("revisit", r.page_id % 7)) and r.payload_bytes == 8


def test_op10(spark, tables):
    check_packing(run(spark, tables, 10), [r[:2] for r in DOCS])


def test_pipeline_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        rows = out.collect()
        seen.append((name, len(rows)))
        docs = spark.createDataFrame(rows, out.schema)
    counts = dict(seen)
    quality = {r.doc_id for r in run(spark, tables, 5) if r.kept}
    assert counts["quality_rules"] == len(quality) and not quality & {300, 301, 302, 304}
    assert counts["line_dedup"] == counts["quality_rules"]
    # All lines of the exact copies go but those of the first; empty texts are copies of each other.
    assert counts["simhash_near_dedup"] <= counts["line_dedup"] - 24
    whole = corpus_pipeline.run(spark, tables)
    assert whole.count() == counts["best_fit_packing"]


def test_pipeline_takes_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0
        docs = spark.createDataFrame([], docs.schema)
