import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as P
from tidemark.llm import rans as R
from tidemark.llm.tokens import KINDS, encoder

LIBRARY = {}
for name in KINDS:
    LIBRARY[name] = Tokenizer.from_file(public_tokenizers.path(name))

ODD = ["", "  a  b ", "a\n\nb.\n c", "x\xa0y　z", "a\x1cb \x1d c", "don't we'll's 's", " \t\t x\n", "<|endoftext|> a <|startoftext|>", "é ́a", "ΑΣ ΟΔΟΣ.", "it's.,. a., b.", "   q", "a" * 500, "日本語、テキスト。 １２３", "x ,. y . , z", "İstanbul. Kﬁ, ²x.", "hello ǃ", "ƻ a", "ǀ", "a  <|endoftext|> b", "x<|startoftext|>  ", "<|endoftext|>.<|endoftext|>", "Ünïcode, Wörter.\nZwei"]


def ids_of(name, text):
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(KINDS))
def test_chunks_give_the_library_s_ids(name):
    for t in ODD:
        assert np.frombuffer(encoder(name)(t), "<u4").tolist() == ids_of(name, t), t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZé ü.,'’\n\t\xa0 s1²#ΣñİK　"), max_size=30), st.sampled_from(sorted(KINDS)))
def test_any_text_gives_the_library_s_ids(text, name):
    assert np.frombuffer(encoder(name)(text), "<u4").tolist() == ids_of(name, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.sampled_from(sorted(KINDS)))
def test_any_unicode_text_gives_the_library_s_ids(text, name):
    assert np.frombuffer(encoder(name)(text), "<u4").tolist() == ids_of(name, text)


@pytest.mark.parametrize("name", sorted(KINDS))
def test_many_random_texts_give_the_library_s_ids(name):
    """Letters of the ranges that are cut specially, with what may stand around them."""
    rng = np.random.default_rng(5)
    points = np.array([c for c in range(0x20, 0x3000) if not 0x600 <= c < 0x1000] + [9, 10, 13, 0x3000, 0x4E00, 0xFF11, 0x1F600])
    for _ in range(20_000):
        pool = points[points < 0x250] if rng.random() < 0.7 else points
        text = "".join(map(chr, np.where(rng.random(12) < 0.3, rng.choice([0x20, 0x2E, 0x2C, 0x41, 0x7A], 12), rng.choice(pool, 12)).tolist()))
        assert np.frombuffer(encoder(name)(text), "<u4").tolist() == ids_of(name, text), text


@pytest.mark.parametrize("n", [0, 1, 2, 255, 1000, 70_000])
def test_blocks_round_trip_and_guard_themselves(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype("<u2")
    table = R.Table.of(np.bincount(ids, minlength=49_409))
    assert int(table.freq.sum()) == 1 << R.SCALE_BITS and R.Table.load(table.dump()).crc == table.crc
    block = R.encode_block(ids, [7, None], np.array([n // 3, n - n // 3]), table, every=16)
    names, lengths, back = R.decode_block(block, table)
    assert names == [7, None] and lengths.tolist() == [n // 3, n - n // 3] and back.tolist() == ids.tolist()
    if n >= 1000:
        lanes = R._lanes(n)
        _, _, part = R.decode_block(block, table, 1, 2)
        assert part.tolist() == ids[16 * lanes : 32 * lanes].tolist()
    hurt = bytearray(block)
    hurt[-1] ^= 1
    with pytest.raises(ValueError):
        R.decode_block(bytes(hurt), table)


def test_table_gives_every_id_that_occurs_a_slot():
    counts = np.zeros(50_000, int)
    counts[:40_000] = 1
    counts[5] = 10**9
    t = R.Table.of(counts)
    assert int(t.freq.sum()) == 1 << R.SCALE_BITS and (t.freq[:40_000] > 0).all()


ROWS = [(3, "alpha beta"), (1, None), (1, None), (None, "gamma, delta"), (2, ""), (9, "word " * 4000)]


def test_archive_reads_back_what_was_written(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, start string")
    got = R.token_archive(docs).read(digest=True).orderBy("start").collect()
    want, at = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*ids_of("word_bpe_49k.json", t or ""), 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert R.token_archive(docs.limit(0)).read(digest=True).count() == 0


def check_packing(rows, docs, capacity=P.CAPACITY):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for d, t in docs:
        ids = np.array([*ids_of("byte_bpe_50k.json", t or ""), 2], "<u4")
        mine = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and mine[-1].start + mine[-1].length == len(ids)
        assert all(r.length == capacity for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    return len(by_sequence)


def test_packing_is_gapless_and_near_its_bound(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(["tide"] * int(rng.integers(0, 1500)))) for i in range(400)] + [(400, None), (401, "")]
    table = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, length int")
    packed = P.pack_documents(table)
    rows = packed.collect()
    used = check_packing(rows, docs)
    assert used <= P.lower_bound([r.length for r in rows], P.CAPACITY) + 3
    again = {(r.doc_id, r.piece): r.length for r in packed.collect()}
    assert len(again) == len(rows)
    made = {r.sequence_id: r.ids for r in P.sequences(table, packed).collect()}
    assert len(made) == used and all(len(x) <= P.CAPACITY for x in made.values())
    assert P.pack_documents(table.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_pack(spark):
    table = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "x")], "doc_id long, text string")
    assert P.pack_documents(table).count() == 4


def test_genetic_search_never_loses_pieces_nor_gets_worse():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(100, 700, 120).tolist(), reverse=True)
    start = P.best_fit(sizes, range(len(sizes)), 1024)
    best = P.evolve(sizes, [start], 1024, rng, P.lower_bound(sizes, 1024), 30)
    assert sorted(i for b in best for i in b) == list(range(120)) and len(best) <= len(start)
    assert all(sum(sizes[i] for i in b) <= 1024 for b in best)
