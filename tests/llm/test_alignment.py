import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import alignment as A
from tidemark.llm.tokens import piece_encoder

from .test_tokens import ODD

BYTE, PIECE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE.encode_special_tokens = True
RAW_OF = {c: b for b, c in zip([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)], map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]), strict=True)}
RAW_OF |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(RAW_OF.values()))}


def piece_bytes(i):
    p = PIECE.id_to_piece(i)
    return bytes([int(p[1:-1], 16)]) if PIECE.is_byte(i) else p.replace("▁", " ").encode()


def tokens(text):
    """((id, bytes) of A, of B) by the libraries on the whole text; None without tokens."""
    if not text:
        return None
    a = [(i, bytes(RAW_OF[c] for c in BYTE.id_to_token(i))) for i in BYTE.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, piece_bytes(i)) for i in PIECE.encode(text)]
    want = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in t) == want for t in (a, b)) else None


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(rows):
    links, stats = [], []
    for _, text in rows:
        got = tokens(text)
        if got is None:
            links.append([]), stats.append((0, 0, 0, ""))
            continue
        a, b = map(spans, got)
        links.append([(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]])
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, at = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(t[2]) for t in side if at < t[1] <= e) for side in (a, b)))
            at = e
        stats.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for l in links for p in l)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(((d, na, nb, g, len(l), sum(count[p] == most[p[1]] for p in l), sum(count[p] for p in l), h) for (d, _), l, (na, nb, g, h) in zip(rows, links, stats, strict=True)), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in A.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def _rows():
    rng = random.Random(3)
    words = ["the", "of", "token", "überall", "naïve", "日本語", "x.y", "don't", "42", "…", "supercalifragilistic", "🙂", "\n", "  ", "École", "zzzzqq", "<|endoftext|>", "</s>", "<s>", "<0x41>"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "has ▁ inside"), (None, "no id"), (None, None), (203, "same"), (203, "same"), (203, "same"), (203, "other"), (204, "same")]
    rows += [(300, "long " + "".join(rng.choice("abcdefgh é.\n") for _ in range(3000))), (301, " lead"), (302, "a\x00b"), (303, "é" * 200), (304, "q" * 700)]
    return rows


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "WINDOW", 64)
    monkeypatch.setattr(A, "HELD", 100)
    rows = _rows()
    assert got(spark, rows) == brute(rows)


def test_rare_pairs_go_through_the_join(spark, monkeypatch):
    monkeypatch.setattr(A, "HOT", 20)
    monkeypatch.setattr(A, "COUNTED", 50)
    rows = _rows()
    assert got(spark, rows) == brute(rows)


def test_long_text_in_default_windows(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta,", "Γάμμα", "delta.\n", "e" * 9]) for _ in range(30_000))
    assert len(text) > 5 * A.WINDOW
    (row,) = got(spark, [(1, text)])
    a, b = map(spans, tokens(text))
    ends = {x[1] for x in a} & {y[1] for y in b}
    assert row[1:5] == (len(a), len(b), len(ends), len({x[1] for x in a} | {y[1] for y in b}))


def test_empty_table_and_clashing_names(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", "x", "y", 5)], "doc_id long, text string, id string, code string, many int")
    assert A.align(docs).first().n_links == brute([(1, "a b")])[0][4]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abZé ü.,'\n\t\xa0 s1²Σ  "), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_pieces_are_the_library_s(text):
    ids = piece_encoder("piece_bpe_32k.model")(" " + text)
    want = PIECE.encode(text) if text else PIECE.encode("")
    if ids is None:
        assert b"".join(map(piece_bytes, want)) != (" " + text).encode()
    elif text:
        assert np.frombuffer(ids, "<u2").tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_many_texts(seed):
    rng = random.Random(seed)
    pool = "ab.,: \n-'\"éßZ1/²³ªº" + "".join(chr(c) for c in range(0xC0, 0x250, 7))
    encode = piece_encoder("piece_bpe_32k.model")
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 20)))
        assert np.frombuffer(encode(" " + text), "<u2").tolist() == PIECE.encode(text), text
