import random
import re
from collections import Counter, defaultdict

from tidemark.llm import collocations as C


def brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p.encode(): a for p, a in count.items() if " " in p and a >= least}
        ranked = []
        for p, a in found.items():
            words = p.split(b" ")
            if any(len(q) > len(p) and b" " + p + b" " in b" " + q + b" " and 100 * b >= cover * a for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (count[b" ".join(words[:k]).decode()] * count[b" ".join(words[k:]).decode()]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            ranked.append((-score, -a, p, count[b" ".join(words[:k]).decode()], count[b" ".join(words[k:]).decode()]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(map(tuple, C.collocations(spark.createDataFrame(rows, "lang string, text string"), **options).collect()))


def _rows(seed=1):
    rng = random.Random(seed)
    words = ["new", "York", "the", "of", "in", "spite", "état", "日本", "a\xa0b", "x\x00y", "ﬁn", "'tis", "|", "É"]
    rows = []
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", "  ", ". ", ",", "\n", "\x0b", " ;"]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", "In spite of the state of New York.")] * 40 + [("en", None), ("en", ""), (None, " .,; "), ("fr", "trop peu"), ("en", "one piece " * 9000)]
    return rows


def test_collocations_equal_brute_force(spark):
    rows = _rows()
    want = brute(rows)
    assert got(spark, rows) == want and {r[0] for r in want} >= {"en", "de", "und"}


def test_longer_phrases_ties_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 500)
    rows = _rows(2)
    assert got(spark, rows, longest=5, least=3, cover=80, top=7) == brute(rows, 5, 3, 80, 7)
    assert got(spark, rows, longest=2, least=2) == brute(rows, 2, 2)


def test_scores_beyond_64_bits_are_exact(spark):
    docs = spark.createDataFrame([("en", "alpha beta")], "lang string, text string")
    big = 3_037_000_507
    pieces = spark.createDataFrame([("en", "alpha beta", big), ("en", "alpha", 11), ("en", "beta", 13)], "lang string, piece string, n long")
    counts = {r.gram: r.f for r in C.gram_counts(pieces).collect()}
    assert counts == {"": 2 * big + 24, "alpha": big + 11, "beta": big + 13, "alpha beta": big}
    original, C.pieces = C.pieces, lambda *_: pieces
    try:
        (row,) = C.collocations(docs).collect()
    finally:
        C.pieces = original
    assert row.score == 10**6 * big * big // ((big + 11) * (big + 13))


def test_empty_table_and_clashing_names(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([("en", "a b", 1, 2, 3)] * 12, "lang string, text string, phrase int, gram int, n int")
    assert [tuple(r) for r in C.collocations(docs).collect()] == [("en", 1, "a b", 12, 12, 12, 24, 1_000_000)]
