import random

import xxhash
from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_fingerprint_is_spark_xxhash_and_matches_brute_force(spark):
    for t in ["", "A", "a B", "a b c", "Été a\tb\x0bc A É d e", "x " * 5000, "one two three four one two three four"]:
        assert S.fingerprint(t) == slow_fingerprint(t)
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_connect_exactly_what_brute_force_does(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)} | set(base) | {0, 3, 12, 1 << 63})
    for radius in (1, 2):
        rows = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
        got = [(r.a, r.b) for r in S.links(rows, radius).collect()]
        place = {S._signed(x): i for i, x in enumerate(fps)}
        assert all((fps[place[a]] ^ fps[place[b]]).bit_count() <= radius for a, b in got)
        assert components(len(fps), [(place[a], place[b]) for a, b in got]) == components(len(fps), S.brute_force(fps, radius))


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (9, None, None), (7, "", "x"), (None, text, "c"), (4, "quite another text with other words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = S.simhash_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (5, 2, None)} == {2}
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (9, 7)} == {("0" * 16, 7)}
    kept = S.dedup_stage(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7] and kept.columns == docs.columns
    assert S.simhash_components(docs.limit(0)).count() == 0 and S.dedup_stage(docs.limit(0)).count() == 0


def test_union_find_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and len(got) == 251
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
