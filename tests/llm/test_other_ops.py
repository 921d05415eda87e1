import base64
import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import licences as L
from tidemark.llm import lines as D
from tidemark.llm import mixing as M
from tidemark.llm import neighbours as N
from tidemark.llm import toxicity as T
from tidemark.llm import warc as W


# Licence scans ---------------------------------------------------------------------------------
def test_licences_are_found_with_spans_and_edits(spark):
    index = L.Index.of(L.TEMPLATES)
    filler = " ".join(f"f{i}" for i in range(400))
    for name, text in L.TEMPLATES.items():
        hit = [m for m in L.scan(f"{filler} {text} {filler}", index) if m[0] == name]
        assert len(hit) == 1 and hit[0][1] == 1.0
        start, end = hit[0][3:]
        assert f"{filler} {text} {filler}"[start:end].strip('".') in text
    words = L.TEMPLATES["mit"].split()
    rng = random.Random(2)
    for i in rng.sample(range(len(words)), 6):
        words[i] = "changed"
    (hit,) = [m for m in L.scan(" ".join(words), index) if m[0] == "mit"]
    assert 0.85 < hit[1] < 1
    assert not L.scan(filler, index) and not L.scan("", index)
    twice = [m for m in L.scan("Released under the MIT License. and more words here. Released under the MIT License.", index) if m[0] == "mit-short"]
    assert len(twice) == 2
    docs = spark.createDataFrame([(1, None, "a"), (None, "Released under the MIT License.", "b"), (2, "", "c")], "doc_id long, text string, licence string")
    assert [(r.doc_id, r.licence) for r in L.licence_scan(docs).collect()] == [(None, "mit-short")]
    assert L.licence_scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.Index.of({"short": "word"})


def test_every_copy_within_coverage_is_found():
    """Up to a fifth of the words replaced, left out or added; against alignment at every diagonal."""
    index, rng = L.Index.of(L.TEMPLATES), random.Random(1)
    tried = 0
    for t, name in enumerate(index.names):
        words = L.words_of(L.TEMPLATES[name])
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(len(words) // 5 + 1)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = rng.choice([[], ["zebra"], ["the"]])
            text = ["quokka"] * 5 + copy + ["license", "quokka"]
            ids = [index.vocabulary.get(w, -1) for w in text]
            plain = max(L.align(words_ids, ids, d)[0] for words_ids in [index.words[t]] for d in range(-3, 9))
            found = [m for m in L.scan(" ".join(text), index) if m[0] == name]
            if plain >= L.COVERAGE * len(words) and len(copy) >= L.COVERAGE * len(words):
                tried += 1
                assert found and max(m[2] for m in found) >= L.COVERAGE * len(words), (name, copy)
            elif plain < L.COVERAGE * len(words):
                assert not found
    assert tried > 80


def test_overlapping_templates_and_very_long_texts():
    index = L.Index.of({"a": "one two three four five six", "b": "four five six seven eight nine"})
    assert [m[0] for m in L.scan("x one two three four five six seven eight nine x", index)] == ["a", "b"]
    text = "filler words here " * 200_000 + "Released under the MIT Licence."
    assert [m[0] for m in L.scan(text, L.Index.of(L.TEMPLATES))] == ["mit-short"]


def test_alignment_bands_match_plain_local_alignment():
    rng = random.Random(0)
    for _ in range(30):
        t = [rng.randrange(5) for _ in range(12)]
        x = t[:5] + [9] + t[6:]
        matched, a, z = L.align(t, [7, 7, *x, 8], 2)
        assert matched >= 10 and a == 2 and z == 2 + len(x) - 1


# Toxicity --------------------------------------------------------------------------------------
def test_field_finds_spans_and_separates_held_out_rows(spark):
    rng = random.Random(4)
    clean = [f"calm{i}" for i in range(200)]
    rude = ["vileword", "nastyword", "rudeword"]
    rows = []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(rude)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.1), (9999, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if out[i].held_out]
    assert 80 < len(held) < 160 and np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    text = dict((i, t) for i, t, _ in rows)
    spans = [text[i][s.start : s.end] for i in held if truth[i] for s in out[i].spans]
    assert spans and all(any(w in rude for w in s.split()) for s in spans)
    assert 0 <= out[None].score < 0.5 and out[None].score == out[9999].score and not out[None].held_out
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in T.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    model = T.Model(trans=rng.normal(size=(2, 2)), start=0.3)
    emits = [rng.normal(size=n) for n in (1, 4, 6, 0)]
    for e, p in zip(emits, T.marginals(emits, model), strict=True):
        total, ones = 0.0, np.zeros(len(e))
        for code in range(1 << len(e)):
            y = [code >> i & 1 for i in range(len(e))]
            s = sum(e[i] * y[i] for i in range(len(e))) + (model.start * y[0] if len(e) else 0)
            s += sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False))
            total += np.exp(s)
            ones += np.exp(s) * np.array(y)
        assert np.allclose(p, ones / total)


# Nearest neighbours ----------------------------------------------------------------------------
def test_neighbours_recall_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[600:900] = x[0]  # a large group of copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1500, None, 1), (1600, [0.0] * 16, 1), (1700, [float("nan")] * 16, 1), (1800, [1.0] * 15 + [None], 1), (1900, [1.0] * 3, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = {}
    for r in N.nearest(table).collect():
        out.setdefault(r.query_id, []).append(r)
    assert sorted(out) == list(range(0, 1500, 100))
    hits = 0
    for q, got in out.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), far)) if i != q][:10]
        got.sort(key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11)) and all(r.score == far[r.vec_id] for r in got)
        if q in (0, 600, 700, 800):
            assert [r.vec_id for r in got] == best
        hits += len({r.vec_id for r in got} & set(best))
    assert hits >= 0.9 * 150
    few = table.where("vec_id in (0, 1, 2)")
    assert [(r.query_id, r.rank) for r in N.nearest(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert N.nearest(table.limit(0)).count() == 0


def test_perturbations_come_in_order_of_their_cost():
    places = np.array([0.1, 5.5, 2.95])
    cells = N.perturbations(places, 12)
    inside = places - np.floor(places)

    def cost(c):
        d = c - np.floor(places)
        return sum((inside[i] if d[i] < 0 else 1 - inside[i]) ** 2 for i in range(3) if d[i])

    costs = [cost(c) for c in cells]
    assert costs == sorted(costs) and len({tuple(c) for c in cells}) == 12


# Fuzzy lines -----------------------------------------------------------------------------------
def slow_lines(rows):
    """Every pair of different lines by exact Jaccard, then components."""
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} or {x}
    places = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    first = {}
    for d, i, x in sorted(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        first.setdefault(x, (d, i))
    names = sorted(first)
    sets = [grams(x) for x in names]
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(names)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    keep = {}
    for i, x in enumerate(names):
        r = find(i)
        keep[r] = min(keep.get(r, first[x]), first[x], key=order)
    out = {}
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(lines) if not x.strip(" \t\n\v\f\r") or keep[find(names.index(x))] == (d, i))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(25)]

    def edited(line):
        w = line.split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        return " ".join(w)

    rows = [(i, "\n".join(rng.choice([edited(rng.choice(base)), rng.choice(base), "", " ", word()]) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "日本語のとても長い行はここにありますそして続きますまだ終わりません\n日本語のとても長い行はここにありますそして続きますまだ終わりませ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    want = slow_lines(rows)
    differ = [d for d in want if want[d] != got[d]]
    assert len(differ) <= 1, (differ, [(want[d], got[d]) for d in differ[:1]])  # banding may miss a pair at the threshold
    assert D.dedup_lines(docs).columns == docs.columns and D.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string")
    plan = D.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Mixing ----------------------------------------------------------------------------------------
def test_targets_fill_up_to_their_limit():
    got = M.targets({"a": 100, "b": 1000, "c": 10, None: 890})
    assert got["a"] == 300 and abs(sum(got.values()) - 2000) < 1e-9
    assert all(got[s] <= 3 * n for s, n in {"a": 100, "b": 1000, "c": 10, None: 890}.items())
    assert M.targets({}) == {} and M.targets({"z": 0}) == {"z": 0.0}
    assert M.targets({"a": 10, "b": 10, "c": 10}) == {"a": 18.75, "b": 7.5, "c": 3.75}


def test_pivotal_keeps_the_sum_and_the_means():
    rng = np.random.default_rng(0)
    p = rng.random(300)
    out = M.pivotal(p, rng)
    assert abs(out.sum() - p.sum()) < 1e-6 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
    p = np.array([0.3, 0.45, 0.9, 0.2])
    mean = np.mean([M.pivotal(p, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 120))), ["hot", "b", "c", None][min(3, int(rng.integers(0, 9)) // 2)]) for i in range(4000)]
    rows += [(4000, None, "b"), (None, "x y", "c"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = M.mix(docs).collect()
    assert len(out) == len(rows)
    taken, target, largest = {}, {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    for s in taken:
        assert abs(taken[s] - target[s]) <= 3 * largest[s] + 0.005 * target[s]
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    staged = M.mix_stage(docs)
    assert staged.columns == docs.columns and M.mix_stage(docs.limit(0)).count() == 0
    words = {}
    for r in staged.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert words == {s: t for s, t in taken.items() if t} or all(abs(words.get(s, 0) - t) <= 400 for s, t in taken.items())


# WARC ------------------------------------------------------------------------------------------
PAGES = [(3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, None, None), (5, "http://b", ""), (9, "http://é", "é" * 3000), (1, "http://a/2", "<p>same</p>"), (None, "http://n", "only"), (1, "http://odd\r\nurl", "another"), (1, "http://odd\nurl", "another")]


def test_archive_gives_back_every_record(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, sha256 string")
    archive = W.write_archive(pages)
    assert archive.payloads().count() == 5
    back = sorted((r.page_id or -1, repr(r.url), bytes(r.payload).decode()) for r in archive.originals().collect())
    assert back == sorted((p or -1, repr(u), h or "") for p, u, h in PAGES)
    every = [W.from_bytes(bytes(r.record))[0] for r in archive.records().collect()]
    assert len(every) == len({f["WARC-Record-ID"] for f in every}) == len(PAGES)
    assert all(f["WARC-Date"] and f["Content-Type"] for f in every)
    known = {f["WARC-Record-ID"]: f for f in every}
    for f in every:
        assert (f["WARC-Type"] == "revisit") == ("WARC-Refers-To" in f)
        if "WARC-Refers-To" in f:
            to = known[f["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
    for r in archive.records().collect():
        fields, block = W.from_bytes(bytes(r.record))
        assert fields["WARC-Type"] == r.record_type and (r.record_type == "response" or block == b"")
    digest = {(r.page_id, r.record_type): r for r in archive.digest().collect()}
    want = base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()
    assert digest[1, "response"].payload_digest == want and digest[3, "revisit"].refers_to == 1 and digest[1, "revisit"].refers_to == 1
    assert digest[2, "response"].payload_bytes == 0 and digest[5, "revisit"].refers_to == 2
    assert digest[9, "response"].payload_bytes == 6000 and digest[None, "response"].refers_to is None
    assert sum(1 for _ in archive.digest().collect()) == len(PAGES)
    assert W.write_archive(pages.limit(0)).digest().count() == 0
    kinds = [r.record_type for r in W.write_archive(pages, least_bytes=1).digest().where("payload_bytes = 0").collect()]
    assert kinds == ["response", "response"]


def test_base32_is_rfc_4648(spark):
    h = hashlib.sha1(b"x").hexdigest()
    got = spark.createDataFrame([(h,)], "h string").select(W.base32(__import__("pyspark.sql.functions", fromlist=["x"]).col("h")).alias("b")).first().b
    assert got == base64.b32encode(bytes.fromhex(h)).decode()
