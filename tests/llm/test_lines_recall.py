"""Line dedup finds copies among few-word lines, unspaced lines and large groups of variants."""

import random

from tidemark.llm import lines as D

from .test_other_ops import slow_lines


def _word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))


def _grams(x):
    return {x[i : i + 5] for i in range(len(x) - 4)} or {x}


def _same(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}, slow_lines(rows)
    return [d for d in want if got[d] != want[d]], sum(t == "" for t in want.values())


def test_few_word_and_unspaced_lines_with_one_edit_are_found(spark):
    rng = random.Random(3)
    texts = []
    while len(texts) < 600:
        if len(texts) % 6 == 0:
            line = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(12, 60)))
        else:
            line = " ".join(_word(rng) for _ in range(rng.randrange(3, 9)))
        at = rng.choice([0, rng.randrange(len(line)), len(line) - 1])
        copy = line[:at] + rng.choice("xyz") + line[at + rng.randrange(2) :]
        a, b = _grams(line), _grams(copy)
        if len(a & b) >= 0.8 * len(a | b):
            texts += [line, copy]
    differ, dropped = _same(spark, texts)
    assert dropped >= 300 and not differ


def test_large_groups_of_variants_keep_every_link(spark):
    rng = random.Random(5)
    texts = []
    for n_words, changed, n in ((30, 2, 400), (12, 1, 200)):
        base = [_word(rng) for _ in range(n_words)]
        for _ in range(n):
            words = list(base)
            for i in rng.sample(range(n_words), changed):
                words[i] = _word(rng)
            texts.append(" ".join(words))
    differ, dropped = _same(spark, texts)
    assert dropped >= 300 and not differ
