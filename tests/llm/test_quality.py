import pyspark.sql.functions as F

from tidemark.llm import quality as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    inside = set()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 4, "x y\nx y\n\n \nx y", "é ü # ** <p> | ok", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8 z", "a\xa0b　c", "k " * 30_000]


def test_statistics_match_brute_force():
    for t in TEXTS[:-1]:
        assert Q.text_stats(t or "") == brute(t)
    assert Q.text_stats(TEXTS[-1])[4] == 30_000


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(i if i else None, t, None, None, None, "clash") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(docs, none).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert Q.quality_rules(docs.limit(0), none).count() == 0
    kept = Q.filter_stage(docs, none)
    assert kept.columns == docs.columns


def test_learned_list_rejects_decorated_texts(spark):
    good = [(i, " ".join(f"word{j}x{i}" for j in range(60))) for i in range(120)]
    bad = [(1000 + i, " ".join(f"word{j}x{i}###" for j in range(60))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    rules = Q.fit(docs, labels)
    assert rules and "CASE WHEN" in Q.rules_sql(rules)
    out = {r.doc_id: r.kept for r in Q.quality_rules(docs, labels).collect()}
    assert all(out[i] == (i < 1000) for i in out)
    assert Q.filter_stage(docs, labels).agg(F.max("doc_id")).first()[0] < 1000
