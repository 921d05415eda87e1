"""Quality rules: learned decision lists.

Sequential covering grows conjunctions of thresholds on text statistics from labelled rows, prunes
each on rows that it was not grown on, removes what it covers and goes on. The rules come out as one
ordered Spark conditional expression, so scoring needs no Python besides the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

STATS_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

#: Statistics that rules may test, as SQL over the columns of ``document_stats``. Ratios use at
#: least 1 as their denominator, so that empty texts have defined values.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "word_chars / CAST(greatest(n_words, 1) AS DOUBLE)",
    "symbols_per_word": "n_symbols / CAST(greatest(n_words, 1) AS DOUBLE)",
    "dup_lines_per_word": "n_dup_lines / CAST(greatest(n_words, 1) AS DOUBLE)",
    "repeat_share": "n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE)",
}

#: Most labelled rows that a list is learned from; those with the smallest hash of doc_id.
FIT_ROWS = 10_000

#: Most thresholds of one statistic that a step of growing a rule tries; they are spread evenly over all.
CUTS = 128


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in ``words``, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:n].copy()
    for i in range(1, window):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += h[i : i + n]
    ordered = np.sort(mixed)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    seen: dict[tuple, list[int]] = {}  # exact: equal hashes only nominate
    for i in np.flatnonzero(np.isin(mixed, ordered[1:][same])).tolist():
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            edge[at] += 1
            edge[np.add(at, window)] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blank = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return len(words), len(text) - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the five statistics of the whole text.

    A null or empty text has zeros throughout; a null id stays null; repeated rows each give a row;
    other columns are not read, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(x.as_py() or "") for x in column(b, "text")]
            cols = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(np.ascontiguousarray(cols[:, i])) for i in range(5))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STATS_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D)"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut


def _holds(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _cuts(v: np.ndarray) -> np.ndarray:
    u = np.unique(v)
    if len(u) < 2:
        return u[:0]
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= CUTS else mid[np.linspace(0, len(mid) - 1, CUTS).astype(int)]


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> list[Test]:
    """Add the test of the most information gain until no negative is covered or none gains."""
    rule: list[Test] = []
    inside = np.ones(len(y), bool)
    while len(rule) < longest:
        p0, n0 = float(y[inside].sum()), float((~y[inside]).sum())
        if not n0 or not p0:
            break
        best, best_gain = None, 1e-9
        before = np.log2(p0 / (p0 + n0))
        for f in FEATURES:
            v, t = x[f][inside], y[inside]
            order = np.argsort(v, kind="stable")
            vs, cum = v[order], np.concatenate([[0], np.cumsum(t[order])]).astype(float)
            for c in _cuts(v):
                k = int(np.searchsorted(vs, c, "right"))
                for above, pos, size in ((False, cum[k], k), (True, p0 - cum[k], len(vs) - k)):
                    if pos and (gain := pos * (np.log2(pos / size) - before)) > best_gain:
                        best, best_gain = Test(f, above, float(c)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Test], x: dict[str, np.ndarray], y: np.ndarray) -> list[Test]:
    """The leading part of the rule that does best on rows that it was not grown on."""

    def worth(r: list[Test]) -> float:
        h = _holds(r, x, len(y))
        p, n = float(y[h].sum()), float((~y[h]).sum())
        return (p - n) / (p + n + 1)

    return max((rule[: k + 1] for k in range(len(rule))), key=worth, default=[])


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, longest: int = 3, most: int = 12, least: int = 3, seed: int = 7) -> list[list[Test]]:
    """An ordered list of rules that each reject; what no rule covers is kept.

    A rule is taken while on the rows not yet covered at least ``precision`` of what it covers is
    bad and it covers ``least`` bad rows. No rows, or one class only, give an empty list.
    """
    n = len(bad)
    rules: list[list[Test]] = []
    left = np.ones(n, bool)
    rng = np.random.default_rng(seed)
    while len(rules) < most and bad[left].sum() >= least:
        at = rng.permutation(np.flatnonzero(left))
        g, p = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        rule = _prune(_grow({f: v[g] for f, v in x.items()}, bad[g], longest), {f: v[p] for f, v in x.items()}, bad[p])
        h = _holds(rule, x, n) & left
        if not rule or bad[h].sum() < least or bad[h].mean() < precision:
            break
        rules.append(rule)
        left &= ~h
    return rules


def rules_sql(rules: list[list[Test]]) -> str:
    """The list as one ordered SQL conditional: true keeps."""
    if not rules:
        return "true"
    return "CASE " + " ".join(f"WHEN {' AND '.join(t.sql() for t in r)} THEN false" for r in rules) + " ELSE true END"


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[list[Test]]:
    """Learn from at most ``fit_rows`` labelled rows (smallest hash of doc_id, then doc_id).

    Rows with a null doc_id or label teach nothing. ``quality`` 0 is what rules reject.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()  # bounded by fit_rows
    if not sample:
        return []
    spark = docs.sparkSession
    few = spark.createDataFrame([(r.doc_id, r.quality) for r in sample], "doc_id long, quality int")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi")
    got = document_stats(read).dropDuplicates(["doc_id"]).selectExpr("doc_id", *(f"{sql} AS {f}" for f, sql in FEATURES.items())).toPandas()  # bounded by fit_rows
    got = got.sort_values("doc_id")
    truth = {r.doc_id: r.quality for r in sample}
    return learn_rules({f: got[f].to_numpy(float) for f in FEATURES}, np.array([truth[i] == 0 for i in got["doc_id"]], bool))


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rules: list[list[Test]] | None = None) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of ``docs``.

    ``kept`` is false where the base rule fails, else what the learned list says. Nulls, empty
    texts, repeated rows and extra columns: see ``document_stats``. Without labels every row that
    passes the base rule is kept.
    """
    if rules is None:
        rules = fit(docs, labels, fit_rows)
    return document_stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", F.expr(f"NOT base_failed AND ({rules_sql(rules)})"))


def filter_stage(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns kept.

    Statistics and verdict go on one pass beside the row, so nothing is joined or shuffled.
    """
    rules = fit(docs, labels, fit_rows)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = np.array([text_stats(x.as_py() or "") for x in column(b, "text")], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([column(b, "row"), *(pa.array(np.ascontiguousarray(cols[:, i])) for i in range(5))], ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    schema = packed.select("row").schema
    for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(f, "long")
    judged = packed.mapInArrow(run, schema).withColumn("base_failed", base_failed()).where(F.expr(f"NOT base_failed AND ({rules_sql(rules)})"))
    return judged.select("row.*")
