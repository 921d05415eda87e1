"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) over the words of a text. Emissions sum the weights of a word's own
features (the word, its beginnings and endings); transitions are a 2x2 table. Token labels come from
document labels: words of toxic documents whose features are far more frequent in toxic than in
clean ones. Training maximizes the penalized likelihood with exact forward-backward gradients.
Marginals of the whole text give the document's score and the offsets of offending words.

In a two-state chain the forward and backward messages are one number each (the ratio of the states),
so many texts go through the recursion side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Most labelled rows of each class that the model is learned from: smallest hash of doc_id first.
FIT_TOXIC = 800
FIT_CLEAN = 1600
#: Words in a training segment; whole texts are cut into segments, none is left out.
SEGMENT = 256
MOST_FEATURES = 20_000
#: Share of the toxic rows that a feature must occur in, and the log odds that mark a word as toxic.
LEAST_SHARE = 0.02
STRONG = 2.5
#: Words remembered in one Python worker.
REMEMBERED = 300_000

STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_~`"


def word_features(word: str) -> list[str]:
    """Features of one lower-case word without surrounding punctuation."""
    out = [f"w:{word}"]
    for k in (3, 4, 5):
        if len(word) > k:
            out += [f"p:{word[:k]}", f"s:{word[-k:]}"]
    return out


def words_of(text: str) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()]


def _messages(emit: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic/clean of the forward and backward messages. emit: [T, B], log ratios."""
    t00, t01, t10, t11 = np.exp(trans).ravel()
    e = np.exp(np.clip(emit, -30, 30))
    r, b = np.empty_like(e), np.empty_like(e)
    if len(e) == 0:
        return r, b
    r[0] = e[0] * np.exp(start)
    for t in range(1, len(e)):
        p = r[t - 1]
        r[t] = e[t] * (t01 + p * t11) / (t00 + p * t10)
    b[-1] = 1.0
    for t in range(len(e) - 2, -1, -1):
        q = e[t + 1] * b[t + 1]
        b[t] = (t10 + t11 * q) / (t00 + t01 * q)
    return r, b


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in word_features(word)) if word else self.bias


class Emissions(dict):
    """Emission of each word, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> float:
        got = self.model.emission(raw.strip(STRIP))
        if len(self) < REMEMBERED:
            self[raw] = got
        return got


def marginals(emits: list[np.ndarray], model: Model, cells: int = 1 << 20) -> list[np.ndarray]:
    """P(toxic) of every word of every text, by forward-backward over whole texts."""
    out: list[np.ndarray] = [np.zeros(0)] * len(emits)
    order = sorted((i for i in range(len(emits)) if len(emits[i])), key=lambda i: -len(emits[i]))
    at = 0
    while at < len(order):
        longest = len(emits[order[at]])
        pack = order[at : at + max(1, min(512, cells // longest))]
        at += len(pack)
        e = np.full((longest, len(pack)), -30.0)
        for k, i in enumerate(pack):  # padding goes before the text: it is clean for sure, and the start of the chain takes its place below
            e[longest - len(emits[i]) :, k] = emits[i]
        lengths = np.array([len(emits[i]) for i in pack])
        first = longest - lengths
        r, b = _aligned(e, first, model)
        p = r * b
        p /= 1 + p
        for k, i in enumerate(pack):
            out[i] = p[first[k] :, k]
    return out


def _aligned(e: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """As _messages, with texts that begin at row ``first`` of their column (ascending)."""
    t00, t01, t10, t11 = np.exp(model.trans).ravel()
    x = np.exp(np.clip(e, -30, 30))
    begin = np.exp(model.start)
    r, b = np.zeros_like(x), np.zeros_like(x)
    lanes = np.searchsorted(first, np.arange(len(x)), "right")  # texts under way at each row
    done = 0
    for t in range(len(x)):
        n = lanes[t]
        if done:
            p = r[t - 1, :done]
            r[t, :done] = x[t, :done] * (t01 + p * t11) / (t00 + p * t10)
        if n > done:
            r[t, done:n] = x[t, done:n] * begin
            done = n
    b[-1] = 1.0
    for t in range(len(x) - 2, -1, -1):
        n = lanes[t]
        q = x[t + 1, :n] * b[t + 1, :n]
        b[t, :n] = (t10 + t11 * q) / (t00 + t01 * q)
    return r, b


def _document_features(p: np.ndarray) -> tuple[float, float]:
    """What the document's score is made of: the surest word, and how much toxic mass there is."""
    if not len(p):
        return -12.0, 0.0
    top = float(np.clip(p.max(), 6e-6, 1 - 6e-6))
    return float(np.log(top / (1 - top))), float(np.log1p(p.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def token_labels(texts: list[list[str]], toxic: list[bool]) -> tuple[list[np.ndarray], dict[str, int]]:
    """Labels of the words of each text, and the features kept (with their column)."""
    df = [Counter(), Counter()]
    for words, t in zip(texts, toxic, strict=True):
        df[t].update({f for w in set(words) if w for f in word_features(w)})
    n = [max(1, toxic.count(False)), max(1, toxic.count(True))]
    least = max(4, LEAST_SHARE * n[1])
    odds = {f: np.log((c + 0.25) / (n[1] + 0.5)) - np.log((df[0][f] + 0.25) / (n[0] + 0.5)) for f, c in df[1].items() if c >= least}
    kept = dict(sorted(((f, o) for f, o in odds.items() if abs(o) >= 1), key=lambda p: (-abs(p[1]) * np.sqrt(df[1][p[0]]), p[0]))[:MOST_FEATURES])
    strength: dict[str, float] = {}

    def strong(word: str) -> float:
        if word not in strength:
            strength[word] = max((odds[f] for f in word_features(word) if f in odds), default=-1.0)
        return strength[word]

    labels = []
    for words, t in zip(texts, toxic, strict=True):
        y = np.array([strong(w) > STRONG for w in words], bool) if t else np.zeros(len(words), bool)
        labels.append(y)
    return labels, {f: i for i, f in enumerate(kept)}


def train(texts: list[str], toxic: list[bool], rounds: int = 50, l2: float = 1.0) -> Model:
    """Fit the field and the document scores; one class or no rows give a model that says clean."""
    if len(set(toxic)) < 2:
        return Model()
    tokens = [words_of(t) for t in texts]
    labels, index = token_labels(tokens, toxic)
    vocab: dict[str, int] = {}
    rows, cols = [], []

    def word_id(w: str) -> int:
        if w not in vocab:
            vocab[w] = len(vocab)
            if w:
                for f in word_features(w):
                    if f in index:
                        rows.append(vocab[w])
                        cols.append(index[f])
        return vocab[w]

    ids, ys = [], []
    for words, y in zip(tokens, labels, strict=True):
        every = [word_id(w) for w in words]
        for i in range(0, len(every), SEGMENT):
            ids.append(every[i : i + SEGMENT])
            ys.append(y[i : i + SEGMENT])
    width = max(map(len, ids))
    x, y, mask = np.zeros((width, len(ids)), np.int64), np.zeros((width, len(ids))), np.zeros((width, len(ids)), bool)
    for k, (i, t) in enumerate(zip(ids, ys, strict=True)):
        x[: len(i), k], y[: len(i), k], mask[: len(i), k] = i, t, True
    r_, c_ = np.array(rows, np.int64), np.array(cols, np.int64)
    n_f, n_w = len(index), len(vocab)
    theta = np.zeros(n_f + 6)  # features, bias, start, 4 transitions
    theta[n_f] = -5.0
    seen = np.zeros_like(theta)
    flat = x[mask]
    pair = mask[1:] & mask[:-1]
    y0, y1 = y[:-1][pair], y[1:][pair]
    gold = np.array([((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum(), (y0 * (1 - y1)).sum(), (y0 * y1).sum()])
    for _ in range(rounds):
        word = theta[n_f] + np.bincount(r_, theta[c_], n_w) if len(r_) else np.full(n_w, theta[n_f])
        emit = np.where(mask, word[x], -30.0)
        trans, start = theta[n_f + 2 :].reshape(2, 2), theta[n_f + 1]
        r, b = _messages(emit, trans, start)
        p = r * b / (1 + r * b)
        diff = np.where(mask, y - p, 0.0)
        per_word = np.bincount(flat, diff[mask], n_w)
        g = np.zeros_like(theta)
        if len(r_):
            g[:n_f] = np.bincount(c_, per_word[r_], n_f)
        g[n_f], g[n_f + 1] = diff.sum(), diff[0].sum()
        t00, t01, t10, t11 = np.exp(trans).ravel()
        q = np.exp(np.clip(emit[1:], -30, 30)) * b[1:]
        joint = np.stack([np.full_like(q, t00), t01 * q, t10 * r[:-1], t11 * r[:-1] * q])
        joint /= joint.sum(0)
        g[n_f + 2 :] = gold - joint[:, pair].sum(1)
        g[:n_f] -= l2 * theta[:n_f]
        g[n_f + 2 :] -= theta[n_f + 2 :]
        seen += g * g
        theta += 0.5 * g / np.sqrt(seen + 1e-8)
    model = Model({f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}, float(theta[n_f]), theta[n_f + 2 :].reshape(2, 2).copy(), float(theta[n_f + 1]))
    emissions = Emissions(model)
    ps = marginals([np.array([emissions[w] for w in words]) for words in tokens], model)
    z = np.array([(1.0, *_document_features(p)) for p in ps])
    model.document = _logistic(z, np.array(toxic, float))
    return model


def score_texts(texts: list[str], model: Model, emissions: Emissions) -> list[tuple[float, np.ndarray]]:
    """(score, marginals of its words) of each text."""
    emits = [np.fromiter(map(emissions.__getitem__, t.lower().split()), float) for t in texts]
    ps = marginals(emits, model)
    z = np.array([(1.0, *_document_features(p)) for p in ps]).reshape(-1, 3)
    return list(zip((1 / (1 + np.exp(-np.clip(z @ model.document, -30, 30)))).tolist(), ps, strict=True))


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0; bounded by the two limits.

    Labels of a doc_id that disagree count as toxic; null ids and labels teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    picked = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_toxic).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_clean)).collect()  # bounded by the limits
    if not picked:
        return Model()
    few = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").collect()  # bounded by the limits
    first = {r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""), reverse=True)}
    rows = [first[k] for k in sorted(first)]
    return train([r.text or "" for r in rows], [r.toxic == 1 for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_words and spans for every row of ``docs``.

    spans holds [start, end) character offsets of words whose marginal reaches ``threshold``. Null
    and empty texts get the score of a text without words. Repeated rows are rows each; a null doc_id
    is not held out. Nothing but the text enters a score.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                texts = [x.as_py() or "" for x in column(part, "text")]
                scores, counts, spans = [], [], []
                for text, (score, p) in zip(texts, score_texts(texts, model, emissions), strict=True):
                    bad = np.flatnonzero(p >= threshold)
                    scores.append(score)
                    counts.append(len(bad))
                    spans.append(_spans(text, bad) if len(bad) else [])
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "score", "n_toxic_words", "spans"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_toxic_words long, spans array<struct<start: long, end: long>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words", "spans")


def _spans(text: str, bad: np.ndarray) -> list[dict[str, int]]:
    """Offsets of the words numbered in ``bad``; neighbours make one span."""
    lowered = text.lower()
    source = text if len(lowered) == len(text) else lowered  # offsets are of the text itself but for the few letters that lower() lengthens
    wanted, out, before = set(bad.tolist()), [], -2
    for k, m in enumerate(_iter_words(source)):
        if k in wanted:
            if k == before + 1:
                out[-1]["end"] = m[1]
            else:
                out.append({"start": m[0], "end": m[1]})
            before = k
    return out


def _iter_words(text: str) -> Iterator[tuple[int, int]]:
    """Places of the words that str.split() gives."""
    at = 0
    for w in text.split():
        at = text.index(w, at)
        yield at, at + len(w)
        at += len(w)
