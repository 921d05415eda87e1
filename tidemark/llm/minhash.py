"""MinHash near-duplicates with tensored banding.

Two collections of ``COLLECTION`` half keys, each of ``HALF`` MinHash values, are computed for a text.
A table is a pair of half keys, one of each collection, so that 28 half keys (84 MinHash values) serve
196 tables of six values each; untensored these would take 1,176. A pair of similarity s meets in some
table with probability (1 - (1 - s^3)^14)^2: at 0.85 all but 3 in a million, at 0.2 one in a hundred.

1. Texts of one set of shingles are one node (128-bit digest), whatever their number.
2. In each half-key bucket the members are held against one hub, the member that shares half keys with
   most texts: a group of near copies of one text comes together with work in proportion to its size.
3. What is then still apart and has both half keys in common with something else enters the tables. Rows
   of tables that hold two components meet, for each first half key, in blocks of ``BLOCK`` rows by ``BLOCK``:
   a pair counts if it has a second half key in common too, that is, a table; sizes and sketches decide
   which are verified. A large bucket becomes several tasks, and a pair comes once, whatever it shares.
4. Every candidate is verified on the full sets of both texts; links are joined by union-find.

A sketch has one byte of the smallest hash in each of 512 parts of the hash range. Equal bytes among the
parts that either set occupies estimate the similarity; a pair is verified from ``DEVIATIONS`` standard
deviations below 0.85 on (fewer than one linked pair in ten million is lower). The parts draw from the
union without repeats, so of short texts, whose sketch is almost the whole set, few other pairs pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written
from .components import connected_components

SHINGLE = 3
#: A link has 100 * intersection >= LEAST * union.
LEAST = 85
COLLECTION = 14
HALF = 3
VALUES = 2 * COLLECTION * HALF
#: Parts that the hash range is cut into for a sketch: one byte of the smallest hash of each part.
PARTS = 512
#: Standard deviations below what a pair at LEAST has, down to which pairs are verified.
DEVIATIONS = 5.5
#: Rows of a bucket that meet in one task at a time, and shingles of the sets that one task holds of each side.
BLOCK = 8192
HELD = 4_000_000
#: Words whose hash a Python worker remembers.
REMEMBERED = 1_000_000

_RNG = np.random.default_rng(12)
_MIX = _RNG.integers(1, 1 << 63, SHINGLE + 2, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = (_RNG.integers(1, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_ADD = _RNG.integers(0, 1 << 63, VALUES, np.uint64)[:, None]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    n = min(len(words), shingle)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        x += h[i : len(h) - n + 1 + i] * _MIX[i % SHINGLE] + np.uint64(i // SHINGLE)
        x ^= x >> np.uint64(31)
        x *= _MIX[SHINGLE]
    x ^= x >> np.uint64(29)
    x *= _MIX[SHINGLE + 1]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def min_values(hashes: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set of at least one hash."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[None, i : i + 2048] * _MULTIPLY + _ADD).min(1), out=out)
    return out


def sketch_of(hashes: np.ndarray) -> bytes:
    """PARTS bytes: 0 for a part of the hash range without a hash, else 1 to 255 of its smallest one."""
    begins = np.searchsorted(hashes, np.arange(PARTS, dtype=np.uint64) << np.uint64(64 - 9))
    found = np.append(hashes, np.uint64(0))[begins]
    there = (found >> np.uint64(64 - 9)) == np.arange(PARTS, dtype=np.uint64)
    there &= begins < len(hashes)
    return np.where(there, found % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def alike(u: np.ndarray, v: np.ndarray, m: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Which rows of two sketch tables, of sets of m and n shingles, may be linked.

    A part's smallest hash is one of the union's: the parts that are filled draw as many shingles of the
    union without repeats. At the limit the union has (m + n) / (1 + least) shingles.
    """
    filled = ((u | v) != 0).sum(1)
    equal = ((u == v) & (u != 0)).sum(1)
    p = least / 100
    union = np.maximum((m + n) / (1 + p), 2.0)
    left = np.clip((union - filled) / (union - 1), 0.0, 1.0)
    return equal >= p * filled - DEVIATIONS * np.sqrt(p * (1 - p) * filled * left) - 1


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sets have 100 * intersection >= least * union."""
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """Each row with its set's size, digest (null if empty), half keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, keys, sketch = [], [], [], []
            for x in column(b, "text"):
                s = shingle_set(x.as_py() or "", shingle)
                size.append(len(s))
                if not len(s):
                    digest.append(None), keys.append(None), sketch.append(None)
                    continue
                v = min_values(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append([xxhash.xxh64_intdigest(v[i : i + HALF].tobytes(), i) - (1 << 63) for i in range(0, VALUES, HALF)])
                sketch.append(sketch_of(s))
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in ("doc_id", "id", "check")], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "id", "check", "n_shingles", "node", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, id long, check long, n_shingles long, node binary, keys array<long>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The (a, b) of ``pairs`` (a stored table) whose full sets are linked; ``texts`` has (node, text).

    Nodes are dealt to blocks of about ``HELD`` shingles by hash; a pair goes to the cell of its two
    blocks, and with it, once for each cell, the texts that its pairs need. A task holds the sets of one
    cell. A hub is in as many cells as there are blocks, whatever its number of partners.
    """
    total = nodes.join(texts.select("node"), "node", "left_semi").agg(F.sum("n_shingles")).first()[0] or 0
    blocks = F.lit(max(1, -(-int(total) // HELD)))
    side = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    dealt = pairs.select("a", "b", side("a").alias("i"), side("b").alias("j"))
    asked = dealt.select("i", "j", F.col("a").alias("node")).union(dealt.select("i", "j", "b")).distinct()
    none = F.lit(None).cast("binary")
    rows = asked.join(texts, "node").select("i", "j", F.col("node").alias("a"), none.alias("b"), "text").union(dealt.select("i", "j", "a", "b", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            cols = [column(batch, c).to_pylist() for c in ("i", "j", "a", "b")]
            for i, j, a, b, x in zip(*cols, column(batch, "text"), strict=True):
                if (i, j) != cell:
                    cell = (i, j)
                    sets.clear()
                if b is None:
                    sets[a] = shingle_set(x.as_py() or "", shingle)
                elif linked(sets[a], sets[b], least):
                    out.append((a, b))
            yield _edges(out)

    return rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("b").asc_nulls_first()).mapInArrow(run, "a binary, b binary")


class _Block:
    """Rows of a bucket as arrays."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.component = np.array([r[1] for r in rows], object)
        self.size = np.array([r[2] for r in rows])
        self.sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, PARTS)
        self.keys = np.array([r[4] for r in rows], np.int64).reshape(-1, 2 * COLLECTION)


def _apart(rows: _Block, others: _Block, bucket: int, least: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs (smaller node, larger node) of two blocks of a bucket that share a table whose first half key is
    the bucket's, are in different components, and are near in size and sketch. A pair that shares several
    buckets comes from the first of them."""
    for i, (node, component, n, _, _) in enumerate(rows.rows):
        near = ((100 * np.minimum(others.size, n) >= least * np.maximum(others.size, n)) & (others.component != component)).nonzero()[0]
        near = near[alike(others.sketch[near], rows.sketch[i][None], others.size[near], np.float64(n), least)]
        same = others.keys[near] == rows.keys[i]
        for j in near[(same[:, :COLLECTION].argmax(1) == bucket) & same[:, COLLECTION:].any(1)].tolist():
            other = others.rows[j][0]
            yield (node, other) if node < other else (other, node)


def _met(members: DataFrame, least: int) -> DataFrame:
    """Distinct (a, b) that share a table, are in different components and may be linked.

    ``members`` has (t, key, node, component, n_shingles, sketch, keys), a row for each bucket of a first
    half key. Rows of a bucket are dealt to blocks by hash; each pair of blocks is a group of its own, in
    which the first block is held and the second passes by.
    """
    many = members.groupBy("t", "key").agg(F.ceil(F.count("*") / (BLOCK / 2)).cast("int").alias("blocks"))
    own = members.join(many, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell_of = ["t", "key", "i", "j"]
    cells = spread.select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "node", "component", "n_shingles", "sketch", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, first, passing = None, [], []

        def close() -> list[tuple[bytes, bytes]]:
            if not first or not (passing or cell[2] == cell[3]):
                passing.clear()
                return []
            held = _Block(first)
            found = list({*_apart(_Block(passing) if passing else held, held, cell[0], least)})
            passing.clear()
            return found

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            cols = [column(batch, c).to_pylist() for c in (*cell_of, "second", "node", "component", "n_shingles", "sketch", "keys")]
            for t, key, i, j, second, *row in zip(*cols, strict=True):
                if (t, key, i, j) != cell:
                    out += close()
                    cell = (t, key, i, j)
                    first.clear()
                (passing if second else first).append(tuple(row))
                if len(passing) >= BLOCK:
                    out += close()
            yield _edges(out)
        yield _edges(close())

    return cells.repartition(*cell_of).sortWithinPartitions(*cell_of, "second").mapInArrow(run, "a binary, b binary")


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    component_id is the smallest doc_id that links reach, kept whether it is the row's own. A text's set
    is its distinct shingles of ``shingle`` words; fewer words are one shingle. Texts that are null, empty
    or white space have no shingle, link with nothing and are kept. A null doc_id keeps its row; its
    component_id is the smallest that it reaches (null, and kept, if there is none). Repeated rows each
    give a row, and all are kept if their doc_id is the component's. An empty table gives an empty one;
    other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("id"), F.xxhash64(F.lit(1), text).alias("check"), text.alias("text"))
    signed = written(_signed(rows, shingle), "minhash")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id", "check")
    nodes = written(signed.where("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("row"), *[F.any_value(c).alias(c) for c in ("n_shingles", "keys", "sketch")]), "nodes")

    # Half keys that two nodes share; a node goes on if it shares one of each collection.
    halves = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    shared = halves.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    half = written(halves.join(shared, ["t", "key"]), "halves")
    both = (F.min("t") < COLLECTION) & (F.max("t") >= COLLECTION)
    going = written(half.groupBy("node").agg(both.alias("both"), F.sum("n").alias("met")).where("both").select("node", "met"), "going")
    wanted = nodes.join(going, "node").select("node", F.col("row.doc_id").alias("d"), F.col("row.id").alias("id"), F.col("row.check").alias("check"))
    same = (rows["id"] == wanted["id"]) & (rows["check"] == wanted["check"]) & rows["doc_id"].eqNullSafe(wanted["d"])
    texts = written(rows.join(wanted, same).select("node", "text"), "texts")

    # Hubs first.
    central = half.join(going, "node")
    hubs = central.groupBy("t", "key").agg(F.max_by("node", F.struct("met", "node")).alias("a"))
    stars = central.join(hubs, ["t", "key"]).where("node != a").select("a", F.col("node").alias("b")).distinct()
    links = written(verified(written(_like(stars, nodes, least), "stars"), texts, nodes, shingle, least), "links")
    parts = written(connected_components(links), "parts")

    # Then the tables, for what is still apart.
    placed = half.drop("hub").join(going, "node").join(parts.withColumnRenamed("node", "part"), F.col("node") == F.col("part"), "left").drop("part").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("t", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("t", "key")
    lists = placed.join(mixed, ["t", "key"]).groupBy("node", "component").agg(F.collect_list(F.struct("t", "key")).alias("keys"))  # 28 at most
    sides = [F.filter("keys", lambda x: x["t"] < COLLECTION), F.filter("keys", lambda x: x["t"] >= COLLECTION)]
    tables = lists.select("node", "component", F.explode(sides[0]).alias("x"), sides[1].alias("ys")).select("node", "component", "x", F.explode("ys").alias("y"))
    entered = written(tables.select(F.xxhash64("x.t", "x.key", "y.t", "y.key").alias("table"), "node", "component", "x.t", "x.key"), "tables")
    open_ = entered.groupBy("table").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("table")
    members = entered.join(open_, "table").select("t", "key", "node", "component").distinct().join(nodes.select("node", "n_shingles", "sketch", "keys"), "node")
    more = verified(written(_met(members, least), "met"), texts, nodes, shingle, least)
    parts = connected_components(written(links.union(more), "links"))

    firsts = nodes.select("node", F.col("row.doc_id").alias("first"))
    placed = parts.join(firsts, "node")
    smallest = placed.groupBy("component").agg(F.min("first").alias("least"))
    named = firsts.join(placed.join(smallest, "component").select("node", "least"), "node", "left")
    component = F.coalesce("least", "first", "doc_id")
    result = lambda df, c: df.select("doc_id", "n_shingles", c.alias("component_id"), F.col("doc_id").eqNullSafe(c).alias("kept"))
    empty = result(signed.where("node IS NULL"), F.col("doc_id"))
    return result(signed.where("node IS NOT NULL").join(named, "node"), component).union(empty)


def _like(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint8).reshape(-1, PARTS) for c in ("su", "sv"))
            m, n = (column(b, c).to_numpy() for c in ("m", "n"))
            keep = pa.array(alike(u, v, m, n, least) & (100 * np.minimum(m, n) >= least * np.maximum(m, n)))
            yield pa.RecordBatch.from_arrays([column(b, c).filter(keep) for c in ("a", "b")], ["a", "b"])

    side = lambda c, n, s: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(n), F.col("sketch").alias(s))
    return pairs.join(side("a", "m", "su"), "a").join(side("b", "n", "sv"), "b").mapInArrow(run, "a binary, b binary")
