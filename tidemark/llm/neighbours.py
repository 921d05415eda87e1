"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to floor((a.x + b) / w) for several Gaussian a. A query visits its own
bucket and perturbed ones, in the order of their estimated success: the smaller the sum of squared
distances to the cell walls that a perturbation crosses, the earlier (Lv et al., Multi-Probe LSH,
2007). Candidates of all tables merge, and exact double-precision distances rank them.

Equal vectors are one row throughout, with the smallest ids of their group, so a group of copies of
any size costs as much as one vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written

#: Most vectors that the hash functions are fitted to; every vector is indexed.
FIT_ROWS = 4_000
TABLES = 12
PROBES = 40
#: Share of neighbours that the buckets should hold in the sample; the number of hashes follows.
GOAL = 0.95
#: Queries in a block: their vectors and buckets go with the tasks.
BLOCK = 512


@dataclass(frozen=True)
class Hashes:
    """a: [tables, hashes, dimensions]; b: [tables, hashes]; cell width w."""

    a: np.ndarray
    b: np.ndarray
    w: float

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("thd,nd->nth", self.a, x, optimize=True) / self.w + self.b

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for each row of cells [..., hashes]."""
        h = np.zeros(cells.shape[:-1], np.uint64)
        for i in range(cells.shape[-1]):
            h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def perturbations(places: np.ndarray, probes: int) -> np.ndarray:
    """Cells [probes, hashes] to visit for one query's places in one table, likeliest first."""
    cells = np.floor(places).astype(np.int64)
    inside = places - cells
    k = len(cells)
    walls = np.concatenate([inside, 1 - inside]) ** 2  # cross down, cross up
    order = np.argsort(walls, kind="stable")
    cost = walls[order]
    out = [cells]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(cost[0]), (0,))]
    while heap and len(out) < probes:
        c, s = heapq.heappop(heap)
        moved = order[list(s)]
        if len({int(m) % k for m in moved}) == len(s):  # not down and up on the same hash
            at = cells.copy()
            for m in moved.tolist():
                at[m % k] += -1 if m < k else 1
            out.append(at)
        last = s[-1] + 1
        if last < 2 * k:
            heapq.heappush(heap, (c - float(cost[s[-1]]) + float(cost[last]), (*s[:-1], last)))
            heapq.heappush(heap, (c + float(cost[last]), (*s, last)))
    return np.array(out)


def recall(hashes: Hashes, vectors: np.ndarray, asked: np.ndarray, probes: int, k: int = 10) -> float:
    """Share of the exact k nearest (others than itself) of each asked row that the buckets hold."""
    keys = hashes.keys(np.floor(hashes.places(vectors)).astype(np.int64))
    places = hashes.places(vectors[asked])
    hit = total = 0
    for row, q in enumerate(asked.tolist()):
        far = ((vectors - vectors[q]) ** 2).sum(1)
        far[q] = np.inf
        best = np.argsort(far, kind="stable")[: min(k, len(vectors) - 1)]
        met = np.zeros(len(best), bool)
        for t in range(places.shape[1]):
            met |= np.isin(keys[best, t], hashes.keys(perturbations(places[row, t], probes)))
        hit, total = hit + int(met.sum()), total + len(best)
    return hit / max(1, total)


def fit(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, goal: float = GOAL, seed: int = 11) -> Hashes:
    """Hash functions for a table of vectors like the sampled ``vectors``.

    The cell is twice as wide as the usual distance to the tenth neighbour in the sample. Of the
    numbers of hashes the largest is taken (so the smallest buckets) that still finds ``goal`` of the
    neighbours of some sampled rows. Neighbours are farther in a sample than in the whole table, so
    the whole table's recall is no worse.
    """
    rng = np.random.default_rng(seed)
    n, d = vectors.shape
    ask = rng.permutation(n)[: min(n, 48)]
    near = np.median([np.sort(np.sqrt(((vectors - vectors[i]) ** 2).sum(1)))[min(10, n - 1)] for i in ask.tolist()])
    w = max(1e-12, 2.0 * float(near))
    a, b = rng.normal(size=(tables, 32, d)), rng.random((tables, 32))
    made = lambda m: Hashes(np.ascontiguousarray(a[:, :m]), np.ascontiguousarray(b[:, :m]), w)
    low, high = 1, 32
    while low < high:
        m = (low + high + 1) // 2
        if recall(made(m), vectors, ask, probes) >= goal:
            low = m
        else:
            high = m - 1
    return made(low)


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return np.asarray(column(batch, name).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


MEASURED = "qid long, vid long, first long, score double"


def _first_of_each(group: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Of rows in ``order`` (by group, then rank) the first n of each group."""
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < n]


def _copies(n: int, d: int):
    """Within each batch: one row for each different vector, with its n smallest different ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, ids = np.ascontiguousarray(_matrix(b, "v", d) + 0.0), np.asarray(column(b, "vec_id"))
            _, where, group = np.unique(v.view(f"V{8 * d}").ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((ids, group))
            fresh = np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(ids[order]) != 0)])
            keep = _first_of_each(group, order[fresh], n)
            counts = np.bincount(group[keep], minlength=len(where))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[keep])), pa.ListArray.from_arrays(pa.array(np.arange(len(where) + 1, dtype=np.int32) * d), pa.array(v[where].ravel()))], ["ids", "v"])

    return run


def _matrix_of(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors in double precision, without those that are null, empty, zero or hold a
    null or non-finite component, and without null ids."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _search(table: DataFrame, asked: list, hashes: Hashes | None, probes: int, d: int, n: int) -> DataFrame:
    """MEASURED: for one block of queries the n nearest of each batch of ``table`` (vid, first, v, keys).

    With ``hashes`` only rows in a visited bucket of some table are measured. The block is bounded,
    so what goes with the tasks is; nothing but each batch's best leaves them.
    """
    q, ids = np.array([r.v for r in asked], np.float64).reshape(-1, d), np.array([r.qid for r in asked], np.int64)
    visited = None
    if hashes is not None:
        places = hashes.places(q)
        visited = []
        for t in range(places.shape[1]):  # of each table: the visited keys in order, and who visits them
            keys = [hashes.keys(perturbations(p, probes)) for p in places[:, t]]
            who, flat = np.repeat(np.arange(len(q)), [len(x) for x in keys]), np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            visited.append((flat[order], who[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, vid, first = _matrix(b, "v", d), np.asarray(column(b, "vid")), np.asarray(column(b, "first"))
            if visited is not None:
                keys = _matrix_of(b, "keys", len(visited))
                met = np.zeros((len(q), len(v)), bool)
                for t, (flat, who) in enumerate(visited):
                    lo, hi = np.searchsorted(flat, keys[:, t], "left"), np.searchsorted(flat, keys[:, t], "right")
                    many = hi - lo
                    rows = np.repeat(np.arange(len(v)), many)
                    met[who[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())], rows] = True
            for i in range(len(q)):
                at = np.flatnonzero(met[i]) if visited is not None else np.arange(len(v))
                far = np.sqrt(((v[at] - q[i]) ** 2).sum(1))
                keep = np.lexsort((first[at], far))[:n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i], len(keep))), pa.array(vid[at][keep]), pa.array(first[at][keep]), pa.array(far[keep])], ["qid", "vid", "first", "score"])

    return table.mapInArrow(run, MEASURED)


def _best(found: DataFrame, n: int) -> DataFrame:
    """(qid, cs): the n nearest different vectors of each query, by distance and smallest id."""
    salted = found.select("qid", F.struct("score", "first", "vid").alias("c"), F.pmod(F.xxhash64("vid"), F.lit(16)).alias("salt"))
    part = salted.groupBy("qid", "salt").agg(F.slice(F.array_sort(F.collect_list("c")), 1, n).alias("cs"))  # n from each batch at most
    return part.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("cs"))), 1, n).alias("cs"))


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """Queries in blocks of about ``block`` rows, one block at a time on the driver."""
    n = max(1, -(-queries.count() // block))
    for e in range(n):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == e).orderBy("qid").collect()
        if rows:
            yield rows


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, tables: int = TABLES, probes: int = PROBES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, ties to the smaller vec_id.

    Queries are the usable rows whose vec_id is divisible by ``every``; all usable rows but the
    query's own are candidates. A query that finds fewer than k in its buckets is searched exactly
    against all rows. Vectors of another length than the most frequent take no part. An empty table
    gives an empty one; rows that repeat a vec_id and vector count once; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0].d
    # One row for each different vector: a number, its k + 1 smallest ids (it may be its own query's).
    good = good.where(F.size("v") == d)
    combined = good.mapInArrow(_copies(k + 1, d), "ids array<long>, v array<double>")
    keyed = combined.select("*", F.xxhash64("v").alias("hash"), F.xxhash64(F.lit(1), "v").alias("check"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"))
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")  # k + 1 from each batch at most
    distinct = written(keyed.groupBy("hash", "check", "salt").agg(smallest, F.min("v").alias("v")).groupBy("hash", "check").agg(smallest, F.min("v").alias("v")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    total = distinct.count()
    sample = np.array([r.v for r in distinct.orderBy(F.xxhash64("hash", "check"), "vid").limit(fit_rows).select("v").collect()])  # bounded by fit_rows
    if not total:
        return spark.createDataFrame([], schema)
    hashes = fit(sample, tables, probes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hashes.keys(np.floor(hashes.places(_matrix(b, "v", d))).astype(np.int64))
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([column(b, "vid"), column(b, "first"), column(b, "v"), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["vid", "first", "v", "keys"])

    indexed = written(distinct.select("vid", F.element_at("ids", 1).alias("first"), "v").mapInArrow(index, "vid long, first long, v array<double>, keys array<long>"), "index")
    # Equal query vectors ask once; their answers are given out at the end.
    plus = F.transform("v", lambda x: x + F.lit(0.0))  # as in _copies: -0.0 is 0.0
    asked = good.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64(plus).alias("hash"), F.xxhash64(F.lit(1), plus).alias("check")).distinct().join(distinct.select("hash", "check", "vid"), ["hash", "check"]).select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid"))
    asked = written(asked, "asked")
    queries = written(asked.select("qid").distinct().join(distinct.select(F.col("vid").alias("qid"), "v"), "qid"), "queries")
    # Each block's answers are written before the next block's vectors and buckets come to the driver.
    paths = [written(_search(indexed, rows, hashes, probes, d, k + 1), "found").scratch_path for rows in _blocks(queries, BLOCK)]
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(MEASURED).parquet(*paths)
    top = written(_best(found, k + 1), "top")
    # Who has met fewer than k + 1 ids (one may be the query's own) is searched exactly.
    held = top.select("qid", F.explode("cs").alias("c")).select("qid", F.col("c.vid").alias("vid")).join(distinct.select("vid", F.size("ids").alias("n")), "vid").groupBy("qid").agg(F.sum("n").alias("n"))
    short = written(queries.join(held.where(F.col("n") > k), "qid", "left_anti"), "short")
    everything = top.join(short.select("qid"), "qid", "left_anti")
    exact = [written(_search(indexed, rows, None, 0, d, k + 1), "exact").scratch_path for rows in _blocks(short, BLOCK)]
    if exact:
        everything = everything.unionByName(_best(spark.read.schema(MEASURED).parquet(*exact), k + 1))
    chosen = everything.select("qid", F.explode("cs").alias("c")).select("qid", F.col("c.score").alias("score"), F.col("c.vid").alias("vid")).join(distinct.select("vid", "ids"), "vid")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # (k + 1)^2 rows at most
    rows = asked.join(chosen, "qid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id != vec_id")
    return rows.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

