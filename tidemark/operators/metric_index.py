"""Exact nearest rows of equal mask through a metric index.

Distances are root mean squares over the dimensions of a mask, so that among rows of one mask they obey
the triangle inequality. Rows are put into balls around pivots; a ball knows how near and how far its rows
are from its pivot. A query first searches its nearest balls; the k-th distance found bounds what a second
pass has to look at: a ball goes unread if no row of it can be as near, and of a ball that is read only
rows whose distance to the pivot differs from the query's by the bound at most are measured.

Pivots are bounded by parameters (``MASKS`` masks of ``PIVOTS`` each); rows of other masks are one ball each.
Balls are cut into cells of ``ROWS`` rows, and a ball that many queries visit into several tasks with the
same rows; neither the library nor the queries are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import ship, stored

#: Masks that have pivots, pivots of one mask, and candidates that its pivots are chosen from.
MASKS, PIVOTS, CHOICE = 64, 128, 1024
#: Rows of a mask for each of its pivots.
ROWS_A_PIVOT = 24
#: Library rows, and queries, that meet in one task.
ROWS, QUERIES = 2048, 20_000
#: Rows, in multiples of k, that a first pass reads at least.
FIRST = 4
#: Rows, with whole vectors, that a task gives on at a time, about.
OUT = 2048
#: What pruning allows for rounding.
SLACK = 1e-9

ELIGIBLE = ("all", "others", "matured")


def _vectors(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 0))


def _far(a: np.ndarray, b: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to b over the active dimensions; none: infinity."""
    n = int(active.sum())
    if not n:
        return np.full(len(a), np.inf)
    return np.sqrt(((a[:, active] - b[active]) ** 2).sum(1) / n)


def _spread(rows: np.ndarray, active: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows, each the farthest from those chosen before."""
    chosen = [0]
    near = _far(rows, rows[0], active)
    while len(chosen) < min(count, len(rows)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        chosen.append(i)
        near = np.minimum(near, _far(rows, rows[i], active))
    return rows[chosen]


class MetricIndex:
    """Stored library rows with ball and distance to its pivot; ``search`` finds neighbours in it.

    ``library`` comes from ``samples.normalize`` (vector, mask, mask_key) and has sample_id, which names a row
    among those of its mask_key, and for "matured" searches at and known_at.
    """

    def __init__(self, library: DataFrame):
        ship(library.sparkSession)
        self.fields = library.columns
        count = library.groupBy("mask_key").agg(F.count("*").alias("n"))
        sized = count.orderBy(F.desc("n"), "mask_key").limit(MASKS).collect()  # MASKS rows at most
        kept = [r.mask_key for r in sized if r.n >= 2 * ROWS_A_PIVOT]
        order = Window.partitionBy("mask_key").orderBy(F.xxhash64("sample_id"), "sample_id")
        sample = library.where(F.col("mask_key").isin(kept)).select("mask_key", "mask", "vector", F.row_number().over(order).alias("place")).where(F.col("place") <= CHOICE).orderBy("mask_key", "place").collect() if kept else []  # CHOICE rows for each mask at most
        self.pivots: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for r in sized:
            rows = [x for x in sample if x.mask_key == r.mask_key]
            if rows and any(rows[0].mask):
                active = np.array(rows[0].mask, bool)
                self.pivots[r.mask_key] = active, _spread(np.array([x.vector for x in rows], float), active, min(PIVOTS, max(1, r.n // ROWS_A_PIVOT)))
        pivots = self.pivots

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors, keys = _vectors(b.column("vector")), b.column("mask_key").to_pylist()
                ball, far = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
                for key in set(keys) & pivots.keys():
                    at = np.array([k == key for k in keys])
                    active, centres = pivots[key]
                    d = np.stack([_far(vectors[at], c, active) for c in centres], 1)
                    ball[at], far[at] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), pa.array(far)], [*b.schema.names, "ball", "pivot_distance"])

        schema = StructType([*library.schema.fields, *StructType.fromDDL("ball int, pivot_distance double").fields])
        self.rows = stored(library.mapInArrow(assign, schema), "metric_index")
        self.balls = stored(self.rows.groupBy("mask_key", "ball").agg(F.count("*").alias("rows"), F.min("pivot_distance").alias("low"), F.max("pivot_distance").alias("high")), "balls")
        known = {}
        for r in self.balls.where("ball >= 0").collect():  # MASKS times PIVOTS rows at most
            known.setdefault(r.mask_key, []).append((r.ball, r.rows, r.low, r.high))
        self.known = {k: tuple(np.array(x) for x in zip(*sorted(v), strict=True)) for k, v in known.items()}

    def _visits(self, queries: DataFrame, k: int, found: bool) -> DataFrame:
        """(mask_key, ball, gap, bound, q) of the balls that each query reads.

        In the first pass (``found`` false) its nearest balls; then, with column ``reach``, all others that
        may hold something as near.
        """
        pivots, known = self.pivots, self.known

        def made(b: pa.RecordBatch, take: list[int], balls: list[int], gaps: list[float]) -> pa.RecordBatch:
            at = pa.array(take, pa.int32())
            q = pa.StructArray.from_arrays([b.column(c).take(at) for c in names], names)
            return pa.RecordBatch.from_arrays([b.column("mask_key").take(at), pa.array(balls, pa.int32()), pa.array(gaps, pa.float64()), b.column("reach").take(at), q], ["mask_key", "ball", "gap", "reach", "q"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors, keys = _vectors(b.column("vector")), b.column("mask_key").to_pylist()
                reach = b.column("reach").to_numpy(zero_copy_only=False)
                take, balls, gaps = [], [], []
                for i, key in enumerate(keys):
                    if len(take) >= OUT:
                        yield made(b, take, balls, gaps)
                        take, balls, gaps = [], [], []
                    if key not in known:
                        if not found:
                            take.append(i), balls.append(-1), gaps.append(0.0)
                        continue
                    active, centres = pivots[key]
                    ball, rows, low, high = known[key]
                    d = _far(centres[ball], vectors[i], active)
                    order = np.argsort(d, kind="stable")
                    first = int(np.searchsorted(np.cumsum(rows[order]), FIRST * k)) + 1
                    if found:
                        order = order[first:]
                        gap = np.maximum(np.maximum(d - high, low - d), 0.0)[order]
                        order = order[gap <= reach[i] * (1 + SLACK) + SLACK]
                    else:
                        order = order[:first]
                    take += [i] * len(order)
                    balls += ball[order].tolist()
                    gaps += d[order].tolist()
                yield made(b, take, balls, gaps)

        names = [c for c in queries.columns if c != "reach"]
        q_type = StructType([f for f in queries.schema.fields if f.name != "reach"])
        schema = StructType([*StructType.fromDDL("mask_key string, ball int, gap double, reach double").fields, StructField("q", q_type)])
        return queries.mapInArrow(run, schema)

    def _read(self, visits: DataFrame, k: int, eligible: str) -> DataFrame:
        """(q, l, distance): up to k of each cell for each visit, and a row without l that says in
        ``distance`` how many rows were measured."""
        cells = self.balls.select("mask_key", "ball", F.ceil(F.col("rows") / ROWS).cast("int").alias("slots"))
        asked = visits.groupBy("mask_key", "ball").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        sizes = stored(cells.join(asked, ["mask_key", "ball"]), "cells")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        pick = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.col(n)).cast("int")
        lib = self.rows.join(sizes, ["mask_key", "ball"]).select("mask_key", "ball", pick("sample_id", "slots").alias("slot"), spread("groups").alias("part"), F.col("pivot_distance").alias("gap"), F.lit(0.0).alias("reach"), F.struct(*self.fields).alias("l"))
        ask = visits.join(sizes, ["mask_key", "ball"]).select("mask_key", "ball", spread("slots").alias("slot"), pick("q.sample_id", "groups").alias("part"), "gap", "reach", "q")
        key = ["mask_key", "ball", "slot", "part"]
        asks = ("sample_id", "at") if eligible == "matured" else ("sample_id",)
        every = lib.unionByName(ask, allowMissingColumns=True).withColumn("side", F.col("q").isNotNull()).repartition(*key).sortWithinPartitions(*key, "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, table = None, [], None

            def near(q: dict, vector: np.ndarray, gap: float, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
                gaps, vectors, ids, times, known, active = table
                fit = np.abs(gaps - gap) <= reach * (1 + SLACK) + SLACK
                if eligible == "others":
                    fit &= ids != q["sample_id"]
                elif eligible == "matured":
                    fit &= (times < q["at"]) & (known < q["at"])
                at = fit.nonzero()[0]
                d = _far(vectors[at], vector, active)
                inside = d <= reach
                at, d = at[inside], d[inside]
                best = np.lexsort((ids[at], d))[:k]
                return at[best], d[best], int(fit.sum())

            for b in batches:
                cells = list(zip(*[b.column(c).to_pylist() for c in key], strict=True))
                side, gap, reach = (b.column(c).to_numpy(zero_copy_only=False) for c in ("side", "gap", "reach"))
                left, right = b.column("l"), b.column("q")
                out: list[pa.RecordBatch] = []
                size, i = 0, 0
                while i < b.num_rows:
                    end = i + 1  # of the rows of one side of a cell
                    while end < b.num_rows and cells[end] == cells[i] and side[end] == side[i]:
                        end += 1
                    if cells[i] != cell:
                        cell, held, table = cells[i], [], None
                    if not side[i]:
                        held.append((gap[i:end], left.slice(i, end - i)))
                        i = end
                        continue
                    if held and table is None:
                        rows = pa.concat_arrays([x for _, x in held])
                        field = lambda n: rows.field(n).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                        table = (np.concatenate([g for g, _ in held]), _vectors(rows.field("vector")), field("sample_id"), field("at") if eligible == "matured" else None, field("known_at") if eligible == "matured" else None, np.array(rows.field("mask")[0].as_py(), bool))
                        current, held = rows, [()]
                    for first in range(i, end, OUT) if held else ():
                        some = right.slice(first, min(OUT, end - first))
                        vectors = _vectors(some.field("vector"))
                        names = [{n: some.field(n)[j].as_py() for n in asks} for j in range(len(some))]
                        for j, q in enumerate(names):
                            at, d, n = near(q, vectors[j], gap[first + j], reach[first + j])
                            one = pa.array([j] * (len(at) + 1), pa.int32())
                            found = pa.concat_arrays([current.take(pa.array(at, pa.int64())), pa.nulls(1, current.type)])
                            out.append(pa.RecordBatch.from_arrays([some.take(one), found, pa.array([*d.tolist(), float(n)])], ["q", "l", "distance"]))
                            size += len(one)
                            if size >= OUT:
                                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                                out, size = [], 0
                    i = end
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        schema = StructType([StructField("q", visits.schema["q"].dataType), StructField("l", StructType(self.rows.select(*self.fields).schema.fields)), StructField("distance", DoubleType())])
        return stored(every.mapInArrow(run, schema), "near")

    def search(self, queries: DataFrame, k: int, most: float | Column | None = None, eligible: str = "all") -> tuple[DataFrame, DataFrame]:
        """(neighbours, measured): q_ and l_ columns, distance and rank of each query's k nearest; and for
        each query how many distances were computed (to pivots not counted).

        ``most`` is the largest distance that counts (a number or a column of ``queries``). ``eligible``:
        "all", "others" (not the query's own sample_id), "matured" (at and known_at both before the query's
        at). Ties go to the smaller sample_id.
        """
        if eligible not in ELIGIBLE:
            raise ValueError(f"eligible must be one of {ELIGIBLE}")
        limit = most if isinstance(most, Column) else F.lit(float("inf") if most is None else float(most))
        asked = queries.withColumn("reach", limit.cast("double"))
        first = self._read(stored(self._visits(asked, k, False), "visits"), k, eligible)
        own = first.where("l IS NOT NULL")
        order = Window.partitionBy("q.mask_key", "q.sample_id").orderBy("distance", "l.sample_id")
        kth = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q.mask_key", "q.sample_id", "distance")
        bounded = asked.join(kth, ["mask_key", "sample_id"], "left").withColumn("reach", F.least(F.col("reach"), F.coalesce("distance", "reach"))).select(*asked.columns)
        second = self._read(stored(self._visits(bounded, k, True), "visits"), k, eligible)
        both = first.unionByName(second)
        best = both.where("l IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = [*[F.col(f"q.{c}").alias(f"q_{c}") for c in queries.columns], *[F.col(f"l.{c}").alias(f"l_{c}") for c in self.fields]]
        measured = both.where("l IS NULL").groupBy("q.mask_key", F.col("q.sample_id").alias("query_id")).agg(F.sum("distance").cast(LongType()).alias("measured"))
        return best.select(*names, "distance", "rank"), measured
