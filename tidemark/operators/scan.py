"""Recurrences over long series as a blocked scan.

A recurrence here is a map x -> a x + b for each row, applied in order. Such maps compose, so a series
is cut into blocks of ``BLOCK_ROWS`` rows (by a range shuffle, so that one long series is spread over all
tasks), each block's maps are composed by themselves, the composed maps of the blocks (one row each) are
folded in order, and each block is run from the state that the fold gives it. Only the fold sees a whole
series, as one row for each block.

What depends on another recurrence's values (the signal of an EMA difference, a mean of ratios to an ATR)
is a further stage: one more map-only pass over the blocks and one more fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from ..sources.bars import SERIES

BLOCK_ROWS = 4096
#: Composed factors are kept above this, so that a state that has become infinite stays so.
LEAST_FACTOR = float(np.finfo(float).tiny)

#: A stage: (block, first row's place in the series, values before it, carries so far) ->
#: (columns found so far, totals of the next stage as rows of (a, b)).
Stage = Callable[[dict[str, np.ndarray], int, dict[str, float], list[np.ndarray]], tuple[dict[str, np.ndarray], list[tuple[float, float]]]]


def smoothed(x: np.ndarray, first: int, begins: int, period: int, step: Callable[[float, float], float], state: float, seed: Callable[[float, float], float] | None = None) -> np.ndarray:
    """State after each row of a mean seeded at place begins + period - 1: before ``begins`` it is 0, up to
    the seed a running sum, at the seed ``seed(sum, x)`` (their mean if None), then ``step(state, x)``.

    ``first`` is the place of x[0] in its series and ``state`` the state before it.
    """
    out = np.zeros(len(x))
    at = begins + period - 1
    if first < at:  # running sum, one number after another
        n = min(at - first, len(x))
        skip = min(max(begins - first, 0), n)
        if skip:
            state = 0.0
        out[skip:n] = np.cumsum(np.concatenate([[state], x[skip:n]]))[1:]
        state = float(out[n - 1]) if n > skip else state
    for i, v in enumerate(x[max(at - first, 0) :].tolist(), max(at - first, 0)):
        if first + i == at:
            state = seed(state, v) if seed else (state + v) / period
        else:
            state = step(state, v)
        out[i] = state
    return out


def factor(n: int, first: int, begins: int, period: int, keep: float, at_seed: float | None = None) -> float:
    """The product of a over n rows from place ``first`` of a recurrence as in ``smoothed``."""
    at = begins + period - 1
    if first < begins:
        return 0.0
    a = 1.0
    if first <= at < first + n:
        a *= 1.0 / period if at_seed is None else at_seed
    return max(a * keep ** max(0, first + n - max(at + 1, first)), LEAST_FACTOR)


def blocks(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Stored blocks: SERIES, block (its number), first (rows of the series before it), at and the columns
    as arrays (null as NaN), and ``before_<column>``: the value in the row before the block.

    Blocks are counted from the start of the series, so results don't depend on partitioning, and those
    of a series' first rows don't change when rows are appended.
    """
    spark = rows.sparkSession
    fields = ", ".join(f"{c} array<double>, last_{c} double" for c in columns)
    size = BLOCK_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0

        def out() -> pa.RecordBatch:
            at = np.concatenate([h[0] for h in held])
            cols = [np.concatenate([h[1 + i] for h in held]) for i in range(len(columns))]
            arrays = [pa.array([key[0]]), pa.array([key[1]]), pa.array([int(at[0])]), pa.array([len(at)]), pa.array([at], pa.list_(pa.int64()))]
            for c in cols:
                arrays += [pa.array([c], pa.list_(pa.float64())), pa.array([float(c[-1])])]
            names = [*SERIES, "start", "n", "at"] + [x for c in columns for x in (c, f"last_{c}")]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            at = b.column(2).to_numpy(zero_copy_only=False)
            cols = [b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
            s = 0
            while s < len(keys):
                if keys[s] != key:
                    if held:
                        yield out()
                    key, n = keys[s], 0
                e = s + 1
                while e < len(keys) and e - s < size - n and keys[e] == key:
                    e += 1
                held.append([at[s:e], *[c[s:e] for c in cols]])
                n += e - s
                if n >= size:
                    yield out()
                    n = 0
                s = e
        if held:
            yield out()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.select(*SERIES, F.col(order).cast("long").alias("at"), *[F.col(c).cast("double").alias(c) for c in columns]).repartitionByRange(parts, *SERIES, "at").sortWithinPartitions(*SERIES, "at")
    pieces = stored(dealt.mapInArrow(pack, f"instrument_id string, timeframe string, start long, n long, at array<long>, {fields}"), "pieces")

    # Pieces end where a task's range ends; blocks end at multiples of the size from the start of the series.
    by = Window.partitionBy(*SERIES).orderBy("start")
    begins = pieces.select(*SERIES, "start", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begins"))  # a row for each piece
    arrays = ["at", *columns]
    span = F.sequence(F.expr(f"begins div {size}"), F.expr(f"(begins + n - 1) div {size}"))
    cut = pieces.join(begins, [*SERIES, "start"]).select("*", F.explode(span).alias("block"))
    skip = F.greatest(F.col("block") * size - F.col("begins"), F.lit(0))
    upto = F.least((F.col("block") + 1) * size - F.col("begins"), F.col("n"))
    parted = cut.select(*SERIES, "block", F.struct("begins", *[F.slice(c, (skip + 1).cast("int"), (upto - skip).cast("int")).alias(c) for c in arrays]).alias("part"))
    joined = parted.groupBy(*SERIES, "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # one part or a few
    whole = stored(joined.select(*SERIES, "block", *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in arrays]).select("*", *[F.element_at(c, -1).alias(f"last_{c}") for c in columns]), "blocks")
    order_ = Window.partitionBy(*SERIES).orderBy("block")
    before = whole.select(*SERIES, "block", *[F.lag(f"last_{c}").over(order_).alias(f"before_{c}") for c in columns])  # a row for each block
    return whole.drop(*[f"last_{c}" for c in columns]).withColumn("first", F.col("block") * size).join(before, [*SERIES, "block"])


def _fold(totals: DataFrame, name: str) -> DataFrame:
    """The state before each block: maps of earlier blocks of its series, applied to 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            carries = []
            for i, t, maps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                m = np.array(maps, float).reshape(-1, 2)
                if (i, t) != key:
                    key, state = (i, t), np.zeros(len(m))
                carries.append(state.tolist())
                with np.errstate(invalid="ignore", over="ignore"):
                    state = np.where(m[:, 0] == 0, 0.0, m[:, 0] * state) + m[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(carries, pa.list_(pa.float64()))], [*SERIES, "block", name])

    sorted_ = totals.repartition(*SERIES).sortWithinPartitions(*SERIES, "block")
    return stored(sorted_.mapInArrow(run, f"instrument_id string, timeframe string, block long, {name} array<double>"), name)


def scan(rows: DataFrame, order: str, columns: list[str], stage: Stage, stages: int, outputs: list[str], keep: list[str] | None = None) -> DataFrame:
    """SERIES, ``order``, the columns of ``keep`` and the ``outputs`` of every row, in blocks.

    ``stage`` runs once for each of the stages with the carries known so far, and once more with all of
    them. NaN in an output becomes null. Equal values of ``order`` in a series have no stated order.
    """
    ship(rows.sparkSession)
    kept = keep or []
    cut = blocks(rows, order, columns)

    def inputs(b: pa.RecordBatch, n: int) -> Iterator[tuple]:
        names = b.schema.names
        # The values of a list column as one array, and where each row's begin; no row is copied.
        flat = {c: (b.column(names.index(c)).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b.column(names.index(c)).value_lengths().to_numpy(zero_copy_only=False))])) for c in columns}
        first = b.column(names.index("first")).to_pylist()
        before = {c: b.column(names.index(f"before_{c}")).to_pylist() for c in columns}
        carries = [b.column(names.index(f"carry{s}")).to_pylist() for s in range(n)]
        for i in range(b.num_rows):
            yield {c: x[o[i] : o[i + 1]] for c, (x, o) in flat.items()}, first[i], {c: np.nan if v[i] is None else v[i] for c, v in before.items()}, [np.array(c[i], float) for c in carries]

    for s in range(stages):

        def totals(batches: Iterator[pa.RecordBatch], s: int = s) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.array(stage(*args)[1], float).ravel().tolist() for args in inputs(b, s)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.float64()))], [*SERIES, "block", "maps"])

        total = cut.select(*SERIES, "block", *columns, "first", *[f"before_{c}" for c in columns], *[f"carry{i}" for i in range(s)]).mapInArrow(totals, "instrument_id string, timeframe string, block long, maps array<double>")
        cut = cut.join(_fold(total, f"carry{s}"), [*SERIES, "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.schema.names.index("at"))
            for i, args in enumerate(inputs(b, stages)):
                found = stage(*args)[0]
                times = at[i].values
                series = [pa.array([b.column(k)[i].as_py()] * len(times), pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*series, times, *[pa.array(args[0][c]) for c in kept], *[pa.array(found[c], pa.float64(), from_pandas=True) for c in outputs]], [*SERIES, order, *kept, *outputs])

    schema = f"instrument_id string, timeframe string, {order} long, " + ", ".join(f"{c} double" for c in [*kept, *outputs])
    return cut.select(*SERIES, "block", "at", *columns, "first", *[f"before_{c}" for c in columns], *[f"carry{i}" for i in range(stages)]).mapInArrow(run, schema)
