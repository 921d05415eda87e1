"""Best-fit packing by a grouping genetic algorithm.

A chromosome is a list of bins. Crossover injects well-filled bins of one parent whole into another,
drops the bins that would hold a piece twice and best-fits the displaced pieces (Falkenauer, 1996).
Pieces are dealt by row into cells of a bounded size. Each cell is first packed by best fit in
descending order; cells that a lower bound proves best are done. The others evolve on several
islands, each a task of its own, and between epochs every island gets its neighbour's elite.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written
from .tokens import encoder

CAPACITY = 1024
#: Pieces in a cell, about. Cells are dealt by a hash of the row, so none is much larger.
CELL = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 5
#: Pieces of a bin that are tried in pairs against one loose piece.
PAIRED = 6

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32.

    A document's ids are those of its whole text (null: empty) and ``end_id``. Longer ones are cut
    into pieces of ``capacity``, of which only the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for d, x in zip(column(b, "doc_id").to_pylist(), column(b, "text"), strict=True):
                ids = encode(x.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(d, i, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


class _Bins:
    """Bins that are being filled; finds the one that an item fits best in."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.mask, self.bins = capacity, [[] for _ in range(capacity + 1)], 0, []

    def add_bin(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.free[room].append(len(self.bins) - 1)
        self.mask |= 1 << room

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        at = self.free[room].pop()
        if not self.free[room]:
            self.mask ^= 1 << room
        self.bins[at].append(item)
        left = room - size
        self.free[left].append(at)
        self.mask |= 1 << left


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put the items of ``order`` into ``bins`` (copied), each where the least room is left."""
    b = _Bins(capacity)
    for items in bins or []:
        b.add_bin(list(items), capacity - sum(sizes[i] for i in items))
    for i in order:
        b.put(i, sizes[i])
    return b.bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs (Martello and Toth's second bound)."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    number, mass = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(mass[-1]) // capacity)
    for t in range(capacity // 2 + 1):
        large = int(number[-1] - number[capacity - t])  # more than capacity - t
        half = capacity // 2
        middle, middle_mass = int(number[capacity - t] - number[half]), int(mass[capacity - t] - mass[half])
        small = int(mass[half] - (mass[t - 1] if t else 0))
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_mass)) // capacity)))
    return best


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square of the fill)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def replace(sizes: list[int], kept: list[list[int]], loose: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Let loose pieces dominate: in each bin one piece gives way to a larger loose one, or two to a single
    one, where that fills the bin better; the loose pieces that remain are smaller (Falkenauer, 1996).
    """
    free = sorted((sizes[i], i) for i in loose)
    bins = []
    for held in kept:
        items = list(held)
        room = capacity - sum(sizes[i] for i in items)
        if room and free:
            best, gain, out = None, 0, ()
            single = [(i,) for i in items]
            double = [(items[x], items[y]) for x in range(min(len(items), PAIRED)) for y in range(x)]
            for gone in (*single, *double):
                have = sum(sizes[i] for i in gone)
                at = bisect_right(free, (have + room, len(sizes))) - 1
                if at >= 0 and free[at][0] - have > gain:
                    best, gain, out = at, free[at][0] - have, gone
                    if gain == room:
                        break
            if best is not None:
                _, fresh = free.pop(best)
                items = [i for i in items if i not in out] + [fresh]
                for i in out:
                    insort(free, (sizes[i], i))
        bins.append(items)
    return bins, [i for _, i in free]


def _refill(sizes: list[int], kept: list[list[int]], loose: list[int], capacity: int) -> list[list[int]]:
    kept, loose = replace(sizes, kept, loose, capacity)
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), capacity, kept)


def crossover(sizes: list[int], into: list[list[int]], giver: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled bins of ``giver`` whole, drop bins with duplicates, best-fit the displaced."""
    fill = np.array([sum(sizes[i] for i in b) for b in giver])
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = [giver[k] for k in full[rng.random(len(full)) < 0.5].tolist()]
    inside = {i for b in chosen for i in b}
    kept, displaced = list(chosen), []
    for b in into:
        if any(i in inside for i in b):
            displaced += [i for i in b if i not in inside]
        else:
            kept.append(b)
    return _refill(sizes, kept, displaced, capacity)


def mutate(sizes: list[int], bins: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Empty the least filled bins and a few others; their pieces replace smaller ones elsewhere, and what
    is left is best-fitted."""
    fill = np.array([sum(sizes[i] for i in b) for b in bins])
    out = set(np.argsort(fill, kind="stable")[: max(2, len(bins) // 50)].tolist()) | set(rng.integers(0, len(bins), max(2, len(bins) // 25)).tolist())
    return _refill(sizes, [b for k, b in enumerate(bins) if k not in out], [i for k in out for i in bins[k]], capacity)


def evolve(sizes: list[int], elites: list[list[list[int]]], capacity: int, rng: np.random.Generator, bound: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing after some generations on one island."""
    score = lambda b: fitness(sizes, b, capacity)
    pool = [(score(b), b) for b in elites]
    while len(pool) < population:
        noise = rng.normal(0, 0.08, len(sizes))
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise[i]))
        b = best_fit(sizes, order, capacity)
        pool.append((score(b), b))
    for _ in range(generations):
        pool.sort(key=lambda p: p[0], reverse=True)
        if -pool[0][0][0] <= bound:
            break
        a = pool[0][1] if rng.random() < 0.5 else pool[int(rng.integers(len(pool)))][1]
        child = crossover(sizes, a, pool[int(rng.integers(len(pool)))][1], capacity, rng)
        child = mutate(sizes, child, capacity, rng) if len(child) > 3 else child
        pool[-1] = (score(child), child)
    return max(pool, key=lambda p: p[0])[1]


def _assign(n: int, bins: list[list[int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(assigned[order])) + 1)] if len(order) else []


def pack(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``items`` (item long, unique; length long, 1 to ``capacity``) with sequence_id and offset.

    Equal lengths are ordered by item. An empty table gives an empty one.
    """
    spark = items.sparkSession
    n_cells = max(1, -(-items.count() // cell))
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(n_cells)).alias("cell"))

    def first(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        full = int((x["length"] == capacity).sum())  # they come first, fill a bin each, and take no part in the search
        sizes = x["length"].tolist()[full:]
        bins = best_fit(sizes, range(len(sizes)), capacity)
        x["bin"] = np.concatenate([len(bins) + np.arange(full), _assign(len(sizes), bins)])
        x["solved"], x["cell"] = (np.arange(len(x)) < full) | (len(bins) <= lower_bound(sizes, capacity)), key[0]
        return x[["cell", "item", "length", "bin", "solved"]]

    start = written(dealt.groupBy("cell").applyInPandas(first, "cell long, item long, length long, bin long, solved boolean"), "packed")
    done = start.where("solved").select("cell", "item", "length", "bin")
    open_ = start.where("NOT solved").select("cell", "item", "length", "bin")
    state = open_.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("elite"))

    def epoch(number: int):
        def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
            own = x[x["elite"] == 0].sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
            sizes = own["length"].tolist()
            elites = [_bins(own["bin"].to_numpy())]
            if len(own) < len(x):
                other = x[x["elite"] == 1].sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
                elites.append(_bins(other["bin"].to_numpy()))
            rng = np.random.default_rng([int(key[0]), int(key[1]), number])
            best = evolve(sizes, elites, capacity, rng, lower_bound(sizes, capacity))
            rank = fitness(sizes, best, capacity)
            own["bin"], own["bins"], own["fill"], own["cell"], own["island"] = _assign(len(own), best), -rank[0], rank[1], key[0], key[1]
            return own[["cell", "island", "item", "length", "bin", "bins", "fill"]]

        return run

    out = "cell long, island int, item long, length long, bin long, bins long, fill double"
    for e in range(epochs):
        evolved = written(state.groupBy("cell", "island").applyInPandas(epoch(e), out), "evolved")
        moved = evolved.select("cell", "item", "length", "bin", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(1).alias("elite"))
        state = evolved.select("cell", "item", "length", "bin", "island", F.lit(0).alias("elite")).unionByName(moved)
    best = evolved.groupBy("cell").agg(F.min(F.struct("bins", (-F.col("fill")).alias("less"), "island")).alias("best")).select("cell", F.col("best.island").alias("island"))
    chosen = evolved.join(best, ["cell", "island"]).select("cell", "item", "length", "bin")
    placed = done.unionByName(chosen).select("item", "length", (F.col("cell") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"))
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)  # 1024 pieces at most
    return placed.select("item", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: PIECE_SCHEMA, sequence_id, offset.

    Null and empty texts are a piece of one id. A null doc_id stays null. Repeated rows are
    documents each. An empty table gives an empty one. Other columns are not read. The ids
    themselves don't move: pieces are placed by their lengths alone.
    """
    found = written(pieces(docs, tokenizer, end_id, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(found.select("item", "length"), capacity)
    return found.join(placed, "item").drop("item")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. ``docs`` must have unique doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            ids = [np.append(np.frombuffer(encode(x.as_py() or ""), "<u4"), end_id).tolist() for x in column(b, "text")]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<long>")
    cut = packed.join(coded, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda s: s["part"])).alias("ids"))
