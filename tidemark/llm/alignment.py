"""Cross-tokenizer alignment by an event sweep.

Tokenizer A is byte-level BPE, B sentencepiece BPE with byte fallback; both read a text with a space
before it, and a token is the bytes it stands for. Places where a token of A and one of B both end cut
the text into groups. Tokens whose byte ranges overlap are linked.

1. ``events``: both tokenizers' ends become rows, one for each side and ``WINDOW`` bytes of a text. A row
   holds ids only; ends follow from the lengths that the vocabularies give.
2. ``swept``: events are dealt by document and sorted by window. A state machine with the two positions,
   the tokens of the open group and a running hash passes over them. Groups go into the hash; links are
   emitted in blocks, as distinct (A id, B id) with their numbers, so a long text takes no more memory.
   Between two neighbouring ends exactly one token of A and one of B lie: each end of either is a link.
3. ``pair_counts``: links of an id pair over the whole corpus, partial sums before the shuffle.
4. ``scored``: the ``HOT`` most frequent pairs (a bounded table) are looked up in place; all others, which
   by construction no hot key is among, go through a join. Both add up for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written
from .tokens import byte_lengths, encoder, piece_encoder

#: Bytes of text that an event row covers.
WINDOW = 1 << 14
#: Links that the sweep holds before it emits a block.
HELD = 1 << 16
#: Pairs that a task counts before it emits partial sums.
COUNTED = 1 << 22
#: Most frequent pairs that every task holds.
HOT = 1 << 18
#: B's ids take so many bits of a pair's code.
BITS = 15

KEY = "doc_id long, id long, check long"
SWEPT = f"{KEY}, many int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, numbers binary"
STATS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def events(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, id, check, at, side, ids): ids of A (side 0) or B (side 1) that end in window ``at``.

    A text without tokens (null, empty, or not reproduced by either tokenizer) has one row without ids.
    ``docs`` has doc_id, id, check and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = encoder(a, "<u2", True), piece_encoder(b)
        long_a, long_b = byte_lengths(a), second.lengths
        for batch in batches:
            rows: list[int] = []
            at: list[int] = []
            side: list[int] = []
            ids: list[bytes | None] = []
            for i, x in enumerate(column(batch, "text")):
                text = x.as_py()
                pieces = second(" " + text) if text else None
                tokens = first(" " + text) if pieces is not None else b""
                n = len((" " + text).encode("utf-8", "surrogatepass")) if text else 0
                ends = [np.cumsum(table[np.frombuffer(got, "<u2")]) for table, got in ((long_a, tokens), (long_b, pieces))] if pieces is not None else []
                if not ends or any(int(e[-1]) != n for e in ends):
                    rows.append(i), at.append(0), side.append(0), ids.append(None)
                    continue
                for k, (e, got) in enumerate(zip(ends, (tokens, pieces), strict=True)):
                    cuts = [0, *np.searchsorted(e, range(WINDOW, n, WINDOW), "right").tolist(), len(e)]
                    for w, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if p < q:
                            rows.append(i), at.append(w), side.append(k), ids.append(got[2 * p : 2 * q])
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[column(batch, c).take(take) for c in ("doc_id", "id", "check")], pa.array(at, pa.int32()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "id", "check", "at", "side", "ids"])

    return docs.mapInArrow(run, f"{KEY}, at int, side int, ids binary")


@lru_cache(2)
def _letters(n_a: int, n_b: int) -> list[bytes]:
    """What a token adds to the string of groups, by 4 * id + 2 * side + whether it ends its side."""
    out = []
    for i in range(max(n_a, n_b)):
        d = str(i).encode()
        out += [d + b",", d + b"|", d + b",", d + b";"]
    return out


class Sweep:
    """One document's state: positions, the open group's tokens, numbers and the hash so far."""

    def __init__(self, long_a: np.ndarray, long_b: np.ndarray):
        self.long = (long_a, long_b)
        self.letters = _letters(len(long_a), len(long_b))
        none = np.empty(0, np.int64)
        self.ids, self.ends, self.at = [none, none], [none, none], [0, 0]
        self.n, self.groups, self.links = [0, 0], 0, 0
        self.hash, self.open = hashlib.sha256(), False

    def take(self, side: int, raw: bytes) -> None:
        """The next tokens of a side."""
        ids = np.frombuffer(raw, "<u2").astype(np.int64)
        ends = self.at[side] + np.cumsum(self.long[side][ids])
        self.at[side] = int(ends[-1])
        self.n[side] += len(ids)
        self.ids[side], self.ends[side] = np.concatenate([self.ids[side], ids]), np.concatenate([self.ends[side], ends])

    def close(self) -> np.ndarray:
        """Close all groups that both sides have reached; their links as codes."""
        common = np.intersect1d(*self.ends, assume_unique=True)
        if not len(common):
            return np.empty(0, np.uint32)
        cut = [int(np.searchsorted(e, common[-1], "right")) for e in self.ends]
        (a, ids_a), (b, ids_b) = ((self.ends[k][: cut[k]], self.ids[k][: cut[k]]) for k in (0, 1))
        either = np.union1d(a, b)
        codes = (ids_a[np.searchsorted(a, either)] << BITS | ids_b[np.searchsorted(b, either)]).astype(np.uint32)
        place = np.concatenate([2 * np.searchsorted(common, a), 2 * np.searchsorted(common, b) + 1])
        last = np.concatenate([np.isin(a, common, assume_unique=True), np.isin(b, common, assume_unique=True)])
        letters = (np.concatenate([4 * ids_a, 4 * ids_b + 2]) + last)[np.argsort(place, kind="stable")]
        if self.open:
            self.hash.update(b";")
        self.hash.update(b"".join(map(self.letters.__getitem__, letters.tolist()))[:-1])
        self.open = True
        self.groups += len(common)
        self.links += len(codes)
        for k in (0, 1):
            self.ids[k], self.ends[k] = self.ids[k][cut[k] :], self.ends[k][cut[k] :]
        return codes


def swept(ends: DataFrame, a: str, b: str) -> DataFrame:
    """The state machine over ``events``: blocks of links, and the numbers of a document in its last row.

    Rows that repeat a doc_id and a text are the same events and pass as one; ``many`` says how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_a, long_b = byte_lengths(a), piece_encoder(b).lengths
        key, many, state, window, seen = None, 0, None, None, None
        held: list[np.ndarray] = []
        out: list[tuple] = []

        def block(stats: tuple) -> None:
            codes, numbers = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint32), np.empty(0, np.int64))
            out.append((*key, many, *stats, codes.tobytes(), numbers.astype("<u4").tobytes()))
            held.clear()

        def finish() -> None:
            if key is None:
                return
            if state is None:
                block((0, 0, 0, 0, ""))
            else:
                held.append(state.close())
                block((*state.n, state.groups, state.links, state.hash.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 11
            types = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SWEPT.split(", ")])
            out.clear()
            return made

        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("doc_id", "id", "check", "at", "side")]
            for *this, at, side, ids in zip(*cols, column(batch, "ids"), strict=True):
                if this != key:
                    finish()
                    key, many, window, seen = this, 0, 0, None
                    state = Sweep(long_a, long_b) if ids.is_valid else None
                many += at == 0 and side == 0
                if state is None or (at, side) == seen:
                    continue
                if at != window:
                    held.append(state.close())
                    if sum(map(len, held)) >= HELD:
                        block((None,) * 5)
                    window = at
                seen = (at, side)
                state.take(side, ids.as_py())
            yield batch_of()
        finish()
        yield batch_of()

    return ends.repartition("doc_id", "id", "check").sortWithinPartitions("doc_id", "id", "check", "at", "side").mapInArrow(run, SWEPT)


def pair_counts(links: DataFrame) -> DataFrame:
    """(code, n, best): links of each pair over all documents, and whether no pair of its B id has more.

    A window over B's ids isn't needed: their largest counts are one row for each id of a vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            c, at = np.unique(np.concatenate(codes), return_inverse=True) if codes else (np.empty(0, np.uint32), np.empty(0, np.int64))
            n = np.zeros(len(c), np.int64)
            np.add.at(n, at, np.concatenate(numbers)) if codes else None
            codes.clear(), numbers.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n)], ["code", "n"])

        held = 0
        for b in batches:
            for m, c, n in zip(column(b, "many").to_pylist(), column(b, "codes"), column(b, "numbers"), strict=True):
                codes.append(np.frombuffer(c.as_py(), "<u4"))
                numbers.append(np.frombuffer(n.as_py(), "<u4").astype(np.int64) * m)
                held += len(codes[-1])
                if held >= COUNTED:
                    yield summed()
                    held = 0
        yield summed()

    counts = written(links.select("many", "codes", "numbers").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy(F.col("code").bitwiseAND((1 << BITS) - 1).alias("b")).agg(F.max("n").alias("most"))  # one row for each id of B
    return counts.join(F.broadcast(most), F.col("code").bitwiseAND((1 << BITS) - 1) == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Each document's numbers with n_best and count_sum; a row for each repeated row."""
    spark = links.sparkSession
    hot = counts.orderBy(F.desc("n"), "code").limit(HOT).toArrow().sort_by("code")  # HOT rows at most
    table = spark.sparkContext.broadcast((hot["code"].to_numpy().astype(np.uint32), hot["n"].to_numpy(), hot["best"].to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_codes, hot_n, hot_best = table.value
        for b in batches:
            best: list[int] = []
            total: list[int] = []
            rest: list[np.ndarray] = []
            rest_numbers: list[np.ndarray] = []
            for c, n in zip(column(b, "codes"), column(b, "numbers"), strict=True):
                codes, numbers = np.frombuffer(c.as_py(), "<u4"), np.frombuffer(n.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(hot_codes, codes), max(len(hot_codes) - 1, 0))
                hit = hot_codes[at] == codes if len(hot_codes) else np.zeros(len(codes), bool)
                best.append(int((numbers[hit] * hot_best[at[hit]]).sum()))
                total.append(int((numbers[hit] * hot_n[at[hit]]).sum()))
                rest.append(codes[~hit].astype(np.int64))
                rest_numbers.append(numbers[~hit])
            kept = [c for c in b.schema.names if c not in ("codes", "numbers")]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rest, rest_numbers)]
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in kept], pa.array(best, pa.int64()), pa.array(total, pa.int64()), *lists], [*kept, "n_best", "count_sum", "rest", "rest_numbers"])

    schema = SWEPT.split(", codes")[0] + ", n_best long, count_sum long, rest array<long>, rest_numbers array<long>"
    judged = written(links.mapInArrow(run, schema), "judged")
    key = ["doc_id", "id", "check"]
    rare = judged.where(F.size("rest") > 0).select(*key, F.explode(F.arrays_zip("rest", "rest_numbers")).alias("x")).select(*key, F.col("x.rest").alias("code"), F.col("x.rest_numbers").alias("times"))
    found = rare.join(counts, "code").groupBy(*key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("many", "int"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"))]
    parts = judged.drop("rest", "rest_numbers").unionByName(found.select(*key, *none, "n_best", "count_sum"))
    # The last row of a document alone has its numbers, but every block says how often it is repeated.
    total = parts.groupBy(*key).agg(F.max("many").alias("many"), *[F.max(c).alias(c) for c in STATS], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return total.withColumn("row", F.explode(F.sequence(F.lit(1), "many"))).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs``.

    Null and empty texts, and texts that the joined bytes of either tokenizer don't give back (any with
    U+2581), have no tokens: zeros and an empty string. Strings of special tokens are plain text. A null
    doc_id keeps its row; rows that repeat doc_id and text give a row each, and their links count each. An
    empty table gives an empty one; other columns aren't read.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("id"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("check"), text.alias("text"))
    links = written(swept(events(keyed, a, b), a, b), "aligned")
    return scored(links, written(pair_counts(links), "pair_counts"))
