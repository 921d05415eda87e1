"""Token ids in binary blocks, coded by a static range asymmetric numeral system (rANS).

One frequency table is shared by all blocks. A block holds whole documents in ascending order and
can be decoded without any other. Its ids are dealt over L interleaved coder states ("lanes"): id
number i belongs to lane i mod L, and all lanes share one stream of 32-bit words. At regular steps a
checkpoint records the lanes' states and the place in the stream, so the parts of a block decode
side by side. Checksums guard the header, the words and the decoded ids.

Block layout, little-endian:
  magic 'TMR1', u32 crc32 of all that follows, then i64 x 8: documents, ids, lanes, steps between
  checkpoints, checkpoints, words, table's crc32, crc32 of the ids as u32;
  u64 states [checkpoints, lanes]; i64 places in the stream [checkpoints];
  i64 doc ids [documents]; u8 null flags [documents]; i64 lengths [documents]; u32 words [words].
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scratch_path, written
from .tokens import encoder, vocabulary_size

MAGIC = b"TMR1"
LOWEST = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
WORD_BITS = np.uint64(32)

#: The scale of the frequency table; its sum is 2^SCALE_BITS.
SCALE_BITS = 20
#: A block is closed once it has this many ids. A longer document makes a longer block.
BLOCK_IDS = 1 << 20
MOST_LANES = 1024
#: Steps between checkpoints: each covers lanes x steps ids.
CHECKPOINT_STEPS = 256


@dataclass(frozen=True)
class Table:
    """Frequencies (0 for ids that never occur), where each id's slots begin, and the id of each slot."""

    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray
    crc: int

    @staticmethod
    def of(counts: np.ndarray, bits: int = SCALE_BITS) -> Table:
        """Scale counts to a sum of 2^bits; every id that occurs gets 1 at least."""
        counts = np.asarray(counts, np.float64)
        seen = counts > 0
        total = 1 << bits
        if seen.sum() > total:
            raise ValueError("more different ids than slots")
        if not seen.any():
            counts, seen = np.ones_like(counts), np.ones(len(counts), bool)
        ideal = counts / counts.sum() * total
        freq = np.where(seen, np.maximum(1, np.floor(ideal)), 0).astype(np.int64)
        off = total - int(freq.sum())
        if off > 0:
            freq[int(np.argmax(freq))] += off
        while off < 0:  # take from the largest, never below 1
            at = np.argsort(-freq, kind="stable")[: max(1, min(-off, int((freq > 1).sum())))]
            take = np.minimum(freq[at] - 1, np.maximum(1, (-off) * freq[at] // max(1, int(freq[at].sum()))))
            take = np.minimum(take, np.maximum(0, -off - np.concatenate([[0], np.cumsum(take)[:-1]])))
            freq[at] -= take
            off += int(take.sum())
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return Table(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq), zlib.crc32(freq.astype("<i8").tobytes()))

    @staticmethod
    def load(freq: bytes) -> Table:
        f = np.frombuffer(freq, "<i8")
        start = np.concatenate([[0], np.cumsum(f)[:-1]])
        return Table(f.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(f), dtype=np.uint32), f), zlib.crc32(freq))

    def dump(self) -> bytes:
        return self.freq.astype("<i8").tobytes()


def _lanes(n: int) -> int:
    return min(MOST_LANES, max(1, 1 << max(0, (n // CHECKPOINT_STEPS).bit_length() - 1)))


def encode_block(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, table: Table, every: int = CHECKPOINT_STEPS, lanes: int | None = None) -> bytes:
    """One block. ``ids`` are those of all its documents, ``lengths`` how many each has."""
    n, bits = len(ids), np.uint64(SCALE_BITS)
    lanes = lanes or _lanes(n)
    steps = -(-n // lanes)
    x = np.full(lanes, LOWEST, np.uint64)
    groups: list[np.ndarray] = []
    states: list[np.ndarray] = []
    behind: list[int] = []  # words put out before each checkpoint was taken, from the end
    put = 0
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("the table has no slot for some id")
    limit = freq << np.uint64(63 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        f, v = freq[a:b], x[: b - a]
        full = v >= limit[a:b]
        if full.any():
            groups.append(v[full].astype(np.uint32))
            put += len(groups[-1])
            v = np.where(full, v >> WORD_BITS, v)
        q = v // f
        x[: b - a] = (q << bits) + (v - q * f) + start[a:b]
        if t % every == 0:
            states.append(x.copy())
            behind.append(put)
    words = np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32)
    at = np.array([put - k for k in behind[::-1]], np.int64)
    state = np.array(states[::-1], np.uint64).reshape(-1, lanes)
    known = [0 if d is None else d for d in doc_ids]
    head = np.array([len(doc_ids), n, lanes, every, len(at), len(words), table.crc, zlib.crc32(ids.astype("<u4").tobytes())], "<i8")
    body = b"".join([head.tobytes(), state.astype("<u8").tobytes(), at.astype("<i8").tobytes(), np.array(known, "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.asarray(lengths, "<i8").tobytes(), words.astype("<u4").tobytes()])
    return MAGIC + zlib.crc32(body).to_bytes(4, "little") + body


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids). With ``first`` and ``last``: only the ids of those checkpoints' parts.

    All the parts asked for decode side by side. A damaged block raises ValueError.
    """
    if block[:4] != MAGIC or zlib.crc32(block[8:]) != int.from_bytes(block[4:8], "little"):
        raise ValueError("damaged block")
    docs, n, lanes, every, points, n_words, table_crc, ids_crc = np.frombuffer(block, "<i8", 8, 8).tolist()
    if table_crc != table.crc:
        raise ValueError("another frequency table")
    at = 72
    state = np.frombuffer(block, "<u8", points * lanes, at).reshape(points, lanes)
    at += 8 * points * lanes
    place = np.frombuffer(block, "<i8", points, at)
    at += 8 * points
    doc_ids = np.frombuffer(block, "<i8", docs, at).tolist()
    at += 8 * docs
    nulls = np.frombuffer(block, "u1", docs, at).tolist()
    at += docs
    lengths = np.frombuffer(block, "<i8", docs, at)
    at += 8 * docs
    words = np.frombuffer(block, "<u4", n_words, at)
    doc_ids = [None if gone else d for d, gone in zip(doc_ids, nulls, strict=True)]
    whole = first == 0 and last is None
    last = points if last is None else last
    x, pos = state[first:last].astype(np.uint64), place[first:last].copy()
    parts = len(x)
    out = np.zeros((parts, every, lanes), np.uint32)
    bits, low = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    padded = np.concatenate([words, np.zeros(1, np.uint32)])
    begin = (first + np.arange(parts)) * every * lanes
    lane = np.arange(lanes)
    for t in range(min(every, -(-max(0, n - first * every * lanes) // lanes)) if parts else 0):
        live = begin[:, None] + t * lanes + lane < n
        slot = x & low
        s = table.slots[slot.astype(np.int64)]
        nxt = table.freq[s] * (x >> bits) + slot - table.start[s]
        short = (nxt < LOWEST) & live
        where = pos[:, None] + np.cumsum(short, axis=1) - 1
        nxt = np.where(short, (nxt << WORD_BITS) | padded[np.clip(where, 0, n_words)], nxt)
        pos += short.sum(1)
        x = np.where(live, nxt, x)
        out[:, t] = s
    ids = out.reshape(-1)[: max(0, min(n, last * every * lanes) - first * every * lanes)] if parts else np.zeros(0, np.uint32)
    if whole and zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) != ids_crc:
        raise ValueError("the decoded ids don't match their checksum")
    return doc_ids, lengths, ids


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of the whole text and ``end_id``, packed in 2 or 4 bytes each."""
    width = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], width).tobytes()
    size = int(width[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, width)
        for b in batches:
            got = [encode(x.as_py() or "") + end for x in column(b, "text")]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([len(g) // size for g in got], pa.int64()), pa.array(got, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, size: int, width: str) -> np.ndarray:
    """How often each id occurs in all documents. The driver gets ``size`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                total += np.bincount(np.frombuffer(b"".join(column(b, "ids").slice(i, 1000).to_pylist()), width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row for each id of the vocabulary
        counts[r.id] = r.n
    return counts


class TokenArchive:
    """Blocks and their frequency table in one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, tokens: DataFrame, size: int, width: str, block_ids: int = BLOCK_IDS) -> None:
        """Write (doc_id, n_tokens, ids) in ascending order of doc_id (nulls first)."""
        table = Table.of(count_ids(tokens, size, width)).dump()
        self.spark.createDataFrame([(bytearray(table),)], "freq binary").coalesce(1).write.parquet(f"{self.path}/table")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard, before, coded = TaskContext.get().partitionId(), 0, Table.load(table)
            ids: list[bytes] = []
            names: list = []
            held = 0

            def block() -> pa.RecordBatch:
                lengths = np.array([len(x) for x in ids], np.int64) // int(width[2])
                data = encode_block(np.frombuffer(b"".join(ids), width), names, lengths, coded)
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([before], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([data], pa.binary())], ["shard", "before", "n_ids", "block"])

            for b in batches:
                for d, x in zip(column(b, "doc_id").to_pylist(), column(b, "ids"), strict=True):
                    ids.append(x.as_py())
                    names.append(d)
                    held += len(ids[-1]) // int(width[2])
                    if held >= block_ids:
                        yield block()
                        before += held
                        ids, names, held = [], [], 0
            if names:
                yield block()

        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        # A number beside it, so that rows of one doc_id can be dealt to several tasks too.
        numbered = tokens.withColumn("row_number", F.monotonically_increasing_id())
        ordered = numbered.repartitionByRange(n, "doc_id", "row_number").sortWithinPartitions("doc_id", "row_number")
        ordered.select("doc_id", "ids").mapInArrow(run, "shard long, before long, n_ids long, block binary").write.option("compression", "uncompressed").parquet(f"{self.path}/blocks")

    def read(self, width: str = "<u4", digest: bool = False) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of every document, decoded from the blocks.

        start counts the ids of all documents before it: a block's row says how many its shard has
        before it, and the totals of the shards (one number for each) go through the driver. With
        ``digest`` the unsigned crc32 of the ids comes in place of the ids.
        """
        table = bytes(self.spark.read.parquet(f"{self.path}/table").first().freq)
        blocks = self.spark.read.schema("shard long, before long, n_ids long, block binary").parquet(f"{self.path}/blocks")
        base, before = {}, 0
        for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("total")).orderBy("shard").collect():  # one row for each shard
            base[r.shard] = before
            before += r.total
        size = int(width[2])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded = Table.load(table)
            for b in batches:
                for shard, inside, block in zip(column(b, "shard").to_pylist(), column(b, "before").to_pylist(), column(b, "block"), strict=True):
                    names, lengths, ids = decode_block(block.as_py(), coded)
                    ends = np.cumsum(lengths)
                    raw = memoryview(np.ascontiguousarray(ids, width).tobytes())
                    parts = (raw[(e - k) * size : e * size] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True))
                    last = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array([bytes(x) for x in parts], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base[shard] + inside + ends - lengths), pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

        return blocks.select("shard", "before", "block").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_archive(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, path: str | None = None) -> TokenArchive:
    """Encode every whole text of ``docs`` and write the archive; its path may be given.

    A null or empty text has the end id alone. Repeated rows are documents each. A null doc_id comes
    before all others. An empty table makes an archive without blocks. Other columns aren't read.
    """
    spark = docs.sparkSession
    size = max(vocabulary_size(tokenizer), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    tokens = written(tokenize(docs, tokenizer, end_id), "tokens")
    archive = TokenArchive(spark, path or scratch_path(spark, "archive"))
    archive.write(tokens, size, width)
    return archive
