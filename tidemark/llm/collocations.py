"""Phrase collocations: n-grams that occur together more often than their parts.

1. ``pieces``: texts are cut at punctuation and line ends; identical pieces of a language become one row
   with its number, by partial aggregation.
2. ``gram_counts``: a task turns ``CHUNK`` characters of pieces at a time into weighted n-gram counts and
   sends them, compressed, to hash buckets. A bucket streams into duckdb, which adds it up with a fixed memory
   limit; beyond it duckdb spills to a folder that lives as long as the task, as Spark's own spills do. A frequent n-gram is one row for each chunk, not for each occurrence.
3. ``collocations``: every phrase asks for the counts of its parts: requests and counts meet in a shuffle
   join on part and salt, so that a word that a third of the phrases ask for is in ``SALTS`` tasks; longer parts are asked for by few.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Where pieces end.
ENDS = r"[.,;:!?\x0A-\x0D]"

LONGEST = 3
#: Occurrences that a candidate has at least.
LEAST = 10
#: A phrase goes if a longer one has this percentage of its occurrences.
COVER = 50
TOP = 2000
#: Bytes of pieces that are counted at a time, hash buckets (a task each) for each shuffle partition, and
#: the memory that duckdb may take in a task.
CHUNK = 8_000_000
BUCKETS = 4
MEMORY = "300MB"
SALTS = 16


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, n): the different pieces of each language as they are written, and how often each
    occurs. A null text has none; a null language is ``und``."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    split = docs.select(lang.alias("lang"), F.explode(F.split(F.col(text_col).cast("string"), ENDS)).alias("piece"))
    return split.where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def _duck(folder: str) -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})


def _grams(longest: int, buckets: int) -> str:
    """DuckDB SQL: weighted n-grams of ``chunk`` with their buckets; the empty one counts words. A-Z become
    a-z, and words are what spaces and tabs part."""
    runs = [f"list_transform(range(1, len(ws) - {k - 2}), lambda i: " + " || ' ' || ".join(f"ws[i + {j}]" for j in range(k)) + ")" for k in range(2, longest + 1)]
    every = f"list_concat(ws, {', '.join(runs)})" if len(runs) == 1 else "flatten([ws, " + ", ".join(runs) + "])"
    return f"""
    WITH w AS (SELECT lang, n, list_filter(string_split(translate(piece, '{LETTERS}\t', '{LETTERS.lower()} '), ' '), lambda x: x <> '') AS ws FROM chunk),
    g AS (SELECT lang, n, unnest({every}) AS gram FROM w UNION ALL SELECT lang, n * len(ws), '' FROM w)
    SELECT lang, gram, sum(n)::BIGINT AS n, (hash(gram) % {buckets})::INTEGER AS bucket FROM g GROUP BY lang, gram ORDER BY bucket
    """


def _packed(langs: np.ndarray, grams: pa.StringArray, numbers: np.ndarray) -> bytes:
    """Compressed places of the languages, texts, their lengths, and numbers; the sizes of the first three
    are in front."""
    ends = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1]
    data = grams.buffers()[2]
    pack = zstandard.ZstdCompressor(3).compress
    parts = [pack(langs.astype("<u4").tobytes()), pack(memoryview(data)[ends[0] : ends[-1]] if data else b""), pack(np.diff(ends).astype("<u4").tobytes()), pack(numbers.astype("<i8").tobytes())]
    return struct.pack("<III", *map(len, parts[:3])) + b"".join(parts)


def _unpacked(data: bytes, names: list[str]) -> pa.RecordBatch:
    a, b, c = struct.unpack_from("<III", data)
    open_ = zstandard.ZstdDecompressor().decompress
    cuts = np.cumsum([12, a, b, c])
    langs, text, lengths, counts = (open_(data[x:y]) for x, y in zip(cuts, [*cuts[1:], len(data)], strict=True))
    ends = np.zeros(len(lengths) // 4 + 1, np.int32)
    np.cumsum(np.frombuffer(lengths, "<u4"), out=ends[1:])
    grams = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(text))
    return pa.record_batch([pa.array(names, pa.string()).take(pa.array(np.frombuffer(langs, "<u4"))), grams, pa.array(np.frombuffer(counts, "<i8"))], ["lang", "gram", "n"])


def gram_counts(weighted: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, gram, f) of every run of 1 to ``longest`` words that occurs ``least`` times or more in the
    (lang, piece, n) of ``weighted``; the empty gram has the number of all words."""
    partitions = max(int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    query = _grams(longest, partitions * BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder, _duck(folder) as con:
            held: list[pa.RecordBatch] = []

            def out() -> Iterator[pa.RecordBatch]:
                con.register("chunk", pa.Table.from_batches(held))
                got = con.sql(query).to_arrow_table()
                con.unregister("chunk")
                held.clear()
                if not got.num_rows:
                    return
                got = got.set_column(0, "lang", got["lang"].dictionary_encode()).unify_dictionaries().combine_chunks()
                bucket, lang = got["bucket"].to_numpy(), got["lang"].chunk(0).indices.to_numpy()
                grams, numbers = got["gram"].chunk(0), got["n"].to_numpy()
                starts = [0, *((bucket[1:] != bucket[:-1]).nonzero()[0] + 1).tolist(), len(bucket)]
                names = got["lang"].chunk(0).dictionary.to_pylist()
                for i in range(0, len(starts) - 1, 256):
                    parts = list(zip(starts[i : i + 256], starts[i + 1 : i + 257], strict=False))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket[x] for x, _ in parts], pa.int32()), pa.array([names] * len(parts), pa.list_(pa.string())), pa.array([_packed(lang[x:y], grams.slice(x, y - x), numbers[x:y]) for x, y in parts], pa.binary())], ["bucket", "langs", "counts"])

            size = 0
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= CHUNK:
                    yield from out()
                    size = 0
            if held:
                yield from out()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

        def parts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for names, data in zip(column(b, "langs").to_pylist(), column(b, "counts"), strict=True):
                    yield _unpacked(data.as_py(), names)

        with tempfile.TemporaryDirectory() as folder, _duck(folder) as con:
            con.register("part", pa.RecordBatchReader.from_batches(schema, parts()))
            yield from con.sql(f"SELECT lang, gram, sum(n)::BIGINT AS f FROM part GROUP BY lang, gram HAVING sum(n) >= {least} OR gram = ''").to_arrow_table().to_batches()

    packed = weighted.mapInArrow(count, "bucket int, langs array<string>, counts binary")
    return packed.repartitionById(partitions * BUCKETS, F.col("bucket")).mapInArrow(add_up, "lang string, gram string, f long")


def _run(words: Column, start: int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _runs(words: Column, k: Column, length: int) -> Column:
    """All runs of ``length`` of the k words, if k is more."""
    starts = F.when(k > length, F.sequence(F.lit(1), k - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    a, l and r are the occurrences of the phrase, and of the parts of its lowest-scoring cut; n is the
    language's words; score is floor(1000000 * a * a / (l * r)), exact for a of up to 10^16. Phrases that
    have fewer than ``least`` occurrences, or ``cover`` percent of them or more inside a longer phrase, are left
    out. Ties in score go to the more frequent, then to the smaller phrase in UTF-8 order. Null and empty
    texts have no words, a null language is ``und``; repeated rows count each. An empty table gives an
    empty one; other columns aren't read.
    """
    counts = written(gram_counts(pieces(docs, lang_col, text_col), longest, least), "grams")
    words = F.split("phrase", " ")
    found = counts.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.size(F.split("gram", " ")).alias("k")).where("k > 1")
    cuts = range(1, longest)
    asked = F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(left).alias("left"), (_run(words, 1, c) if left else _run(words, c + 1, F.lit(longest))).alias("part")) for c in cuts for left in (True, False)])
    asking = found.select("lang", "phrase", "a", F.explode(F.filter(asked, lambda x: x["cut"] < F.col("k"))).alias("x"))
    requests = asking.select("lang", F.col("x.part").alias("part"), F.when(F.instr("x.part", " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).alias("salt"), "phrase", "a", F.col("x.cut").alias("cut"), F.col("x.left").alias("left"))
    length = F.size(F.split("gram", " "))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(length == 1, F.lit(SALTS - 1)).otherwise(0).cast("bigint")))
    answers = counts.where((F.col("gram") != "") & (length < longest)).select("lang", F.col("gram").alias("part"), "f", copies.alias("salt"))
    replies = requests.join(answers, ["lang", "part", "salt"]).select("lang", "phrase", "a", "cut", "left", "f", F.lit(None).cast("long").alias("longer"))

    # What each phrase contains, with its own occurrences: the most that a longer one has.
    inner = [_runs(words, F.col("k"), length) for length in range(2, longest)]
    inside = found.select("lang", F.explode(F.flatten(F.array(*inner))).alias("phrase"), F.col("a").alias("longer")) if inner else None
    every = replies if inside is None else replies.unionByName(inside, allowMissingColumns=True)

    pick = lambda c, left: F.max(F.when((F.col("cut") == c) & (F.col("left") == left), F.col("f")))
    known = every.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *[pick(c, left).alias(f"{'l' if left else 'r'}{c}") for c in cuts for left in (True, False)])
    kept = known.where((F.col("longer").isNull()) | (F.lit(100).cast("decimal(38,0)") * F.col("longer") < F.lit(cover).cast("decimal(38,0)") * F.col("a")))
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    scores = [F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(f"({wide(1000000)} * {wide('a')} * {wide('a')}) div ({wide(f'l{c}')} * {wide(f'r{c}')})").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in cuts]
    lowest = F.least(*scores) if len(scores) > 1 else scores[0]
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
