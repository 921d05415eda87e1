"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits. For a radius r each bit gets a non-zero code of r+1 bits, and table v (of
2^(r+1)-1) keeps the bits whose code has odd parity with v. Any two fingerprints that differ in at
most r bits agree on all kept bits of some table (Pagh, CoveringLSH, 2016), so no pair within the
radius is missed. Buckets of a table are then linked without emitting pairs: within a bucket two
fingerprints differ in dropped bits only, and they are within distance 2 exactly when they share a
"halfway" value that each reaches by flipping at most one dropped bit. At most 65 fingerprints share
a halfway value, so groups stay small whatever the bucket holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, fading, written
from .components import connected_components
from .lines import below, filtered, fuzzy_components, let, probable

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; a null text is an empty one (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py() or "") for x in column(b, "text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The kept bits of each table. Bit i has code 1 + i mod (2^(radius+1) - 1)."""
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % tables) & v).bit_count() & 1) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, t) for each table t in which fp shares its bucket with another fingerprint.

    ``distinct`` has one row for each fingerprint. The count in a bucket is a partial aggregation;
    only buckets with two or more come back through the join.
    """
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    return keyed.join(shared, ["t", "key"]).select("fp", "t")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at most ``radius`` (1 or 2) bits apart.

    Not all such pairs are emitted, but enough to connect whatever they connect.
    """
    if radius not in (1, 2):
        raise ValueError("the halfway values used here serve radius 1 and 2")
    every = (1 << BITS) - 1
    flips = []
    for m in covering_masks(radius):
        free = [_signed(1 << i) for i in range(BITS) if (every & ~m) >> i & 1]
        flips.append(F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in free]))
    chosen = F.element_at(F.array(*flips), F.col("t") + 1)
    flipped = candidates(distinct, radius).select("fp", F.explode(chosen).alias("flip")).distinct()
    if radius == 1:  # two values at distance 1 differ by one flip of either
        half = flipped.select("fp", F.least("fp", F.col("fp").bitwiseXOR(F.col("flip"))).alias("a"), F.greatest("fp", F.col("fp").bitwiseXOR(F.col("flip"))).alias("b")).where("a != b")
        return half.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    half = flipped.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("half"), "fp")
    met = half.groupBy("half").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.sort_array(F.collect_set("fp")).alias("fps")).where("lo != hi")  # 65 values at most
    return met.select("lo", F.explode("fps").alias("b")).where("b != lo").select(F.col("lo").alias("a"), "b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach. Null and empty
    texts have fingerprint zero and link like any other; a null doc_id keeps its row and never is a
    component_id unless its component has no other; repeated rows each give a row; other columns
    are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = connected_components(links(first.select("fp"), radius))
    # The smallest doc_id of a component: by fingerprint, so that groups of copies count once.
    linked = parts.select(F.col("node").alias("fp"), "component").join(first, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = first.join(linked.select("fp", "component"), "fp", "left").join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key() -> tuple[Column, Column, Column]:
    """(doc_id, id, check): two hashes of the text stand for it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.col("doc_id").cast("long").alias("near_doc"), F.xxhash64(text).alias("id"), F.xxhash64(F.lit(1), text).alias("check")


def keep_one(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of texts; ``parts`` (id, check, component) names the groups
    of more than one text.

    The row with the smallest (doc_id, id, check) of a group stays, null doc_ids last; of rows that repeat
    both doc_id and text one stays. Only rows that may go are shuffled.
    """
    narrow = docs.select(*text_key()).groupBy("near_doc", "id", "check").agg(F.count("*").alias("many"))
    placed = written(narrow.join(parts, ["id", "check"], "left").select("near_doc", "id", "check", "many", F.struct(F.coalesce("component", "id").alias("name"), F.when(F.col("component").isNull(), F.col("check")).alias("alone")).alias("group")), "placed")
    order = F.struct(F.col("near_doc").isNull(), "near_doc", "id", "check")
    heads = placed.groupBy("group").agg(F.min(order).alias("head"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    unlike = placed.join(heads, placed["group"].eqNullSafe(heads["group"]), "left").select("near_doc", "id", "check", "many", (F.col("head").isNull() | order.eqNullSafe(F.col("head"))).alias("stays"))
    touched = written(unlike.where("NOT stays OR many > 1").select(F.xxhash64("near_doc", "id", "check").alias("spot"), "near_doc", "id", "check", "stays"), "touched")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *text_key()).select("row", F.col("near_doc").alias("row_doc"), F.col("id").alias("row_id"), F.col("check").alias("row_check"), F.xxhash64("near_doc", "id", "check").alias("spot"))
    judged = probable(rows, "spot", touched, touched.count())
    same = (F.col("row_id") == F.col("id")) & (F.col("row_check") == F.col("check")) & F.col("row_doc").eqNullSafe(F.col("near_doc"))
    met = judged.where("hit").join(touched.withColumnRenamed("spot", "touched_spot"), (F.col("spot") == F.col("touched_spot")) & same, "left").where("stays IS NULL OR stays")
    alone = met.where("stays IS NULL").select("row")
    once = met.where("stays IS NOT NULL").dropDuplicates(["row_doc", "row_id", "row_check"]).select("row")
    return judged.where("NOT hit").select("row").unionByName(alone).unionByName(once).select(*[F.col(f"row.`{c}`") for c in names])


def _same_fingerprints(docs: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between ids of texts whose fingerprints are within ``radius``."""
    line = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fps = written(fingerprints(docs.select(F.xxhash64(line).alias("id"), line.alias("line")), "id", "line").distinct(), "near_fps")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    equal = fps.join(first, "fp").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    side = lambda x: first.select(F.col("fp").alias(x), F.col("first").alias("f" + x))
    near = links(first.select("fp"), radius).join(side("a"), "a").join(side("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return equal.union(near)


def _named(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, check, component) of what ``edges`` between ids connect; of texts that share an id by accident
    one takes part."""
    checks = docs.select(*text_key()).groupBy("id").agg(F.min("check").alias("check"))
    return connected_components(edges).withColumnRenamed("node", "id").join(checks, "id").select("id", "check", "component")


def dedup_stage(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row for each component of linked fingerprints.

    See ``keep_one`` for which row stays. Unrelated texts stay even if they share a doc_id or have none.
    An empty table gives an empty one; other columns stay, whatever their names.
    """
    with fading("touched"):
        return keep_one(docs, _named(docs, _same_fingerprints(docs, radius)))


#: Words of a shingle where near copies of documents are told by Jaccard similarity.
NEAR_SHINGLE = 5
#: Texts of so few shingles may share one key only.
ALONE_WORDS = 60


def word_shingles(text: Column) -> Column:
    """All different runs of NEAR_SHINGLE words, as hashes; fewer words are one run."""

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - NEAR_SHINGLE, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(NEAR_SHINGLE)]))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.array_distinct(runs(words)))


def placed_shingles(texts: DataFrame) -> DataFrame:
    """(id, p, hash): a row for each of the p word shingles of each (id, line)."""
    words = texts.select("id", F.regexp_extract_all("line", F.lit(WORD), F.lit(0)).alias("words"))
    counted = words.select("id", "words", F.greatest(F.size("words") - (NEAR_SHINGLE - 1), F.lit(1)).alias("p"))
    placed = counted.select("id", "p", "words", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("at"))
    return placed.select("id", "p", F.xxhash64(*[F.get("words", F.col("at") + j) for j in range(NEAR_SHINGLE)]).alias("hash"))


def near_copies_stage(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row for each group of near copies (see ``keep_one`` for which).

    Two texts are linked if their word shingles have a Jaccard similarity of 0.8 at least (candidates
    come from MinHash signatures over all shingles, each is verified) or if their fingerprints are within
    ``radius``. Null and empty texts, and texts of white space, are copies of each other. Unrelated texts
    stay even if they share a doc_id or have none. An empty table gives an empty one; other columns stay,
    whatever their names.
    """
    line = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("line")
    units = docs.select(line).select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("check"), "line")
    keys = placed_shingles(units).where(below(F.col("hash"), F.col("p"))).select("id", F.col("hash").alias("key"), (F.col("p") <= ALONE_WORDS).alias("alone"))
    found = lambda ids, count: filtered(units, "id", ids, count).join(ids, "id", "left_semi")
    with fading("touched"):
        near = fuzzy_components(keys, found, word_shingles)
        return keep_one(docs, _named(docs, near.select("id", "component").union(_same_fingerprints(docs, radius))))


def brute_force(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """All linked pairs of positions; for tests."""
    return [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= radius]
