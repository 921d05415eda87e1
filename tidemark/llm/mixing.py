"""Mixing sources to target weights by pivotal dependent rounding.

Each source is taken target / size times over. The whole part of that rate goes to every document;
the fraction is a copy probability that pivotal rounding turns into 0 or 1: two probabilities meet,
mass moves from one to the other at random until one is integral, and the other goes on (Deville and
Tille, 1998). Their sum is kept, so a source's total stays near its target. Documents meet neighbours
in size, so that words are kept about as well as counts. Groups are of bounded size; each leaves at
most one fraction, and a tree of further groups combines those until a source has one, which is
rounded last.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, written

#: Weights by rank of a source's name, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
#: Documents in a first group, about, and fractions in a group of the tree.
GROUP = 4000
FAN_IN = 32
#: Sources are joined by broadcast up to this many; beyond, by a shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Each source's share of all words by weight, none above ``most`` times its own size.

    Sources are ranked by code point, null last. What a stopped source can't take is shared among
    the others by weight until none is above. Exact arithmetic, so the order of sums can't matter.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > whole * most * sizes[s]]
        if not over:
            return out | {s: float(left * weight[s] / whole) for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round probabilities in their order until at most one is a fraction; sum and means are kept."""
    out = p.astype(float).tolist()
    draws = rng.random(len(out)).tolist()
    c = -1
    for i, b in enumerate(out):
        if b <= 0 or b >= 1:
            continue
        if c < 0:
            c = i
            continue
        a = out[c]
        s = a + b
        if abs(s - 1) < 1e-12:
            out[c], out[i] = (1.0, 0.0) if draws[i] < a else (0.0, 1.0)
            c = -1
        elif s < 1:
            if draws[i] < a / s:
                out[c], out[i] = s, 0.0
            else:
                out[c], out[i], c = 0.0, s, i
        elif draws[i] < (1 - b) / (2 - s):
            out[c], out[i], c = 1.0, s - 1, i
        else:
            out[c], out[i] = s - 1, 1.0
    return np.array(out)


#: What is rounded: a unit is all rows of one doc_id, text and source. No id goes through pandas.
UNIT_SCHEMA = "unit long, mark long, size long, source string, p double, class long, salt long"


def _level(rows: DataFrame, keys: list[str], number: int, seed: int) -> DataFrame:
    """Round within groups; a row whose p is still a fraction is the group's residual."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "mark"], kind="stable", ignore_index=True)
        name = zlib.crc32(repr((seed, number, *[None if pd.isna(k) else k for k in key])).encode())
        x["p"] = pivotal(x["p"].to_numpy(), np.random.default_rng(name))
        return x

    return written(rows.groupBy(*keys).applyInPandas(run, UNIT_SCHEMA), f"mix{number}")


def mix_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, text_hash, source, size, many, source_size, target and copies of each different (doc_id,
    text, source): ``many`` rows that are ``copies`` times in the mix together.

    Texts are told apart by a 64-bit hash beside doc_id and source.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(f"`{text_col}`").alias("size"))
    counted = narrow.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("many"))
    units = written(counted.withColumn("unit", F.monotonically_increasing_id()), "units")
    totals = {r.source: (r.size, r.n) for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("size"), F.count_if(F.col("size") > 0).alias("n")).collect()}  # one row for each source
    want = targets({s: v[0] for s, v in totals.items()})
    small = spark.createDataFrame([(s, v[0], want[s], max(1, -(-v[1] // GROUP))) for s, v in totals.items()], "source_name string, source_size long, target double, salts long")
    if len(totals) <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    rate = F.when(F.col("source_size") > 0, F.col("many") * F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(0.0)
    rated = units.join(small, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name").withColumn("rate", rate)
    mark = F.xxhash64(F.lit(seed), "doc_id", "text_hash")  # the order of equal sizes, and the group, whatever the partitioning
    rows = rated.where("size > 0").select("unit", mark.alias("mark"), "size", "source", (F.col("rate") - F.floor("rate")).alias("p"), F.floor(4 * F.log2("size")).alias("class"), F.pmod(mark, F.col("salts")).alias("salt"))
    now = _level(rows, ["source", "class", "salt"], 0, seed)
    salts, classes, number = max([1, *(-(-v[1] // GROUP) for v in totals.values())]), 256, 0
    done = []
    while True:
        done.append(now.where("p <= 0 OR p >= 1"))
        left = now.where("p > 0 AND p < 1")
        if salts == 1 and classes == 1:
            break
        number += 1
        if salts > 1:
            salts = -(-salts // FAN_IN)
            left = left.withColumn("salt", F.floor(F.col("salt") / FAN_IN))
        else:
            classes = -(-classes // FAN_IN)
            left = left.withColumn("class", F.floor(F.col("class") / FAN_IN))
        now = _level(left, ["source", "class", "salt"], number, seed)
    rounded = left.withColumn("p", (F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "source"), F.lit(1 << 40)) / float(1 << 40) < F.col("p")).cast("double"))
    for x in done:
        rounded = rounded.unionByName(x)
    ones = rounded.where("p > 0.5").select("unit", F.lit(1).cast("long").alias("one"))
    copies = F.floor("rate") + F.coalesce("one", F.lit(0))
    return rated.join(ones, "unit", "left").select("doc_id", "text_hash", "source", "size", "many", "source_size", "target", copies.alias("copies"))


def _share(nth: Column) -> Column:
    """Copies of the nth (from 1) of a unit's rows: as even as can be."""
    even = F.floor(F.col("copies") / F.col("many"))
    return even + (nth <= F.col("copies") - even * F.col("many")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies for every row of ``docs``.

    size is the number of words (null text: 0). A row without words, or in a source without words,
    takes nothing. Null sources are one source of their own, ranked last. Rows that repeat doc_id, text
    and source share what they take evenly; rows that only share a doc_id, or have none, are documents
    of their own. Reruns agree whatever the partitioning. An empty table gives an empty one. Other
    columns are not read.
    """
    units = mix_units(docs, id_col, text_col, source_col, seed)
    rows = units.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))).alias("nth"))
    copies = _share(F.col("nth"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_stage(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; those it doesn't take go.

    A row without words is taken once, as it has no weight either way. Nulls, repeated rows and rows that
    share a doc_id: see ``mix``; which of the rows that repeat doc_id, text and source takes one more is
    told by all their columns. Other columns stay, whatever their names.
    """
    from pyspark.sql import Window

    taken = mix_units(docs, seed=seed).withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.col("many")))
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"), F.col("source").alias("mix_source"), "many", "copies")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_hash"), F.col("source").cast("string").alias("row_source"))
    same = (F.col("row_hash") == F.col("mix_hash")) & F.col("row_id").eqNullSafe(F.col("mix_id")) & F.col("row_source").eqNullSafe(F.col("mix_source"))
    joined = rows.join(taken, same)
    even = joined.where("copies % many = 0").select("row", F.expr("copies DIV many").alias("n"))
    nth = F.row_number().over(Window.partitionBy("mix_hash", "mix_id", "mix_source").orderBy(F.xxhash64("row")))
    odd = joined.where("copies % many != 0").select("row", _share(nth).alias("n")).where("n > 0")
    return even.union(odd).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*[F.col(f"row.`{c}`") for c in names])
