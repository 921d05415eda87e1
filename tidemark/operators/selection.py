"""Exact order statistics of large groups with a bounded state.

The range that holds a wanted place is refined by histograms: each pass counts the rows of the range in
``CUTS`` parts and goes on with the part that the place falls in, until no more than ``LIMIT`` rows are left,
which are sorted. What a pass shuffles is a row for each group, part and task; nothing holds a group's
values, however many there are, and equal values need no pass of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows that are sorted at the end, and parts of a range.
LIMIT, CUTS = 65_536, 4096


def _key(a: str, b: str, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _inside(x: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ``x`` in each of the (group, low, high) of ``ranges``."""
    met = x.alias("x").join(ranges.alias("r"), _key("x", "r", group) & F.col("x.value").between(F.col("r.low"), F.col("r.high")))
    return met.select(*[F.col(f"r.{c}") for c in group], F.col("r.low").alias("low"), F.col("r.high").alias("high"), F.col("x.value").alias("value"))


def sizes(rows: DataFrame, group: list[str], value: str | Column) -> tuple[DataFrame, DataFrame]:
    """(values, sizes): the group columns with ``value`` (null and NaN left out), and n, low, high of each."""
    x = rows.select(*group, (F.col(value) if isinstance(value, str) else value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return x, x.groupBy(*group).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def select_places(values: DataFrame, group: list[str], targets: DataFrame) -> DataFrame:
    """(group, target, value): the value at each ``place`` (from 0, in ascending order) of each group.

    ``values`` and the n, low and high in ``targets`` (group, target, place, n, low, high) come from ``sizes``.
    """
    state = stored(targets.select(*group, "target", F.col("place").cast("long").alias("place"), "n", "low", "high"), "places")
    big = (F.col("n") > LIMIT) & (F.col("low") < F.col("high"))
    range_ = [*group, "low", "high"]
    kept = None
    while state.where(big).limit(1).count():
        kept = kept if kept is not None else stored(values, "values")
        part = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CUTS), F.lit(CUTS - 1))
        found = _inside(kept, state.where(big).select(*range_).distinct(), group).groupBy(*range_, part.alias("part")).agg(F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"))
        by = Window.partitionBy(*range_).orderBy("part")  # CUTS rows at most
        placed = found.withColumn("before", F.sum("rows").over(by) - F.col("rows"))
        met = state.where(big).alias("s").join(placed.alias("p"), _key("s", "p", range_) & (F.col("s.place") >= F.col("p.before")) & (F.col("s.place") < F.col("p.before") + F.col("p.rows")))
        finer = met.select(*[F.col(f"s.{c}") for c in (*group, "target")], (F.col("s.place") - F.col("p.before")).alias("place"), F.col("p.rows").alias("n"), F.col("p.least").alias("low"), F.col("p.most").alias("high"))
        state = stored(state.where(~big).unionByName(finer), "places")
    lists = _inside(kept if kept is not None else values, state.where("low < high").select(*range_).distinct(), group).groupBy(*range_).agg(F.sort_array(F.collect_list("value")).alias("all"))  # LIMIT values at most
    met = state.alias("s").join(lists.alias("p"), _key("s", "p", range_), "left")
    return met.select(*[F.col(f"s.{c}") for c in (*group, "target")], F.coalesce(F.get("p.all", F.col("s.place").cast("int")), F.col("s.low")).alias("value"))


def quantiles(rows: DataFrame, group: list[str], value: str | Column, wanted: dict[str, float]) -> DataFrame:
    """The group columns, n, and a column for each of ``wanted`` (name to share): linear quantiles.

    Null and NaN are left out; a group without values gives no row.
    """
    values, size = sizes(rows, group, value)
    size = stored(size, "sizes")
    at = [F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for name, q in wanted.items()]
    both = F.explode(F.array(F.struct(F.lit("low").alias("end"), F.floor("x.at").alias("place")), F.struct(F.lit("high").alias("end"), F.ceil("x.at").alias("place"))))
    asked = size.withColumn("x", F.explode(F.array(*at))).withColumn("e", both)
    targets = asked.select(*group, F.concat_ws(":", "x.name", "e.end").alias("target"), F.col("e.place").alias("place"), "n", "low", "high")
    found = select_places(values, group, targets)
    pick = lambda name, end: F.max(F.when(F.col("target") == f"{name}:{end}", F.col("value")))
    wide = found.groupBy(*group).agg(*[pick(n, e).alias(f"{n}:{e}") for n in wanted for e in ("low", "high")])
    met = size.alias("s").join(wide.alias("w"), _key("s", "w", group))
    part = lambda q: F.lit(q) * (F.col("s.n") - 1) - F.floor(F.lit(q) * (F.col("s.n") - 1))
    between = [(F.col(f"w.`{n}:low`") * (1 - part(q)) + F.col(f"w.`{n}:high`") * part(q)).alias(n) for n, q in wanted.items()]
    return met.select(*[F.col(f"s.{c}") for c in group], F.col("s.n").alias("n"), *between)
