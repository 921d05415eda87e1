"""Queries on ordered series: indicators, labels, alignment, structure, dynamics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, dynamics, indicators, labels, ledger, resample, structure, validation
from ..session import shared_path, ship, stored
from ..sources import bars as B
from ..streaming import states
from . import sql as Q

S = ["instrument_id", "timeframe"]
LOOKBACK, HORIZON = 12, 10


def indicator_recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = indicators.recurrences(B.order_bars(spark, sf_dir))
    return found.select(*S, "close_time_ns", *[F.round(c, 4).alias(c) for c in indicators.INDICATORS])


def bollinger_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.bollinger(B.order_bars(spark, sf_dir))
    return found.select(*S, "close_time_ns", F.round("bollinger_middle", 4).alias("bollinger_middle"), *[F.round(c, 2).alias(c) for c in ("bollinger_upper", "bollinger_lower")])


TECHNICAL = ["vote_trend", "vote_slope", "vote_macd", "vote_rsi", "is_range", "direction", "rsi_extreme", "bollinger_position", "counter_reading", "bars_used"]


def technical_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = indicators.technical_direction(B.order_bars(spark, sf_dir))
    return found.select(*S, "close_time_ns", *TECHNICAL, F.round("ema_separation_atr", 6).alias("ema_separation_atr"), F.round("ema_extension", 6).alias("ema_extension"))


def direction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each direction and counter-reading comes up over all bars of each series."""
    ship(spark)
    table = indicators.counter_reading(indicators.direction_votes(indicators.indicator_table(B.order_bars(spark, sf_dir))))
    return table.where("ema50 IS NOT NULL").groupBy("instrument_id", "direction", "counter_reading").agg(F.count("*").alias("bars"))


def causal_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_volatility(B.order_bars(spark, sf_dir), LOOKBACK).select(*S, "close_time_ns", F.round("volatility", 8).alias("volatility"))


def symmetric_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.symmetric_barrier(B.order_bars(spark, sf_dir), LOOKBACK, HORIZON)
    return found.select(*S, F.round("barrier", 8).alias("barrier"), "excursions")


def first_passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.first_passage(B.order_bars(spark, sf_dir), LOOKBACK, HORIZON, 0.6, 0.6).select(*S, "close_time_ns", "direction", "first_passage_bars", "observed_bars")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each label for each series, zeros kept."""
    found = labels.first_passage(B.order_bars(spark, sf_dir), LOOKBACK, HORIZON, 0.6, 0.6)
    return found.groupBy("instrument_id").agg(*[F.count_if(F.col("direction") == d).alias(d.lower()) for d in ("UP", "RANGE", "DOWN", "CENSORED")])


def right_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose label can't be told yet, and how much of their future is known."""
    found = labels.first_passage(B.order_bars(spark, sf_dir), LOOKBACK, HORIZON, 0.6, 0.6)
    return found.where("direction = 'CENSORED'").select("instrument_id", "close_time_ns", "observed_bars")


def range_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of RANGE labels look like: excursions, the bars of their extremes, reversals."""
    bars = B.order_bars(spark, sf_dir)
    ahead = labels.by().rowsBetween(1, HORIZON)
    path = bars.select(*S, "close_time_ns", F.collect_list("high").over(ahead).alias("highs"), F.collect_list("low").over(ahead).alias("lows"), F.collect_list("close").over(ahead).alias("closes"))
    found = labels.first_passage(bars, LOOKBACK, HORIZON, 0.6, 0.6).where("direction = 'RANGE'").select(*S, "close_time_ns", "close", "first_passage_bars")
    both = found.join(path, [*S, "close_time_ns"])
    cut = lambda c: F.slice(c, 1, F.col("first_passage_bars"))
    top, bottom = F.array_max(cut("highs")), F.array_min(cut("lows"))
    steps = F.zip_with(cut("closes"), F.concat(F.array("close"), F.slice("closes", 1, F.col("first_passage_bars") - 1)), lambda a, b: F.signum(a - b))
    moves = F.filter(steps, lambda s: s != 0)
    turns = F.size(F.filter(F.zip_with(F.slice("moves", 2, F.greatest(F.size("moves") - 1, F.lit(0))), F.slice("moves", 1, F.greatest(F.size("moves") - 1, F.lit(0))), lambda a, b: a != b), lambda x: x))
    out = both.withColumn("moves", moves)
    return out.select("instrument_id", "close_time_ns", "first_passage_bars", F.round(top / F.col("close") - 1, 8).alias("up_excursion"), F.round(1 - bottom / F.col("close"), 8).alias("down_excursion"), F.array_position(cut("highs"), top).cast("int").alias("up_bar"), F.array_position(cut("lows"), bottom).cast("int").alias("down_bar"), turns.alias("reversals"))


def frames_with_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.order_bars(spark, sf_dir)
    found = align.frames_with_bars(validation.observations(bars).select(*S, "timestamp_ns", "omega"), bars)
    return found.select(*S, "timestamp_ns", F.round("omega", 8).alias("omega"), "close", "high", "low")


def _frames(bars: DataFrame, value: str = "close") -> DataFrame:
    return bars.select(*S, F.col("close_time_ns").alias("timestamp_ns"), value)


def prior_week_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.order_bars(spark, sf_dir)
    return align.prior_week(_frames(bars), _frames(resample.weekly(bars)), "close")


def _sides(bars: DataFrame, both_ways: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of ``bars`` as left and as right sides of every pair of different series.

    The names of the series, a row each, are broadcast; each row comes once for each other series.
    """
    names = F.broadcast(bars.select(F.col("instrument_id").alias("name")).distinct())
    mine = bars.join(names, F.col("instrument_id") != F.col("name") if both_ways else F.col("instrument_id") < F.col("name"))
    other = bars.join(names, F.col("instrument_id") != F.col("name") if both_ways else F.col("instrument_id") > F.col("name"))
    return mine.withColumn("pair", F.concat_ws("~", "instrument_id", "name")), other.withColumn("pair", F.concat_ws("~", "name", "instrument_id"))


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hourly bar of an event type with the last earlier value of any bar of each other type."""
    left, right = _sides(_frames(B.event_bars(spark, sf_dir)), True)
    return align.asof(left, right, ["pair"], "timestamp_ns", "close", True, 6 * Q.HOUR).select("pair", "timestamp_ns", F.col("close_at").alias("other_at"), F.col("close").alias("other_close"))


def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times that each pair of order series has in common."""
    left, right = _sides(_frames(B.order_bars(spark, sf_dir)), False)
    return align.exact_pairs(left, right, ["pair"])


def greedy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each pair of order series paired in order, at most a day apart."""
    ship(spark)
    left, right = _sides(_frames(B.order_bars(spark, sf_dir)), False)
    return align.greedy_band(left, right, ["pair"], Q.DAY)


def union_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _frames(B.order_bars(spark, sf_dir))
    odd = F.expr(f"(timestamp_ns DIV {Q.DAY}) % 2 = 1")
    return align.union_pool(bars.where(odd), bars.where(~odd), [*S, "timestamp_ns"])


def appended_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.order_bars(spark, sf_dir)
    edge = 900 * 10 * Q.DAY
    whole = align.append_later(bars.where(F.col("close_time_ns") <= edge), bars.where(F.col("close_time_ns") > edge))
    return whole.groupBy(*S).agg(F.count("*").alias("bars"), F.max("close_time_ns").alias("last_ns"))


def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.order_bars(spark, sf_dir)
    by = labels.by()
    frames = bars.select(*S, F.col("close_time_ns").alias("timestamp_ns"), F.array("close", F.lag("close", 5).over(by), F.lag("high", 9).over(by)).alias("values"))
    named = labels.first_passage(bars, LOOKBACK, HORIZON, 0.6, 0.6).where("direction <> 'CENSORED'").select(*S, F.col("close_time_ns").alias("timestamp_ns"))
    return align.complete_cases(frames, "values", named, [*S, "timestamp_ns"]).select(*S, "timestamp_ns")


def cross_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vote across timeframes for each nation, its directions made up from customers."""
    frame = F.element_at(F.array(*map(F.lit, ("M1", "M5", "H1", "H4", "D1", "W1"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = B.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("instrument_id"), frame.alias("timeframe"), "c_custkey").groupBy("instrument_id", "timeframe").agg(F.max("c_custkey").alias("k"))
    named = rows.select("instrument_id", "timeframe", F.element_at(F.array(*map(F.lit, ("UP", "DOWN", "RANGE", "UNAVAILABLE", "UP"))), (F.col("k") % 5 + 1).cast("int")).alias("direction"))
    return align.cross_scale(named)


def kernel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in kernel rows made from bars: the kernel itself is an input to this library."""
    return kernel_of(B.order_bars(spark, sf_dir))


def kernel_of(b: DataFrame) -> DataFrame:
    """Stand-in kernel rows of any bars."""
    made = {"delta": "(high - low) / close", "delta_tilde": "(close - open) / open", "xi": "0.2D * (high - low) / close", "lambda": "0.1D + 0.9D * (trade_count % 10) / 10", "theta": "1D + (high - low) / high", "M": "(close - open) / open", "G": "(high - close) / close", "A": "2D * (high - low) / close"}
    return b.select(*S, F.col("close_time_ns").alias("timestamp_ns"), *[F.expr(e).alias(n) for n, e in made.items()])


def bounded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.bounded_state(kernel_rows(spark, sf_dir)).select(*S, "timestamp_ns", *[F.round(a, 8).alias(a) for a in structure.AXES])


def robust_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.paths(structure.robust_geometry(structure.bounded_state(kernel_rows(spark, sf_dir))))
    return found.select(*S, "timestamp_ns", F.round("delta", 6).alias("delta"), F.round("margin", 6).alias("margin"), F.round("path_length", 6).alias("path_length"), "ready")


def observer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = structure.observer(structure.paths(structure.robust_geometry(structure.bounded_state(kernel_rows(spark, sf_dir)))))
    return found.groupBy("instrument_id", "transport", "state").agg(F.count("*").alias("bars"))


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``observer_states`` from a stream: the rows arrive in three parts by time, each its own run of the query,
    and the last run is sent the second part again."""
    ship(spark)
    rows = stored(structure.paths(structure.robust_geometry(structure.bounded_state(kernel_rows(spark, sf_dir)))), "paths")
    low, high = rows.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    source, out, progress = (shared_path(spark, x) for x in ("arriving", "states", "progress"))
    edges = [low, low + (high - low) // 3, low + 2 * (high - low) // 3, high + 1] if low is not None else [0, 0, 0, 0]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states.prepare(spark)
    try:
        for first, until in ((0, 1), (1, 2), (1, 3)):
            rows.where((F.col("timestamp_ns") >= edges[first]) & (F.col("timestamp_ns") < edges[until])).write.mode("append").parquet(source)
            stream = states.observer_stream(spark.readStream.schema(rows.schema).parquet(source))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(structure.OBSERVED_ROW).parquet(out)
    return found.groupBy("instrument_id", "transport", "state").agg(F.count("*").alias("bars"))


def structural_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return structure.snapshot(structure.stack(kernel_rows(spark, sf_dir)))


def structural_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and structural readings of the last bar of each series."""
    ship(spark)
    seen = structure.observer(structure.paths(structure.robust_geometry(structure.bounded_state(kernel_rows(spark, sf_dir)))))
    rows = seen.join(structure.exponential_memory(seen, "deficit"), [*S, "timestamp_ns"])
    last = rows.groupBy(*S).agg(*[F.max_by(c, "timestamp_ns").alias(c) for c in ("coherence", "recurrence", "prior_memory")])
    found = indicators.contrast(indicators.technical_direction(B.order_bars(spark, sf_dir)), last)
    return found.select(*S, "direction", "state", F.size("evidence").alias("readings"), F.array_join(F.transform("evidence", lambda e: e["quality"]), ",").alias("qualities"))


def exponential_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = kernel_rows(spark, sf_dir).withColumn("deficit", F.expr("CASE WHEN lambda > 0.2D THEN delta END"))
    found = structure.exponential_memory(rows, "deficit")
    return found.select(*S, "timestamp_ns", F.round("prior_memory", 8).alias("prior_memory"), F.round("memory", 8).alias("memory"))


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.weighted_mean(kernel_rows(spark, sf_dir), "delta", 32, 0.9)
    return found.select(*S, "timestamp_ns", F.round("weighted_mean", 8).alias("weighted_mean"))


def relative_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.relative_magnitude(kernel_rows(spark, sf_dir), "M")
    return found.select(*S, "timestamp_ns", F.round("relative", 8).alias("relative"))


def differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.differential(kernel_rows(spark, sf_dir), "delta", "lambda")
    return found.select(*S, "timestamp_ns", *[F.round(c, 6).alias(c) for c in ("differential", "trend", "exposure")])


def ledger_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs, benefits and their differences, with stand-ins for the observer's two columns."""
    seen = {"coherence": "CASE WHEN lambda > 0.2D THEN delta / (1 + delta) END", "contraction": "CASE WHEN lambda < 0.95D THEN least(xi / theta, 1D) END"}
    found = ledger.ledger(kernel_rows(spark, sf_dir).withColumns({c: F.expr(e) for c, e in seen.items()}))
    return found.select(*S, "timestamp_ns", *[F.round(c, 7).alias(c) for c in found.columns if c not in (*S, "timestamp_ns")])


def series_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.snapshot(B.order_bars(spark, sf_dir).select(*S, F.col("close_time_ns").alias("timestamp_ns"), "trade_count"))
    return found.select(*S, "timestamp_ns", F.get_json_object("document", "$.trade_count").cast("long").alias("trade_count"))


def dynamics_input(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    b = B.order_bars(spark, sf_dir)
    b = resample.weekly(b) if weekly else b
    x = [F.expr(e) for e in ("(high - low) / close", "(close - open) / open", "open / high", "low / high", "close / high", "low / close")]
    state = F.when(F.col("close") > F.col("open"), "VIABLE").otherwise("DISRUPTED")
    return b.select(*S, F.col("close_time_ns").alias("timestamp_ns"), x[0].alias("delta"), (F.col("low") / F.col("high")).alias("lambda"), state.alias("state"), F.array(*x).alias("values"))


DYNAMICS = [*dynamics.DERIVATIVES, *dynamics.STATISTICS, *dynamics.MULTISCALE]


def dynamics_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dynamics.features(dynamics_input(spark, sf_dir), dynamics_input(spark, sf_dir, True))
    whole = ("regime_age", "momentum_streak")
    return found.select(*S, "timestamp_ns", *[F.col(c).cast("long").alias(c) if c in whole else F.round(c, 5).alias(c) for c in DYNAMICS])


def dynamics_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and complete rows of each nested variant."""
    rows = dynamics.features(dynamics_input(spark, sf_dir), dynamics_input(spark, sf_dir, True))
    out = None
    for name in dynamics.VARIANTS:
        v = dynamics.variant(rows, name).agg(F.lit(name).alias("variant"), F.max(F.size("vector")).cast("long").alias("dimensions"), F.count_if(F.forall("vector", lambda x: x.isNotNull())).alias("complete"))
        out = v if out is None else out.unionByName(v)
    return out


def series_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, agreement and relation of each pair of order series at equal timestamps."""
    x = dynamics_input(spark, sf_dir)
    a = x.select(F.col("instrument_id").alias("one"), "timestamp_ns", F.col("values").alias("a"), F.col("state").alias("sa"))
    b = x.select(F.col("instrument_id").alias("other"), "timestamp_ns", F.col("values").alias("b"), F.col("state").alias("sb"))
    pairs = a.join(b, "timestamp_ns").where("one < other").withColumn("pair", F.concat_ws("~", "one", "other"))
    similar = dynamics.cosine_of_pairs(pairs)
    same, always = F.col("sa") == F.col("sb"), F.lit(True)
    # The ledger's and the memory's states have one value wherever they are causal, as here all rows are.
    words = {"kernel": dynamics.agreement((F.col("a")[0] > 0) & (F.col("b")[0] > 0), same), "observer": dynamics.agreement(always, same), "ledger": dynamics.agreement(always, always), "memory": dynamics.agreement(always, always)}
    both = similar.join(pairs.groupBy("pair").agg(*[w.alias(n) for n, w in words.items()]), "pair")
    return both.select("pair", "rows", F.round("similarity", 8).alias("similarity"), *words, dynamics.relation(F.col("similarity"), [F.col(n) for n in words]).alias("relation"))


QUERIES = {f.__name__: f for f in (indicator_recurrences, bollinger_bands, technical_direction, direction_history, causal_volatility, symmetric_barrier, first_passage_labels, label_counts, right_censored, range_trajectories, frames_with_bars, prior_week_asof, asof_events, exact_pairs, greedy_band, union_pool, appended_series, complete_cases, cross_scale, bounded_state, robust_geometry, observer_states, streamed_states, structural_vectors, structural_contrast, exponential_memory, weighted_mean, relative_magnitude, differentials, ledger_trajectory, series_snapshots, dynamics_features, dynamics_variants, series_similarity)}

#: One row for each bar and step of the recurrences, as a recursive query over row numbers.
RECURSION = f"""{Q.ORDER_BARS},
b AS MATERIALIZED (SELECT {Q.SERIES}, close_time_ns, rn, high, low, close,
  CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) ELSE 0 END AS tr,
  CASE WHEN rn > 1 AND close - pc >= 0 THEN close - pc ELSE 0 END AS gain, CASE WHEN rn > 1 AND close - pc < 0 THEN pc - close ELSE 0 END AS loss,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS down
  FROM (SELECT *, row_number() OVER ({Q.BY}) AS rn, lag(close) OVER ({Q.BY}) AS pc, lag(high) OVER ({Q.BY}) AS ph, lag(low) OVER ({Q.BY}) AS pl FROM bars)),
"""


def _ema(p: int) -> str:
    k = f"(2.0::DOUBLE / {p + 1})"
    return f"CASE WHEN b.rn < {p} THEN r.e{p} + b.close WHEN b.rn = {p} THEN (r.e{p} + b.close) / {p} ELSE b.close * {k} + r.e{p} * (1.0::DOUBLE - {k}) END AS e{p}"


def _wil(name: str, expr: str) -> str:
    return f"CASE WHEN b.rn < 15 THEN r.{name} + {expr} WHEN b.rn = 15 THEN (r.{name} + {expr}) / 14 ELSE (r.{name} * 13 + {expr}) / 14 END AS {name}"


RECURSION = f"""WITH RECURSIVE {RECURSION}
r AS (
  SELECT {Q.SERIES}, rn, close AS e12, close AS e20, close AS e26, close AS e50, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, 0.0::DOUBLE AS a, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m FROM b WHERE rn = 1
  UNION ALL
  SELECT b.instrument_id, b.timeframe, b.rn, {', '.join(_ema(p) for p in (12, 20, 26, 50))}, {_wil('g', 'b.gain')}, {_wil('l', 'b.loss')}, {_wil('a', 'b.tr')},
    CASE WHEN b.rn < 15 THEN r.p + b.up WHEN b.rn = 15 THEN 100.0 * ((r.p + b.up) / 14) / ((r.a + b.tr) / 14) ELSE (r.p * 13 + 100.0 * b.up / ((r.a * 13 + b.tr) / 14)) / 14 END AS p,
    CASE WHEN b.rn < 15 THEN r.m + b.down WHEN b.rn = 15 THEN 100.0 * ((r.m + b.down) / 14) / ((r.a + b.tr) / 14) ELSE (r.m * 13 + 100.0 * b.down / ((r.a * 13 + b.tr) / 14)) / 14 END AS m
  FROM r JOIN b ON b.instrument_id = r.instrument_id AND b.timeframe = r.timeframe AND b.rn = r.rn + 1),
s AS MATERIALIZED (SELECT r.*, b.close_time_ns, b.close, e12 - e26 AS line, CASE WHEN r.rn >= 15 THEN CASE WHEN p + m > 0 THEN 100.0 * abs(p - m) / (p + m) ELSE 0 END END AS dx FROM r JOIN b USING (instrument_id, timeframe, rn)),
q AS (
  SELECT {Q.SERIES}, rn, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS adx FROM s WHERE rn = 1
  UNION ALL
  SELECT s.instrument_id, s.timeframe, s.rn,
    CASE WHEN s.rn < 26 THEN 0 WHEN s.rn <= 34 THEN q.sig + s.line WHEN s.rn = 35 THEN q.sig / 9 ELSE s.line * 0.2::DOUBLE + q.sig * 0.8::DOUBLE END,
    CASE WHEN s.rn < 15 THEN 0 WHEN s.rn < 28 THEN q.adx + s.dx WHEN s.rn = 28 THEN (q.adx + s.dx) / 14 ELSE (q.adx * 13 + s.dx) / 14 END
  FROM q JOIN s ON s.instrument_id = q.instrument_id AND s.timeframe = q.timeframe AND s.rn = q.rn + 1),
i AS (SELECT s.instrument_id, s.timeframe, s.rn, close_time_ns, close,
  CASE WHEN s.rn >= 12 THEN e12 END AS ema12, CASE WHEN s.rn >= 20 THEN e20 END AS ema20, CASE WHEN s.rn >= 26 THEN e26 END AS ema26, CASE WHEN s.rn >= 50 THEN e50 END AS ema50,
  CASE WHEN s.rn >= 26 THEN line END AS macd_line, CASE WHEN s.rn >= 35 THEN sig END AS macd_signal, CASE WHEN s.rn >= 35 THEN line - sig END AS macd_histogram,
  CASE WHEN s.rn >= 15 THEN CASE WHEN l > 0 THEN 100.0 - 100.0 / (1.0 + g / l) ELSE 100.0 END END AS rsi14, CASE WHEN s.rn >= 15 THEN a END AS atr14, CASE WHEN s.rn >= 28 THEN adx END AS adx14
  FROM s JOIN q USING (instrument_id, timeframe, rn))"""

W20 = f"({Q.BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
JUDGED = f"""{RECURSION},
v AS (SELECT *, count(*) OVER (PARTITION BY {Q.SERIES}) AS bars_used, ema20 - lag(ema20) OVER ({Q.BY}) AS slope, CASE WHEN atr14 > 0 THEN abs(ema20 - ema50) / atr14 END AS sep,
  CASE WHEN count(*) OVER {W20} = 20 THEN avg(close) OVER {W20} END AS mid, stddev_pop(close) OVER {W20} AS dev FROM i),
u AS (SELECT *, CASE WHEN ema20 IS NULL OR ema50 IS NULL THEN 'UNAVAILABLE' WHEN ema20 > ema50 THEN 'UP' ELSE 'DOWN' END AS vote_trend, CASE WHEN slope IS NULL THEN 'UNAVAILABLE' WHEN slope > 0 THEN 'UP' ELSE 'DOWN' END AS vote_slope,
  CASE WHEN macd_histogram IS NULL THEN 'UNAVAILABLE' WHEN macd_histogram > 0 THEN 'UP' ELSE 'DOWN' END AS vote_macd, CASE WHEN rsi14 IS NULL THEN 'UNAVAILABLE' WHEN rsi14 >= 50 THEN 'UP' ELSE 'DOWN' END AS vote_rsi,
  coalesce(adx14 < 20 AND sep < 0.5, FALSE) AS is_range, CASE WHEN rsi14 >= 70 THEN 'DOWN' WHEN rsi14 <= 30 THEN 'UP' END AS rsi_extreme,
  CASE WHEN close > mid + 2 * dev THEN 'DOWN' WHEN close < mid - 2 * dev THEN 'UP' END AS bollinger_position, CASE WHEN atr14 > 0 THEN (close - ema20) / atr14 END AS ext FROM v),
t AS (SELECT *, len(list_filter([vote_trend, vote_slope, vote_macd, vote_rsi], lambda x: x = 'UP')) AS ups, len(list_filter([vote_trend, vote_slope, vote_macd, vote_rsi], lambda x: x = 'DOWN')) AS downs FROM u),
j AS (SELECT *, CASE WHEN is_range THEN 'RANGE' WHEN ups > downs THEN 'UP' WHEN downs > ups THEN 'DOWN' WHEN vote_slope = 'UP' THEN 'UP' ELSE 'DOWN' END AS direction,
  coalesce(rsi_extreme, bollinger_position, CASE WHEN ext > 2 THEN 'DOWN' WHEN ext < -2 THEN 'UP' END, 'NONE') AS counter_reading FROM t)"""

VOLATILITY = f"""{Q.ORDER_BARS}, rr AS (SELECT *, row_number() OVER ({Q.BY}) AS rn, (high - low) / lag(close) OVER ({Q.BY}) AS ratio FROM bars),
vol AS (SELECT *, CASE WHEN rn > 1 THEN quantile_cont(CASE WHEN ratio > 0 THEN ratio END, 0.5) OVER ({Q.BY} ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW) END AS volatility FROM rr)"""

LABELS = f"""{VOLATILITY}, fut AS (SELECT *, list({{'h': high, 'l': low}}) OVER ({Q.BY} ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS f, close * (1 + volatility * 0.6::DOUBLE) AS u, close * (1 - volatility * 0.6::DOUBLE) AS d FROM vol),
hit AS (SELECT *, list_position(list_transform(f, lambda x: x.h >= u OR x.l <= d), TRUE) AS pos FROM fut WHERE volatility IS NOT NULL AND len(f) > 0),
lab AS (SELECT {Q.SERIES}, close_time_ns, close, CASE WHEN pos > 0 THEN CASE WHEN f[pos].h >= u AND f[pos].l > d THEN 'UP' WHEN f[pos].h < u AND f[pos].l <= d THEN 'DOWN' ELSE 'RANGE' END WHEN len(f) >= {HORIZON} THEN 'RANGE' ELSE 'CENSORED' END AS direction,
  CAST(CASE WHEN pos > 0 THEN pos WHEN len(f) >= {HORIZON} THEN {HORIZON} END AS INTEGER) AS first_passage_bars, CAST(len(f) AS INTEGER) AS observed_bars FROM hit)"""

WEEK_OF = "epoch_ns(date_trunc('week', make_timestamp_ns({})))"
KERNEL = f"""{Q.ORDER_BARS}, k AS (SELECT {Q.SERIES}, close_time_ns AS timestamp_ns, (high - low) / close AS delta, (close - open) / open AS delta_tilde, 0.2::DOUBLE * (high - low) / close AS xi,
  0.1::DOUBLE + 0.9::DOUBLE * (trade_count % 10) / 10 AS lam, 1::DOUBLE + (high - low) / high AS theta, (close - open) / open AS m, (high - close) / close AS g, 2::DOUBLE * (high - low) / close AS a FROM bars)"""
KBY = f"PARTITION BY {Q.SERIES} ORDER BY timestamp_ns"
STATE = f"""{KERNEL}, st AS (SELECT {Q.SERIES}, timestamp_ns, CASE WHEN delta_tilde <= 0 THEN 0 ELSE delta_tilde / (1 + delta_tilde) END AS delta, greatest(least(xi / theta, 1), 0) AS xi_occupancy,
  greatest(least((lam - 0.1::DOUBLE) / (1.0::DOUBLE - 0.1::DOUBLE), 1), 0) AS capacity, 0.5 + 0.5 * tanh(m / theta) AS margin, 0.5 + 0.5 * tanh(g) AS trend, CASE WHEN a <= 0 THEN 0 ELSE a / (1 + a) END AS accumulated_excess FROM k)"""
AXES = structure.AXES


def _ledger_sql() -> str:
    held, prior = f"{KBY} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW", f"{KBY} ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING"
    faded = lambda x: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * pow({ledger.DECAY}::DOUBLE, len({x}) - i))) / list_sum(list_transform(range(1, len({x}) + 1), lambda i: pow({ledger.DECAY}::DOUBLE, len({x}) - i)))"
    channels = (*ledger.COSTS, *ledger.BENEFITS)
    usual = ", ".join(f"CASE WHEN count({c}) OVER pr >= 8 THEN quantile_cont(abs({c}), 0.5) OVER pr END AS u_{c}" for c in channels)
    parts = ", ".join(f"CASE WHEN u_{c} > 0 THEN abs({c}) / (abs({c}) + u_{c}) WHEN u_{c} = 0 AND {c} = 0 THEN 0 END AS relative_{c}" for c in channels)
    gaps = ", ".join(f"relative_{c} - relative_{b} AS {d}" for d, (c, b) in ledger.DIFFERENTIALS.items())
    ends = ", ".join(f"{d}, {d} - lag({d}) OVER ({KBY}) AS {d}_trend, coalesce(sum(greatest({d}, 0)) FILTER ({d} IS NOT NULL) OVER ({KBY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {d}_exposure" for d in ledger.DIFFERENTIALS)
    names = [*channels, *[f"relative_{c}" for c in channels], *[f"{d}{x}" for d in ledger.DIFFERENTIALS for x in ("", "_trend", "_exposure")]]
    return f"""WITH {KERNEL}, o AS (SELECT *, (CASE WHEN lam > 0.2::DOUBLE THEN delta / (1 + delta) END) * (1 - CASE WHEN lam < 0.95::DOUBLE THEN least(xi / theta, 1) END) AS org FROM k),
l AS (SELECT *, list(xi) OVER h AS xis, list(greatest(-g, 0)) OVER h AS falls, greatest(a - first_value(a) OVER h, 0) AS accumulated_debt, greatest(first_value(lam) OVER ({KBY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - lam, 0) AS capacity_consumption,
  avg(CASE WHEN xi > theta THEN 1.0 ELSE 0.0 END) OVER h AS excess_persistence, greatest(lam - min(lam) OVER h, 0) AS structural_recovery, CASE WHEN count(org) OVER h >= 8 THEN avg(org) OVER h END AS adaptive_organization_level FROM o WINDOW h AS ({held})),
c AS (SELECT *, {faded('xis')} AS retained_friction, {faded('falls')} AS adverse_trend FROM l), q AS (SELECT *, {usual} FROM c WINDOW pr AS ({prior})), t AS (SELECT *, {parts} FROM q), d AS (SELECT *, {gaps} FROM t),
e AS (SELECT {Q.SERIES}, timestamp_ns, {', '.join(names[: 2 * len(channels)])}, {ends} FROM d)
SELECT {Q.SERIES}, timestamp_ns, {', '.join(f'round({n}, 7) AS {n}' for n in names)} FROM e"""



def _geometry() -> str:
    held = ", ".join(f"list({a}) OVER ({KBY} ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS p_{a}" for a in AXES)
    centre = ", ".join(f"list_median(p_{a}) AS c_{a}" for a in AXES)
    scale = ", ".join(f"CASE WHEN list_median(list_transform(p_{a}, lambda x: abs(x - c_{a}))) > 0 THEN list_median(list_transform(p_{a}, lambda x: abs(x - c_{a}))) ELSE (list_max(p_{a}) - list_min(p_{a})) / 2 END AS s_{a}" for a in AXES)
    final = ", ".join(f"CASE WHEN s_{a} > 0 THEN 0.5 + 0.5 * tanh(({a} - c_{a}) / s_{a}) ELSE 0.5 END AS {a}" for a in AXES)
    step = " + ".join(f"pow({a} - lag({a}) OVER ({KBY}), 2)" for a in AXES)
    return f"""WITH {STATE}, g1 AS (SELECT *, {held} FROM st), g2 AS (SELECT *, {centre} FROM g1), g3 AS (SELECT *, {scale} FROM g2),
g4 AS (SELECT {Q.SERIES}, timestamp_ns, {final} FROM g3), g5 AS (SELECT *, sqrt(({step}) / 6) AS step, row_number() OVER ({KBY}) AS rn FROM g4)
SELECT {Q.SERIES}, timestamp_ns, round(delta, 6) AS delta, round(margin, 6) AS margin, round(coalesce(sum(step) OVER ({KBY} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0), 6) AS path_length, rn >= 8 AS ready FROM g5"""


WEEKLY = f"""w0 AS (SELECT *, {WEEK_OF.format('open_time_ns')} AS week_ns FROM bars),
w1 AS (SELECT instrument_id, week_ns, max(close_time_ns) AS close_time_ns, arg_min(open, open_time_ns) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ns) AS close FROM w0 GROUP BY 1, 2),
w AS (SELECT * FROM (SELECT *, max(week_ns) OVER (PARTITION BY instrument_id) AS latest FROM w1) WHERE week_ns < latest OR close_time_ns + 1000000 >= week_ns + {7 * Q.DAY})"""

FIELDS = "[(high - low) / close, (close - open) / open, open / high, low / high, close / high, low / close]"


def _dynamics() -> str:
    z = lambda x: f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER e >= 2 THEN CASE WHEN stddev_pop({x}) OVER e > 0 THEN ({x} - avg({x}) OVER e) / stddev_pop({x}) OVER e ELSE 0 END END"
    return f"""{Q.ORDER_BARS}, {WEEKLY},
d0 AS (SELECT {Q.SERIES}, close_time_ns AS timestamp_ns, (high - low) / close AS delta, 1.0::DOUBLE - low / high AS pressure, CASE WHEN close > open THEN 'VIABLE' ELSE 'DISRUPTED' END AS state, {FIELDS} AS v, {WEEK_OF.format('close_time_ns')} AS week_ns FROM bars),
wk0 AS (SELECT instrument_id, close_time_ns, {WEEK_OF.format('close_time_ns')} AS wn, {FIELDS} AS wv FROM w),
wk AS (SELECT instrument_id, wn, arg_max(wv, close_time_ns) AS wv FROM wk0 GROUP BY 1, 2),
d1 AS (SELECT d0.*, wv FROM d0 ASOF LEFT JOIN wk ON d0.instrument_id = wk.instrument_id AND d0.week_ns > wk.wn),
d2 AS (SELECT *, delta - lag(delta) OVER ({KBY}) AS vel, lag(v) OVER ({KBY}) AS pv FROM d1),
d3 AS (SELECT *, lag(vel) OVER ({KBY}) AS pvel, CASE WHEN pv IS NOT NULL THEN sqrt(list_sum(list_transform(list_zip(v, pv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 6) END AS tran,
  CASE WHEN wv IS NOT NULL THEN sqrt(list_sum(list_transform(list_zip(v, wv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 6) END AS disp,
  CASE WHEN wv IS NOT NULL THEN list_dot_product(v, wv) / sqrt(list_dot_product(v, v) * list_dot_product(wv, wv)) END AS coh FROM d2),
d4 AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER ({KBY}) THEN 1 ELSE 0 END AS nr, CASE WHEN pvel IS NULL OR sign(vel) <> sign(pvel) THEN 1 ELSE 0 END AS ns FROM d3),
d5 AS (SELECT *, sum(nr) OVER ({KBY}) AS ri, sum(ns) OVER ({KBY}) AS si, {z('pressure')} AS pressure_z, {z('vel')} AS momentum_z, {z('tran')} AS transition_z,
  lag(pressure) OVER ({KBY}) - pressure AS rec, disp - last_value(disp IGNORE NULLS) OVER e AS dchange FROM d4 WINDOW e AS ({KBY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dyn AS (SELECT {Q.SERIES}, timestamp_ns, v, vel AS delta_velocity, vel - pvel AS delta_acceleration, CASE WHEN vel IS NOT NULL AND pvel IS NOT NULL THEN CASE WHEN sign(vel) * sign(pvel) < 0 THEN least(abs(vel), abs(pvel)) ELSE 0 END END AS delta_reversal,
  pressure_z, momentum_z, transition_z, row_number() OVER (PARTITION BY {Q.SERIES}, ri ORDER BY timestamp_ns) AS regime_age, CASE WHEN vel IS NOT NULL THEN row_number() OVER (PARTITION BY {Q.SERIES}, si ORDER BY timestamp_ns) END AS momentum_streak,
  rec AS pressure_recovery, disp AS scale_dispersion, coh AS scale_coherence, dchange AS scale_dispersion_change FROM d5)"""


def _round(names, places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in names)


def _variant_sql(name: str) -> str:
    added = dynamics.VARIANTS[name]
    full = " AND ".join(f"{c} IS NOT NULL" for c in added) or "TRUE"
    return f"SELECT '{name}' AS variant, CAST({6 + len(added)} AS BIGINT) AS dimensions, CAST(count(*) FILTER ({full}) AS BIGINT) AS complete FROM dyn"


ORACLE = {
    "indicator_recurrences": f"{RECURSION} SELECT {Q.SERIES}, close_time_ns, {_round(indicators.INDICATORS, 4)} FROM i",
    "bollinger_bands": f"WITH {Q.ORDER_BARS}, x AS (SELECT {Q.SERIES}, close_time_ns, count(*) OVER {W20} AS n, avg(close) OVER {W20} AS m, stddev_pop(close) OVER {W20} AS s FROM bars) SELECT {Q.SERIES}, close_time_ns, CASE WHEN n = 20 THEN round(m, 4) END AS bollinger_middle, CASE WHEN n = 20 THEN round(m + 2 * s, 2) END AS bollinger_upper, CASE WHEN n = 20 THEN round(m - 2 * s, 2) END AS bollinger_lower FROM x",
    "technical_direction": f"{JUDGED} SELECT {Q.SERIES}, close_time_ns, {', '.join(TECHNICAL)}, round(sep, 6) AS ema_separation_atr, round(ext, 6) AS ema_extension FROM j WHERE rn = bars_used AND bars_used >= 60",
    "direction_history": f"{JUDGED} SELECT instrument_id, direction, counter_reading, count(*) AS bars FROM j WHERE ema50 IS NOT NULL GROUP BY ALL",
    "causal_volatility": f"WITH {VOLATILITY} SELECT {Q.SERIES}, close_time_ns, round(volatility, 8) AS volatility FROM vol",
    "symmetric_barrier": f"""WITH {VOLATILITY}, tr AS (SELECT *, max(high) OVER ({Q.BY} ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS top, min(low) OVER ({Q.BY} ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS bottom FROM vol),
ex AS (SELECT {Q.SERIES}, greatest(top / close - 1, 0) / volatility AS x FROM tr WHERE rn > 1 AND volatility IS NOT NULL AND top IS NOT NULL UNION ALL SELECT {Q.SERIES}, greatest(1 - bottom / close, 0) / volatility FROM tr WHERE rn > 1 AND volatility IS NOT NULL AND top IS NOT NULL)
SELECT {Q.SERIES}, round(quantile_cont(x, 0.5), 8) AS barrier, count(*) AS excursions FROM ex GROUP BY ALL""",
    "first_passage_labels": f"WITH {LABELS} SELECT {Q.SERIES}, close_time_ns, direction, first_passage_bars, observed_bars FROM lab",
    "label_counts": f"WITH {LABELS} SELECT instrument_id, {', '.join(f'''count(*) FILTER (direction = '{d}') AS {d.lower()}''' for d in ('UP', 'RANGE', 'DOWN', 'CENSORED'))} FROM lab GROUP BY 1",
    "right_censored": f"WITH {LABELS} SELECT instrument_id, close_time_ns, observed_bars FROM lab WHERE direction = 'CENSORED'",
    "range_trajectories": f"""WITH {LABELS}, pa AS (SELECT {Q.SERIES}, close_time_ns, list(high) OVER w AS hs, list(low) OVER w AS ls, list(close) OVER w AS cs FROM bars WINDOW w AS ({Q.BY} ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING)),
z AS (SELECT lab.*, hs[1:first_passage_bars] AS h, ls[1:first_passage_bars] AS l, list_concat([lab.close], cs[1:first_passage_bars]) AS c FROM lab JOIN pa USING (instrument_id, timeframe, close_time_ns) WHERE direction = 'RANGE'),
y AS (SELECT *, list_filter(list_transform(range(2, len(c) + 1), lambda i: sign(c[i] - c[i - 1])), lambda s: s <> 0) AS mv FROM z)
SELECT instrument_id, close_time_ns, first_passage_bars, round(list_max(h) / close - 1, 8) AS up_excursion, round(1 - list_min(l) / close, 8) AS down_excursion, list_position(h, list_max(h)) AS up_bar, list_position(l, list_min(l)) AS down_bar,
  CAST(len(list_filter(range(2, len(mv) + 1), lambda i: mv[i] <> mv[i - 1])) AS INTEGER) AS reversals FROM y""",
    "frames_with_bars": f"WITH {Q.ORDER_BARS}, o AS (SELECT {Q.SERIES}, close_time_ns AS timestamp_ns, (high - low) / lag(close) OVER ({Q.BY}) AS omega, close, high, low FROM bars) SELECT {Q.SERIES}, timestamp_ns, round(omega, 8) AS omega, close, high, low FROM o WHERE omega IS NOT NULL",
    "prior_week_asof": f"""WITH {Q.ORDER_BARS}, {WEEKLY}, wk AS (SELECT instrument_id, close_time_ns AS pt, close AS pc, {WEEK_OF.format('close_time_ns')} AS wn FROM w),
wl AS (SELECT instrument_id, wn, max(pt) AS pt, arg_max(pc, pt) AS pc FROM wk GROUP BY 1, 2),
d AS (SELECT {Q.SERIES}, close_time_ns AS timestamp_ns, {WEEK_OF.format('close_time_ns')} AS week_ns FROM bars)
SELECT d.instrument_id, d.timeframe, d.timestamp_ns, pt AS prior_timestamp_ns, pc AS prior_value FROM d ASOF LEFT JOIN wl ON d.instrument_id = wl.instrument_id AND d.week_ns > wl.wn""",
    "asof_events": f"""WITH {Q.EVENT_BARS}, b AS (SELECT instrument_id, close_time_ns AS t, close FROM bars), l AS (SELECT b.instrument_id || '~' || o.instrument_id AS pair, t FROM b JOIN (SELECT DISTINCT instrument_id FROM b) o ON o.instrument_id <> b.instrument_id),
v AS (SELECT o.instrument_id || '~' || b.instrument_id AS pair, t AS seen, close FROM b JOIN (SELECT DISTINCT instrument_id FROM b) o ON o.instrument_id <> b.instrument_id), j AS (SELECT l.pair, l.t AS timestamp_ns, seen, close FROM l ASOF LEFT JOIN v ON l.pair = v.pair AND l.t > v.seen)
SELECT pair, timestamp_ns, CASE WHEN timestamp_ns - seen <= {6 * Q.HOUR} THEN seen END AS other_at, CASE WHEN timestamp_ns - seen <= {6 * Q.HOUR} THEN close END AS other_close FROM j""",
    "exact_pairs": f"WITH {Q.ORDER_BARS} SELECT a.instrument_id || '~' || b.instrument_id AS pair, a.close_time_ns AS timestamp_ns FROM bars a JOIN bars b USING (close_time_ns) WHERE a.instrument_id < b.instrument_id",
    "greedy_band": f"""WITH RECURSIVE {Q.ORDER_BARS}, n AS MATERIALIZED (SELECT instrument_id, close_time_ns AS t, row_number() OVER (PARTITION BY instrument_id ORDER BY close_time_ns) AS k FROM bars),
i AS (SELECT DISTINCT instrument_id AS id FROM n), g AS (SELECT a.id AS one, b.id AS other, 1::BIGINT AS i, 1::BIGINT AS j, NULL::BIGINT AS l, NULL::BIGINT AS r FROM i a JOIN i b ON a.id < b.id
UNION ALL SELECT one, other, CASE WHEN abs(x.t - y.t) <= {Q.DAY} OR x.t < y.t THEN i + 1 ELSE i END, CASE WHEN abs(x.t - y.t) <= {Q.DAY} OR x.t > y.t THEN j + 1 ELSE j END,
  CASE WHEN abs(x.t - y.t) <= {Q.DAY} THEN x.t END, CASE WHEN abs(x.t - y.t) <= {Q.DAY} THEN y.t END FROM g JOIN n x ON x.instrument_id = one AND x.k = i JOIN n y ON y.instrument_id = other AND y.k = j)
SELECT one || '~' || other AS pair, l AS left_ns, r AS right_ns FROM g WHERE l IS NOT NULL""",
    "union_pool": f"WITH {Q.ORDER_BARS} SELECT {Q.SERIES}, close_time_ns AS timestamp_ns, close FROM bars",
    "appended_series": f"WITH {Q.ORDER_BARS} SELECT {Q.SERIES}, count(*) AS bars, max(close_time_ns) AS last_ns FROM bars GROUP BY ALL",
    "complete_cases": f"WITH {LABELS}, n AS (SELECT {Q.SERIES}, close_time_ns, row_number() OVER ({Q.BY}) AS k FROM bars) SELECT n.instrument_id, n.timeframe, close_time_ns AS timestamp_ns FROM n JOIN lab USING (instrument_id, timeframe, close_time_ns) WHERE direction <> 'CENSORED' AND k > 9",
    "cross_scale": """WITH r AS (SELECT CAST(c_nationkey AS VARCHAR) AS instrument_id, c_custkey % 6 AS f, max(c_custkey) AS k FROM customer GROUP BY 1, 2),
s AS (SELECT instrument_id, f, ['M1', 'M5', 'H1', 'H4', 'D1', 'W1'][f + 1] AS tf, ['UP', 'DOWN', 'RANGE', 'UNAVAILABLE', 'UP'][k % 5 + 1] AS d FROM r),
c AS (SELECT instrument_id, count(*) FILTER (d = 'UP') AS u, count(*) FILTER (d = 'DOWN') AS dn, count(*) FILTER (d = 'RANGE') AS g FROM s GROUP BY 1),
m AS (SELECT *, CASE WHEN u > dn AND u > g THEN 'UP' WHEN dn > u AND dn > g THEN 'DOWN' WHEN g > u AND g > dn THEN 'RANGE' ELSE 'UNRESOLVED' END AS dom FROM c),
e AS (SELECT *, CASE WHEN dom <> 'UNRESOLVED' THEN dom WHEN u >= dn AND u >= g THEN 'UP' WHEN dn >= u AND dn >= g THEN 'DOWN' WHEN g > 0 THEN 'RANGE' ELSE 'UNRESOLVED' END AS ref FROM m),
l AS (SELECT s.instrument_id, dom, coalesce(string_agg(tf, ',' ORDER BY f) FILTER (d = ref), '') AS agreeing, coalesce(string_agg(tf, ',' ORDER BY f) FILTER (d <> ref AND d <> 'UNAVAILABLE'), '') AS disagreeing, count(*) FILTER (d = ref) AS a, count(*) FILTER (d <> ref AND d <> 'UNAVAILABLE') AS b, arg_min(tf, f) FILTER (d = ref) AS first_tf FROM s JOIN e USING (instrument_id) GROUP BY 1, 2)
SELECT instrument_id, dom AS dominant_direction, CASE WHEN b = 0 AND a > 0 THEN 'UNANIMOUS' WHEN a > b THEN 'MAJORITY' WHEN a = b AND a > 0 THEN 'SPLIT' ELSE 'UNAVAILABLE' END AS agreement, agreeing, disagreeing, first_tf AS dominant_scale FROM l""",
    "bounded_state": f"WITH {STATE} SELECT {Q.SERIES}, timestamp_ns, {_round(AXES, 8)} FROM st",
    "robust_geometry": _geometry(),
    "exponential_memory": f"""WITH RECURSIVE {KERNEL}, n AS MATERIALIZED (SELECT {Q.SERIES}, timestamp_ns, row_number() OVER ({KBY}) AS rn, CASE WHEN lam > 0.2::DOUBLE THEN delta END AS x FROM k),
r AS (SELECT {Q.SERIES}, timestamp_ns, rn, CAST(NULL AS DOUBLE) AS before, CASE WHEN x IS NOT NULL THEN (1 - exp(-1.0 / 32)) * x END AS after FROM n WHERE rn = 1
UNION ALL SELECT n.instrument_id, n.timeframe, n.timestamp_ns, n.rn, r.after, CASE WHEN n.x IS NULL THEN r.after ELSE exp(-1.0 / 32) * coalesce(r.after, 0) + (1 - exp(-1.0 / 32)) * n.x END FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.timeframe = r.timeframe AND n.rn = r.rn + 1)
SELECT {Q.SERIES}, timestamp_ns, round(before, 8) AS prior_memory, round(after, 8) AS memory FROM r""",
    "weighted_mean": f"""WITH {KERNEL}, h AS (SELECT {Q.SERIES}, timestamp_ns, list(delta) OVER ({KBY} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS l FROM k)
SELECT {Q.SERIES}, timestamp_ns, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * pow(0.9::DOUBLE, len(l) - i))) / list_sum(list_transform(range(1, len(l) + 1), lambda i: pow(0.9::DOUBLE, len(l) - i))), 8) AS weighted_mean FROM h""",
    "relative_magnitude": f"""WITH {KERNEL}, h AS (SELECT {Q.SERIES}, timestamp_ns, abs(m) AS x, count(*) OVER w AS n, quantile_cont(abs(m), 0.5) OVER w AS u FROM k WINDOW w AS ({KBY} ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING))
SELECT {Q.SERIES}, timestamp_ns, round(CASE WHEN n >= 8 AND u > 0 THEN x / (x + u) WHEN n >= 8 AND u = 0 AND x = 0 THEN 0 END, 8) AS relative FROM h""",
    "differentials": f"""WITH {KERNEL}, h AS (SELECT {Q.SERIES}, timestamp_ns, delta - lam AS x FROM k)
SELECT {Q.SERIES}, timestamp_ns, round(x, 6) AS differential, round(x - lag(x) OVER ({KBY}), 6) AS trend, round(sum(greatest(x, 0)) OVER ({KBY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS exposure FROM h""",
    "ledger_trajectory": _ledger_sql(),
    "series_snapshots": f"WITH {Q.ORDER_BARS} SELECT {Q.SERIES}, max(close_time_ns) AS timestamp_ns, arg_max(trade_count, close_time_ns) AS trade_count FROM bars GROUP BY ALL",
    "dynamics_features": f"WITH {_dynamics()} SELECT {Q.SERIES}, timestamp_ns, {', '.join(c if c in ('regime_age', 'momentum_streak') else f'round({c}, 5) AS {c}' for c in DYNAMICS)} FROM dyn",
    "dynamics_variants": f"WITH {_dynamics()} {' UNION ALL '.join(map(_variant_sql, dynamics.VARIANTS))}",
    "series_similarity": f"""WITH {Q.ORDER_BARS}, x AS (SELECT instrument_id, close_time_ns, {FIELDS} AS v, close > open AS up FROM bars),
p AS (SELECT a.instrument_id || '~' || b.instrument_id AS pair, list_dot_product(a.v, b.v) AS xy, list_dot_product(a.v, a.v) AS xx, list_dot_product(b.v, b.v) AS yy, a.up = b.up AS same, a.v[1] > 0 AND b.v[1] > 0 AS live FROM x a JOIN x b ON a.close_time_ns = b.close_time_ns AND a.instrument_id < b.instrument_id),
g AS (SELECT pair, count(*) AS rows, sum(xy) / (sqrt(sum(xx)) * sqrt(sum(yy))) AS sim, CASE WHEN count(*) FILTER (live) = 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (live AND same) > count(*) FILTER (live AND NOT same) THEN 'ALIGNED' ELSE 'DIVERGING' END AS kernel,
  CASE WHEN count(*) FILTER (same) > count(*) FILTER (NOT same) THEN 'ALIGNED' ELSE 'DIVERGING' END AS observer, 'ALIGNED' AS ledger, 'ALIGNED' AS memory FROM p GROUP BY 1),
c AS (SELECT *, len(list_filter([kernel, observer, ledger, memory], lambda w: w = 'ALIGNED')) AS yes, len(list_filter([kernel, observer, ledger, memory], lambda w: w = 'DIVERGING')) AS no FROM g)
SELECT pair, rows, round(sim, 8) AS similarity, kernel, observer, ledger, memory, CASE WHEN sim >= 0.7 AND yes >= 3 AND no = 0 THEN 'STRONG_ALIGNMENT' WHEN sim >= 0.4 AND yes >= 1 AND no = 0 THEN 'WEAK_ALIGNMENT' WHEN yes = 0 AND no >= 2 THEN 'DIVERGENCE' WHEN sim >= 0.5 THEN 'WEAK_ALIGNMENT' ELSE 'UNAVAILABLE' END AS relation FROM c""",
}
