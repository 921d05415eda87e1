"""Queries that score forecasts walking forward in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, dynamics, frozen, labels, model, profiles, resample, residuals, structure, walk
from ..session import shared_path, ship, stored
from ..sources import bars as B
from . import sample_queries as P
from . import series_queries as R
from . import sql as Q

S = R.S
LABEL = (R.LOOKBACK, R.HORIZON, 0.6, 0.6)
#: Columns that the widest variant has beside the base vector.
ADDED = dynamics.VARIANTS["D"]


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = B.order_bars(spark, sf_dir)
    return bars, labels.first_passage(bars, *LABEL), bars.select(*S, F.col("close_time_ns").alias("at"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order series' bars scored by what was known before them."""
    ship(spark)
    bars, told, frames = _base(spark, sf_dir)
    vectors = R.dynamics_input(spark, sf_dir).select(*S, "timestamp_ns", F.col("values").alias("vector"))
    _, cases, plan = walk.walk_forward(walk.candidates(vectors, bars, told), frames)
    found = walk.metrics(cases).join(plan.select(*S, "k", "most", "power"), S)
    return found.select(*S, "k", "power", F.round("most", 6).alias("most"), "observations", "resolved", "correct", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "brier", "climatology", "skill", "calibration_error")])


def _variants(rows: DataFrame) -> DataFrame:
    """The common complete rows once for each nested variant: one vector of all dimensions, those beyond the
    variant's null, so that a variant is a mask and all are searched in one pass. The timeframe names it.
    Added features are taken to 12 places: what a sum leaves beside 0 would otherwise become a scale."""
    complete = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ADDED))
    made = F.array(*[F.struct(F.lit(name).alias("name"), F.concat("values", F.array(*[F.round(F.col(c).cast("double"), 12) if c in dynamics.VARIANTS[name] else F.lit(None).cast("double") for c in ADDED])).alias("vector")) for name in dynamics.VARIANTS])
    each = complete.withColumn("v", F.explode(made))
    return each.select("instrument_id", F.concat_ws("/", "timeframe", "v.name").alias("timeframe"), "timestamp_ns", F.col("v.vector").alias("vector"))


def _each(rows: DataFrame, names: tuple[str, ...] = tuple(dynamics.VARIANTS)) -> DataFrame:
    """``rows`` once for each variant, under its timeframe."""
    return rows.withColumn("name", F.explode(F.array(*map(F.lit, names)))).withColumn("timeframe", F.concat_ws("/", "timeframe", "name")).drop("name")


def rank(rows: DataFrame, bars: DataFrame, told: DataFrame, frames: DataFrame) -> DataFrame:
    """Nested variants of ``rows`` (as ``dynamics.features`` gives them) by their walk-forward metrics."""
    _, cases, plan = walk.walk_forward(walk.candidates(_variants(rows), _each(bars), _each(told)), _each(frames))
    scores = walk.metrics(cases).join(plan.select(*S, "dimensions"), S)
    named = scores.withColumns({"variant": F.element_at(F.split("timeframe", "/"), -1), "timeframe": F.element_at(F.split("timeframe", "/"), 1)})
    return audits.rank_variants(named, S)


def ablation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested variants of the added features, ranked for each order series."""
    ship(spark)
    bars, told, frames = _base(spark, sf_dir)
    rows = stored(dynamics.features(R.dynamics_input(spark, sf_dir), R.dynamics_input(spark, sf_dir, True)), "dynamics")
    found = rank(rows, bars, told, frames)
    return found.select("instrument_id", "place", "variant", "dimensions", "observations", "resolved", *[F.round(c, 6).alias(c) for c in ("skill", "balanced_accuracy", "calibration_error", "coverage")])


def structural_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking with the 14 structural dimensions as base: 14, 17, 23 and 26. Not registered: it did not
    end within 130 s at sf0.001 and its result is not checked yet."""
    ship(spark)
    bars, told, frames = _base(spark, sf_dir)

    def framed(kernel: DataFrame) -> DataFrame:
        rows = structure.stack(kernel)
        seen = structure.observer(structure.paths(structure.robust_geometry(structure.bounded_state(kernel))))
        return rows.join(seen.select(*S, "timestamp_ns", "state"), [*S, "timestamp_ns"]).join(kernel.select(*S, "timestamp_ns", "delta", "lambda"), [*S, "timestamp_ns"])

    daily, weekly = framed(R.kernel_rows(spark, sf_dir)), framed(R.kernel_of(resample.weekly(bars)))
    found = rank(stored(dynamics.features(daily, weekly), "dynamics"), bars, told, frames)
    return found.select("instrument_id", "place", "variant", "dimensions", "observations", "resolved", *[F.round(c, 6).alias(c) for c in ("skill", "balanced_accuracy", "calibration_error", "coverage")])


def _featured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Validation and evaluation cases of the base variant with velocity and acceleration."""
    ship(spark)
    bars, told, frames = _base(spark, sf_dir)
    rows = stored(dynamics.features(R.dynamics_input(spark, sf_dir), R.dynamics_input(spark, sf_dir, True)), "dynamics")
    complete = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ADDED))
    vectors = complete.select(*S, "timestamp_ns", F.col("values").alias("vector"))
    validation, evaluation, _ = walk.walk_forward(walk.candidates(vectors, bars, told), frames)
    feature = complete.select(*S, F.col("timestamp_ns").alias("at"), "delta_velocity", "delta_acceleration")
    with_feature = lambda c: stored(residuals.forecasts(c).join(feature, [*S, "at"]), "cases")
    return with_feature(validation), with_feature(evaluation)


def sequential_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier scores of the base forecasts, corrected by velocity, by acceleration, and by acceleration on
    what velocity leaves."""
    found = residuals.sequential(*_featured(spark, sf_dir), "delta_velocity", "delta_acceleration", ["instrument_id"])
    return found.select("instrument_id", "cases", *[F.round(c, 6).alias(c) for c in found.columns if c.startswith("brier")])


def frozen_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The velocity correction, registered on validation cases, scored by a stream of later ones."""
    validation, evaluation = _featured(spark, sf_dir)
    boundary = validation.groupBy(*S).agg(F.max("at").alias("boundary_ns"))
    fits, cases, out = (shared_path(spark, x) for x in ("fits", "cases", "scores"))
    frozen.register(residuals.fit(validation, "delta_velocity", S), "delta_velocity", boundary, fits)
    # Earlier cases are sent along, and all of them twice.
    validation.unionByName(evaluation).write.parquet(cases)
    evaluation.write.mode("append").parquet(cases)
    stream = spark.readStream.schema(evaluation.schema).parquet(cases)
    frozen.score_stream(stream, frozen.registered(spark, fits), "delta_velocity", out, shared_path(spark, "progress")).awaitTermination()
    scores = spark.read.parquet(out)
    lies = [F.count_if(F.col("support") == x).alias(x.lower()) for x in ("BELOW", "WITHIN", "ABOVE")]
    return scores.groupBy("instrument_id").agg(F.count("*").alias("cases"), F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg("corrected_brier"), 6).alias("corrected_brier"), *lies)


#: When the forecasts of ``profile_checks`` were registered, after all bars.
REGISTERED_NS = 15_000 * Q.DAY


def profile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the order series, each sound, tampered with after signing, and of an older engine, with
    every rule that they fail."""
    bars = B.order_bars(spark, sf_dir)
    n = bars.groupBy(*S).agg(F.count("*").alias("bars"), F.min("low").alias("least"), F.max("high").alias("most_"), F.max("close_time_ns").alias("last_ns"))
    held = F.floor(F.sqrt("bars")).cast("int")
    train = F.col("bars") - 2 * held
    k = F.floor(F.sqrt(train)).cast("int")
    made = n.select(
        F.concat(F.lit("stock:orders:"), "instrument_id").alias("instrument_id"), "timeframe", F.lit(profiles.VERSION).alias("version"), F.lit("STOCK").alias("asset_class"),
        F.explode(F.array(F.lit("sound"), F.lit("tampered"), F.lit("stale"))).alias("form"), k.alias("k"), F.least(F.length(F.bin(train)) - 1, k).cast("int").alias("least_support"),
        F.round((F.col("most_") - F.col("least")) / F.col("most_"), 6).alias("most"), F.lit(1.5).alias("power"), F.lit(0.75).alias("barrier_up"), F.lit(0.75).alias("barrier_down"),
        F.lit(3).alias("dimensions"), F.array(F.lit(True), F.lit(True), F.lit(False)).alias("effective"), train.cast("long").alias("samples"), "last_ns", F.lit(True).alias("untouched_test"), F.lit(REGISTERED_NS + 1).alias("split_ns"),
    )
    ready = made.withColumns({"profile_id": profiles.profile_id(), "engine_version": F.when(F.col("form") == "stale", "0.9.0").otherwise(profiles.ENGINE)})
    hashed = profiles.signed(ready).withColumn("samples", F.when(F.col("form") == "tampered", F.col("samples") + 1).otherwise(F.col("samples")))
    failed = profiles.checks(hashed, REGISTERED_NS).where("NOT passed").groupBy("profile_id", profiles.HASH).agg(F.concat_ws(",", F.sort_array(F.collect_list("check"))).alias("failed"))
    return hashed.select("profile_id", "form", profiles.HASH).join(failed, ["profile_id", profiles.HASH], "left").select("profile_id", "form", profiles.HASH, F.coalesce("failed", F.lit("")).alias("failed"))


def _profiles(spark: SparkSession, sf_dir: str) -> tuple[model.ProfileModel, DataFrame]:
    """The profiles of the order series and their frames."""
    ship(spark)
    frames = R.dynamics_input(spark, sf_dir).select(*S, "timestamp_ns", F.col("values").alias("vector"))
    return model.ProfileEstimator(B.order_bars(spark, sf_dir)).fit(frames), frames


def profile_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fit of a profile for each order series comes to."""
    fitted, _ = _profiles(spark, sf_dir)
    return fitted.settings.select(*S, "bars", "frames", "lookback", "horizon", F.round("barrier", 6).alias("barrier"), "train", "validation", "test", "k", "least_support", "dimensions", F.round("most", 6).alias("most"), "power", "edge_bp", "least_reliability_bp", "split_ns")


def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test scores of each profile, with the reliability of each class that it names, after save and load."""
    fitted, _ = _profiles(spark, sf_dir)
    path = shared_path(spark, "profiles")
    fitted.save(path)
    kept = model.ProfileModel.load(spark, path)
    by_class = kept.reliability.groupBy(*S).agg(*[F.max(F.when(F.col("direction") == d, F.col("lower_bp"))).alias(f"{d.lower()}_lower_bp") for d in ("UP", "RANGE", "DOWN")])
    return kept.settings.join(by_class, S, "left").select(*S, "evaluated", "correct", "reliability_bp", "lower_bp", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "brier", "climatology", "skill")], "up_lower_bp", "range_lower_bp", "down_lower_bp")


def profile_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of loaded profiles on every frame from the test on, those without a label too."""
    fitted, frames = _profiles(spark, sf_dir)
    path = shared_path(spark, "profiles")
    fitted.save(path)
    kept = model.ProfileModel.load(spark, path)
    later = frames.join(kept.settings.select(*S, "split_ns"), S).where("timestamp_ns >= split_ns")
    return kept.transform(later).select(*S, "timestamp_ns", "predicted", "up_bp", "range_bp", "down_bp", "neighbours")


QUERIES = {f.__name__: f for f in (walk_forward, ablation_ranking, sequential_residuals, frozen_forward, profile_checks, profile_parameters, profile_scores, profile_votes)}

KEY = "instrument_id, timeframe"


def _candidates(vectors: str) -> str:
    """wcand: candidates with their part; ``vectors`` is a table of instrument_id, t, timeframe and v."""
    return f"""ix AS (SELECT instrument_id, close_time_ns AS t, row_number() OVER ({Q.BY}) AS rn, count(*) OVER (PARTITION BY {KEY}) AS n FROM bars),
wcand AS (SELECT vv.instrument_id, vv.timeframe, vv.t, vv.v, lab.direction, e.t AS known, CASE WHEN a.rn > a.n - CAST(floor(sqrt(a.n)) AS BIGINT) THEN 'E' WHEN a.rn > a.n - 2 * CAST(floor(sqrt(a.n)) AS BIGINT) THEN 'V' ELSE 'T' END AS part
  FROM {vectors} vv JOIN ix a ON a.instrument_id = vv.instrument_id AND a.t = vv.t JOIN lab ON lab.instrument_id = vv.instrument_id AND lab.close_time_ns = vv.t AND lab.direction <> 'CENSORED' JOIN ix e ON e.instrument_id = a.instrument_id AND e.rn = a.rn + lab.first_passage_bars)"""


MATURED = "q.instrument_id = l.instrument_id AND q.timeframe = l.timeframe AND l.t < q.t AND l.known < q.t"


def _walk(dims: int, same: str = MATURED, limit: str = "max(kth)") -> str:
    """CTEs from wcand on to case rows of both powers (wc), the settings (wp) and the choice of power (wx);
    ``same`` tells which rows l serve a query q, ``limit`` the distance limit."""
    far = f"CASE WHEN len(list_filter(q.m, lambda x: x)) = 0 THEN 'inf'::DOUBLE ELSE sqrt(list_sum(list_transform(range(1, {dims + 1}), lambda i: CASE WHEN q.m[i] THEN (q.v[i] - l.v[i]) * (q.v[i] - l.v[i]) ELSE 0 END)) / len(list_filter(q.m, lambda x: x))) END"
    weight = "1.0 / pow(greatest(distance, pow(2.0, -26)), power)"
    mass = ", ".join(f"sum(CASE WHEN ld = '{d}' THEN {weight} ELSE 0 END) AS {c}" for d, c in (("UP", "u"), ("RANGE", "g"), ("DOWN", "d")))
    hit = lambda d: f"(CASE WHEN actual = '{d}' THEN 1.0 ELSE 0.0 END)"
    own = " + ".join(f"pow({c}_bp / 10000.0 - {hit(c.upper())}, 2)" for c in ("up", "range", "down"))
    usual = " + ".join(f"pow(CASE WHEN library > 0 THEN {c} / library ELSE 0 END - {hit(c.upper())}, 2)" for c in ("up", "range", "down"))
    there = "predicted <> 'UNRESOLVED'"
    recall = lambda d: f"CASE WHEN count(*) FILTER ({there} AND actual = '{d}') > 0 THEN (count(*) FILTER ({there} AND predicted = actual AND actual = '{d}') * 10000 + count(*) FILTER ({there} AND actual = '{d}') // 2) // count(*) FILTER ({there} AND actual = '{d}') END"
    gap = " + ".join(f"abs(avg({c}_bp / 10000.0) FILTER ({there}) - avg({hit(c.upper())}) FILTER ({there}))" for c in ("up", "range", "down"))
    return f"""wl AS (SELECT {KEY}, t, part, unnest(v) AS x, unnest(range({dims})) AS axis FROM wcand),
wm AS (SELECT {KEY}, axis, coalesce(quantile_cont(x, 0.5), 0) AS med, max(x) - min(x) AS wide FROM wl WHERE part = 'T' GROUP BY ALL),
wn AS (SELECT {KEY}, axis, any_value(med) AS med, CASE WHEN coalesce(quantile_cont(abs(x - med), 0.5), 0) > 0 THEN quantile_cont(abs(x - med), 0.5) WHEN any_value(wide) > 0 THEN any_value(wide) / 2 ELSE 1 END AS scale, coalesce(any_value(wide), 0) > 0 AS eff FROM wl JOIN wm USING ({KEY}, axis) WHERE part = 'T' GROUP BY {KEY}, axis),
wd AS (SELECT {KEY}, count(*) FILTER (eff) AS dimensions FROM wn GROUP BY ALL),
wv AS (SELECT {KEY}, t, list(coalesce((x - med) / scale, 0) ORDER BY axis) AS v, list(x IS NOT NULL AND eff ORDER BY axis) AS m FROM wl JOIN wn USING ({KEY}, axis) GROUP BY {KEY}, t),
wr AS MATERIALIZED (SELECT wcand.instrument_id, wcand.timeframe, wcand.t, known, direction, part, wv.v, wv.m FROM wcand JOIN wv USING ({KEY}, t)),
wp0 AS (SELECT {KEY}, CAST(greatest(floor(sqrt(count(*))), 1) AS INTEGER) AS k, CAST(least(length(bin(count(*))), greatest(floor(sqrt(count(*))), 1)) AS INTEGER) AS least_support FROM wr WHERE part = 'T' GROUP BY {KEY}),
pa AS MATERIALIZED (SELECT q.instrument_id, q.timeframe, q.t, l.t AS lt, q.part, l.part AS lp, l.direction AS ld, {far} AS distance FROM wr q JOIN wr l ON {same} AND q.m = l.m WHERE q.part <> 'T'),
wf AS (SELECT pa.*, k FROM pa JOIN wp0 USING ({KEY}) WHERE part = 'V' AND lp = 'T' QUALIFY row_number() OVER (PARTITION BY {KEY}, t ORDER BY distance, lt) <= k),
wp AS (SELECT wp0.*, most FROM wp0 JOIN (SELECT {KEY}, {limit} AS most FROM (SELECT {KEY}, t, max(distance) AS kth FROM wf GROUP BY ALL) WHERE kth < 'inf'::DOUBLE GROUP BY ALL HAVING {limit} > 0) USING ({KEY})),
me AS (SELECT pa.*, k FROM pa JOIN wp USING ({KEY}) WHERE distance <= most QUALIFY row_number() OVER (PARTITION BY {KEY}, t ORDER BY distance, lt) <= k),
ms2 AS (SELECT {KEY}, t, power, count(*) AS nb, {mass} FROM me, (SELECT unnest([1.0, 2.0]) AS power) GROUP BY {KEY}, t, power),
mb AS (SELECT {KEY}, t, power, nb, {P._bp('u', 'g', 'd')} AS bp FROM ms2),
wk2 AS (SELECT q.instrument_id, q.timeframe, q.t, count(l.t) AS library, count(*) FILTER (l.direction = 'UP') AS up, count(*) FILTER (l.direction = 'RANGE') AS range, count(*) FILTER (l.direction = 'DOWN') AS down FROM wr q LEFT JOIN wr l ON {same} WHERE q.part <> 'T' GROUP BY ALL),
wc AS (SELECT wr.instrument_id, wr.timeframe, wr.t, wr.part, pw.power, wr.direction AS actual, library, up, range, down, CASE WHEN nb >= least_support THEN bp[1] END AS up_bp, CASE WHEN nb >= least_support THEN bp[2] END AS range_bp, CASE WHEN nb >= least_support THEN bp[3] END AS down_bp,
  CASE WHEN nb IS NULL OR nb < least_support THEN 'UNRESOLVED' WHEN bp[1] >= bp[2] AND bp[1] >= bp[3] THEN 'UP' WHEN bp[2] >= bp[3] THEN 'RANGE' ELSE 'DOWN' END AS predicted
  FROM wr CROSS JOIN (SELECT unnest([1.0, 2.0]) AS power) pw JOIN wp USING ({KEY}) JOIN wk2 USING ({KEY}, t) LEFT JOIN mb ON mb.instrument_id = wr.instrument_id AND mb.timeframe = wr.timeframe AND mb.t = wr.t AND mb.power = pw.power WHERE wr.part <> 'T'),
wq0 AS (SELECT {KEY}, part, power, count(*) AS observations, count(*) FILTER ({there}) AS resolved, count(*) FILTER ({there} AND predicted = actual) AS correct, coalesce(avg({own}) FILTER ({there}), 0) AS brier, coalesce(avg({usual}) FILTER ({there}), 0) AS climatology,
  list_filter([{recall('UP')}, {recall('RANGE')}, {recall('DOWN')}], lambda x: x IS NOT NULL) AS rc, coalesce(({gap}) / 3, 0) AS calibration_error FROM wc GROUP BY ALL),
wq AS (SELECT *, resolved / observations AS coverage, CASE WHEN climatology > 0 THEN 1 - brier / climatology ELSE 0 END AS skill, CASE WHEN len(rc) > 0 THEN (list_sum(rc) // len(rc)) / 10000.0 ELSE 0 END AS balanced_accuracy FROM wq0),
wx AS (SELECT a.instrument_id, a.timeframe, CASE WHEN (round(b.skill, 12), b.balanced_accuracy, -round(b.calibration_error, 12), b.coverage) > (round(a.skill, 12), a.balanced_accuracy, -round(a.calibration_error, 12), a.coverage) THEN 2.0 ELSE 1.0 END AS power
  FROM wq a JOIN wq b USING ({KEY}) WHERE a.part = 'V' AND b.part = 'V' AND a.power = 1 AND b.power = 2)"""


#: Frames have sizes of their own for each series; validation rows see training rows, later ones both.
PROFILE = f"""{Q.ORDER_BARS}, sz AS (SELECT {KEY}, count(*) AS n, CAST(greatest(floor(sqrt(count(*))), 2) AS BIGINT) AS lb, CAST(greatest(length(bin(count(*))), 2) AS BIGINT) AS hz, CAST(floor(sqrt(count(*))) AS BIGINT) AS held FROM bars GROUP BY ALL),
rr AS (SELECT bars.*, n, lb, hz, held, row_number() OVER ({Q.BY}) AS rn, (high - low) / lag(close) OVER ({Q.BY}) AS ratio FROM bars JOIN sz USING ({KEY})),
vol AS (SELECT *, CASE WHEN rn > 1 THEN (SELECT 1) END AS later, list(CASE WHEN ratio > 0 THEN ratio END) OVER ({Q.BY} ROWS BETWEEN lb - 1 PRECEDING AND CURRENT ROW) AS ratios FROM rr),
vo AS (SELECT *, CASE WHEN rn > 1 THEN list_median(list_filter(ratios, lambda x: x IS NOT NULL)) END AS volatility FROM vol),
tr AS (SELECT *, list_transform(f, lambda b: b.h) AS hs, list_transform(f, lambda b: b.l) AS ls FROM (SELECT *, list({{'h': high, 'l': low}}) OVER ({Q.BY} ROWS BETWEEN 1 FOLLOWING AND hz FOLLOWING) AS f FROM vo WHERE rn <= n - 2 * held)),
ex AS (SELECT {KEY}, greatest(list_max(hs) / close - 1, 0) / volatility AS x FROM tr WHERE rn > 1 AND volatility IS NOT NULL AND len(f) > 0 UNION ALL SELECT {KEY}, greatest(1 - list_min(ls) / close, 0) / volatility FROM tr WHERE rn > 1 AND volatility IS NOT NULL AND len(f) > 0),
br AS (SELECT {KEY}, quantile_cont(x, 0.5) AS barrier FROM ex GROUP BY ALL HAVING quantile_cont(x, 0.5) > 0),
fut AS (SELECT *, close * (1 + volatility * barrier) AS u, close * (1 - volatility * barrier) AS d FROM (SELECT *, list({{'h': high, 'l': low}}) OVER ({Q.BY} ROWS BETWEEN 1 FOLLOWING AND hz FOLLOWING) AS f FROM vo) JOIN br USING ({KEY})),
hit AS (SELECT *, list_position(list_transform(f, lambda x: x.h >= u OR x.l <= d), TRUE) AS pos FROM fut WHERE volatility IS NOT NULL AND len(f) > 0),
lab AS (SELECT {KEY}, close_time_ns, CASE WHEN pos > 0 THEN CASE WHEN f[pos].h >= u AND f[pos].l > d THEN 'UP' WHEN f[pos].h < u AND f[pos].l <= d THEN 'DOWN' ELSE 'RANGE' END WHEN len(f) >= hz THEN 'RANGE' ELSE 'CENSORED' END AS direction, CASE WHEN pos > 0 THEN pos ELSE hz END AS first_passage_bars FROM hit)""".replace("CASE WHEN rn > 1 THEN (SELECT 1) END AS later, ", "")
FROZEN = "q.instrument_id = l.instrument_id AND q.timeframe = l.timeframe AND (l.part = 'T' OR (q.part = 'E' AND l.part = 'V'))"
BASE = "vx AS (SELECT instrument_id, timeframe, close_time_ns AS t, " + R.FIELDS + " AS v FROM bars)"
_FULL = " AND ".join(f"{c} IS NOT NULL" for c in ADDED)
_PADDED = ", ".join("{'name': '" + name + "', 'v': list_concat(v, [" + ", ".join(f"round(CAST({c} AS DOUBLE), 12)" if c in added else "NULL" for c in ADDED) + "])}" for name, added in dynamics.VARIANTS.items())
NESTED = f"vn AS (SELECT instrument_id, timeframe, timestamp_ns AS t, unnest([{_PADDED}]) AS x FROM dyn WHERE {_FULL}), vx AS (SELECT instrument_id, timeframe || '/' || x.name AS timeframe, t, x.v AS v FROM vn)"
COMMON = f"vx AS (SELECT instrument_id, timeframe, timestamp_ns AS t, v FROM dyn WHERE {_FULL})"
# Labels and dynamics start from the same bars.
BOTH = f"{R.LABELS}, {R._dynamics().replace(Q.ORDER_BARS + ',', '', 1)}"


def _rounded(names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names.split())


_FEATURED = "(SELECT wc.*, dyn.delta_velocity AS f1, dyn.delta_acceleration AS f2 FROM wc JOIN wx USING (instrument_id, timeframe, power) JOIN dyn ON dyn.instrument_id = wc.instrument_id AND dyn.timestamp_ns = wc.t WHERE predicted <> 'UNRESOLVED'"
_ID, _BP, _P = "instrument_id", "{}_bp / 10000.0", "p_{}"
_SCORE = lambda src, name: f"{name} AS (SELECT instrument_id, count(*) AS cases, avg({P.BRIER_P}) AS b FROM {src} GROUP BY 1)"
_PLAIN = ", ".join(f"{c}_bp / 10000.0 AS p_{c}" for c in ("up", "range", "down"))

def _wilson(part: str, whole: str) -> str:
    z = 1.959963984540054
    n, p = f"greatest({whole}, 1)::DOUBLE", f"({part} / greatest({whole}, 1))"
    low = f"(({p} + {z * z}::DOUBLE / (2 * {n})) - {z}::DOUBLE * sqrt(({p} * (1 - {p}) + {z * z}::DOUBLE / (4 * {n})) / {n})) / (1 + {z * z}::DOUBLE / {n})"
    return f"CASE WHEN {whole} = 0 THEN 0::BIGINT ELSE CAST(floor(greatest(least({low}, 1), 0) * 10000 + 0.5) AS BIGINT) END"


#: The fitted profiles: pw is the choice of power, with the validation cases it rests on.
PROFILES = f"""{PROFILE}, {BASE}, {_candidates('vx')}, {_walk(6, FROZEN, 'greatest(max(kth), pow(2.0, -52))')},
pw AS (SELECT a.instrument_id, a.timeframe, CASE WHEN b.correct > a.correct THEN 2.0 ELSE 1.0 END AS power, {_wilson('greatest(a.correct, b.correct)', 'CASE WHEN b.correct > a.correct THEN b.resolved ELSE a.resolved END')} AS least_reliability_bp FROM wq a JOIN wq b USING ({KEY}) WHERE a.part = 'V' AND b.part = 'V' AND a.power = 1 AND b.power = 2),
pn AS (SELECT {KEY}, count(*) FILTER (part = 'T') AS train, count(*) FILTER (part = 'V') AS validation, count(*) FILTER (part = 'E') AS test FROM wcand GROUP BY ALL)"""

ORACLE = {
    "profile_parameters": f"""WITH {PROFILES}, ed AS (SELECT {KEY}, list(e ORDER BY e) AS es FROM (SELECT wc.instrument_id, wc.timeframe, list_sort([up_bp, range_bp, down_bp])[3] - list_sort([up_bp, range_bp, down_bp])[2] AS e FROM wc JOIN pw USING ({KEY}, power) WHERE part = 'V' AND predicted = actual) GROUP BY ALL),
sp AS (SELECT {KEY}, min(close_time_ns) AS split_ns FROM rr WHERE rn > n - held GROUP BY ALL)
SELECT instrument_id, timeframe, n AS bars, n AS frames, CAST(lb AS INTEGER) AS lookback, CAST(hz AS INTEGER) AS horizon, round(barrier, 6) AS barrier, train, validation, test, k, least_support, dimensions, round(most, 6) AS most, power, CAST(coalesce(es[len(es) // 2 + 1], 10000) AS BIGINT) AS edge_bp, least_reliability_bp, split_ns
FROM sz JOIN br USING ({KEY}) JOIN pn USING ({KEY}) JOIN wp USING ({KEY}) JOIN pw USING ({KEY}) JOIN wd USING ({KEY}) JOIN sp USING ({KEY}) LEFT JOIN ed USING ({KEY})""",
    "profile_scores": f"""WITH {PROFILES}, rl AS (SELECT {KEY}, {', '.join(f"CASE WHEN count(*) FILTER (predicted = '{d}') > 0 THEN " + _wilson(f"count(*) FILTER (predicted = '{d}' AND actual = '{d}')", f"count(*) FILTER (predicted = '{d}')") + f" END AS {d.lower()}_lower_bp" for d in ('UP', 'RANGE', 'DOWN'))} FROM wc JOIN pw USING ({KEY}, power) WHERE part = 'E' GROUP BY ALL)
SELECT instrument_id, timeframe, resolved AS evaluated, correct, CASE WHEN resolved > 0 THEN (correct * 10000 + resolved // 2) // resolved ELSE 0 END AS reliability_bp, {_wilson('correct', 'resolved')} AS lower_bp, {_rounded('balanced_accuracy brier climatology skill')}, up_lower_bp, range_lower_bp, down_lower_bp
FROM wq JOIN pw USING ({KEY}, power) LEFT JOIN rl USING ({KEY}) WHERE part = 'E'""",
    "profile_votes": f"""WITH {PROFILES}, wl2 AS (SELECT vx.instrument_id, vx.timeframe, vx.t, unnest(vx.v) AS x, unnest(range(6)) AS axis FROM vx JOIN ix USING (instrument_id, t) WHERE rn > n - CAST(floor(sqrt(n)) AS BIGINT)),
q AS (SELECT {KEY}, t, list(coalesce((x - med) / scale, 0) ORDER BY axis) AS v, list(x IS NOT NULL AND eff ORDER BY axis) AS m FROM wl2 JOIN wn USING ({KEY}, axis) GROUP BY {KEY}, t),
d AS (SELECT q.instrument_id, q.timeframe, q.t, l.t AS lt, l.direction AS ld, sqrt(list_sum(list_transform(range(1, 7), lambda i: CASE WHEN q.m[i] THEN (q.v[i] - l.v[i]) * (q.v[i] - l.v[i]) ELSE 0 END)) / len(list_filter(q.m, lambda x: x))) AS distance FROM q JOIN wr l USING ({KEY}) WHERE l.part <> 'E' AND l.m = q.m),
n1 AS (SELECT d.*, power FROM d JOIN wp USING ({KEY}) JOIN pw USING ({KEY}) WHERE distance <= most QUALIFY row_number() OVER (PARTITION BY {KEY}, d.t ORDER BY distance, lt) <= k),
ma AS (SELECT {KEY}, t, count(*) AS nb, {', '.join(f"sum(CASE WHEN ld = '{x}' THEN 1.0 / pow(greatest(distance, pow(2.0, -26)), power) ELSE 0 END) AS {c}" for x, c in (('UP', 'u'), ('RANGE', 'g'), ('DOWN', 'd')))} FROM n1 GROUP BY ALL),
bb AS (SELECT {KEY}, t, nb, {P._bp('u', 'g', 'd')} AS bp FROM ma)
SELECT q.instrument_id, q.timeframe, q.t AS timestamp_ns, CASE WHEN nb IS NULL OR nb < least_support THEN 'UNRESOLVED' WHEN bp[1] >= bp[2] AND bp[1] >= bp[3] THEN 'UP' WHEN bp[2] >= bp[3] THEN 'RANGE' ELSE 'DOWN' END AS predicted,
  CASE WHEN nb >= least_support THEN bp[1] END AS up_bp, CASE WHEN nb >= least_support THEN bp[2] END AS range_bp, CASE WHEN nb >= least_support THEN bp[3] END AS down_bp, coalesce(nb, 0) AS neighbours FROM q JOIN wp USING ({KEY}) LEFT JOIN bb ON bb.instrument_id = q.instrument_id AND bb.timeframe = q.timeframe AND bb.t = q.t""",
    "walk_forward": f"""WITH {R.LABELS}, {BASE}, {_candidates('vx')}, {_walk(6)}
SELECT instrument_id, timeframe, k, power, round(most, 6) AS most, observations, resolved, correct, {_rounded('balanced_accuracy brier climatology skill calibration_error')} FROM wq JOIN wx USING (instrument_id, timeframe, power) JOIN wp USING (instrument_id, timeframe) WHERE part = 'E'""",
    "ablation_ranking": f"""WITH {BOTH}, {NESTED}, {_candidates('vx')}, {_walk(6 + len(ADDED))},
rk AS (SELECT wq.*, dimensions, split_part(timeframe, '/', 2) AS variant FROM wq JOIN wx USING (instrument_id, timeframe, power) JOIN wd USING (instrument_id, timeframe) WHERE part = 'E')
SELECT instrument_id, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY round(skill, 12) DESC, balanced_accuracy DESC, round(calibration_error, 12), coverage DESC, dimensions, variant) AS INTEGER) AS place, variant, CAST(dimensions AS INTEGER) AS dimensions, observations, resolved, {_rounded('skill balanced_accuracy calibration_error coverage')} FROM rk""",
    "sequential_residuals": f"""WITH {BOTH}, {COMMON}, {_candidates('vx')}, {_walk(6)}, va AS {_FEATURED} AND part = 'V'), ev AS {_FEATURED} AND part = 'E'),
{P.fit_sql('va', 'f1s', 'f1', _BP, _ID)}, {P.fit_sql('va', 'f2s', 'f2', _BP, _ID)}, {P.apply_sql('va', 'f1s', 'va1', 'f1', _BP, _ID)}, {P.fit_sql('va1', 'f2a', 'f2', _P, _ID)},
{P.apply_sql('ev', 'f1s', 'e1', 'f1', _BP, _ID)}, {P.apply_sql('ev', 'f2s', 'e2', 'f2', _BP, _ID)}, {P.apply_sql('e1', 'f2a', 'e12', 'f2', _P, _ID)}, e0 AS (SELECT *, {_PLAIN} FROM ev),
{_SCORE('e0', 's0')}, {_SCORE('e1', 's1')}, {_SCORE('e2', 's2')}, {_SCORE('e12', 's12')}
SELECT instrument_id, s0.cases, round(s0.b, 6) AS brier, round(s1.b, 6) AS brier_first, round(s2.b, 6) AS brier_second, round(s12.b, 6) AS brier_both FROM s0 JOIN s1 USING (instrument_id) JOIN s2 USING (instrument_id) JOIN s12 USING (instrument_id)""",
    "profile_checks": f"""WITH {Q.ORDER_BARS}, b AS (SELECT instrument_id, timeframe, count(*) AS bars, round((max(high) - min(low)) / max(high), 6) AS most, max(close_time_ns) AS last_ns FROM bars GROUP BY ALL),
p AS (SELECT 'stock:orders:' || instrument_id AS id, timeframe, most, last_ns, bars - 2 * CAST(floor(sqrt(bars)) AS BIGINT) AS train FROM b), k AS (SELECT *, CAST(floor(sqrt(train)) AS BIGINT) AS k, id || ':' || timeframe || ':{profiles.VERSION}' AS profile_id, unnest(['sound', 'tampered', 'stale']) AS form FROM p),
d AS (SELECT *, '{{"asset_class":"STOCK","barrier_down":0.75,"barrier_up":0.75,"dimensions":3,"effective":[true,true,false],"engine_version":"' || (CASE WHEN form = 'stale' THEN '0.9.0' ELSE '{profiles.ENGINE}' END) || '","form":"' || form || '","instrument_id":"' || id || '","k":' || k || ',"last_ns":'
  || last_ns || ',"least_support":' || least(length(bin(train)) - 1, k) || ',"most":' || most || ',"power":1.5,"profile_id":"' || profile_id || '","samples":' || train || ',"split_ns":' || {{split}} || ',"timeframe":"' || timeframe || '","untouched_test":true,"version":"{profiles.VERSION}"}}' AS doc FROM k)
SELECT profile_id, form, 'sha256:' || sha256(doc) AS profile_sha256, concat_ws(',', CASE WHEN form = 'stale' THEN 'ENGINE' END, CASE WHEN form = 'tampered' THEN 'HASH' END, CASE WHEN last_ns > {REGISTERED_NS} THEN 'PROSPECTIVE_TEST' END) AS failed FROM d""".replace("{split}", f"'{REGISTERED_NS}'"),
    "frozen_forward": f"""WITH {BOTH}, {COMMON}, {_candidates('vx')}, {_walk(6)}, va AS {_FEATURED} AND part = 'V'), ev AS {_FEATURED} AND part = 'E'),
{P.fit_sql('va', 'f1s', 'f1', _BP, _ID)}, {P.apply_sql('ev', 'f1s', 'e1', 'f1', _BP, _ID)}, e0 AS (SELECT *, {_PLAIN} FROM ev), {_SCORE('e0', 's0')}, {_SCORE('e1', 's1')},
su AS (SELECT instrument_id, count(*) FILTER ((f1 - mean) / dev < low) AS below, count(*) FILTER ((f1 - mean) / dev > high) AS above, count(*) AS total FROM ev JOIN f1s USING (instrument_id) GROUP BY 1)
SELECT instrument_id, s0.cases, round(s0.b, 6) AS brier, round(s1.b, 6) AS corrected_brier, below, total - below - above AS "within", above FROM s0 JOIN s1 USING (instrument_id) JOIN su USING (instrument_id)""",
}
