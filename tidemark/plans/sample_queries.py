"""Queries on labelled feature vectors, on records and on names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue
from ..operators import audits, calibrate, profiles, resample, residuals, scoring, validation
from ..operators import samples as S
from ..operators.pairwise import AllPairs
from ..operators.selection import quantiles
from ..session import shared_path, ship, stored
from ..sources import bars as B
from ..sources import records
from . import bar_queries
from . import sql as Q

K, LEAST = 10, 3
#: Dimensions of a sample: all of an embedding.
DIMS = 64
#: Queries are the samples whose id is divisible by this; all others are searched.
EVERY = 50


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a sample; some dimensions are left out to give masks."""
    cells = [F.when(F.col("vec_id") % 7 == 0, None).otherwise(F.col("embedding")[i].cast("double")) if i == 3 else F.col("embedding")[i].cast("double") for i in range(DIMS)]
    direction = F.element_at(F.array(*map(F.lit, ("UP", "RANGE", "DOWN"))), (F.col("label") % 3 + 1).cast("int"))
    return B.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.array(*cells).alias("vector"), direction.alias("direction"), (F.col("vec_id") % 10 + 1).cast("int").alias("first_passage_bars"))


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sample_rows(spark, sf_dir)
    scaled = S.normalize(rows, S.fit_normalization(rows))
    return scaled.where(F.col("sample_id") % EVERY == 0), scaled


def normalization_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.fit_normalization(sample_rows(spark, sf_dir))
    return found.select("axis", F.round("median", 10).alias("median"), F.round("scale", 10).alias("scale"), "effective")


def normalized_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_rows(spark, sf_dir)
    found = S.normalize(rows, S.fit_normalization(rows))
    return found.select("sample_id", "mask_key", *[F.round(F.col("vector")[i], 8).alias(f"x{i}") for i in range(DIMS)])


OTHERS = "others"


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, lib = _scaled(spark, sf_dir)
    return S.neighbours(q, lib, K, 4.0, OTHERS).select(F.col("q_sample_id").alias("query_id"), "rank", F.col("l_sample_id").alias("sample_id"), F.round("distance", 8).alias("distance"))


def temporal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only samples that are earlier and whose outcome was known before the query."""
    q, lib = (x.withColumns({"at": F.col("sample_id"), "known_at": F.col("sample_id") + F.col("first_passage_bars")}) for x in _scaled(spark, sf_dir))
    return S.neighbours(q, lib, K, None, "matured").select(F.col("q_sample_id").alias("query_id"), "rank", F.col("l_sample_id").alias("sample_id"), F.round("distance", 8).alias("distance"))


def kth_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, lib = _scaled(spark, sf_dir)
    return S.kth_distance(q, lib, K, OTHERS).select("query_id", F.round("kth_distance", 8).alias("kth_distance"), "n")


def _votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    q, lib = _scaled(spark, sf_dir)
    met = S.neighbours(q, lib, K, 4.0, OTHERS)
    votes = S.vote(met, LEAST)
    cases = votes.join(q.select(F.col("sample_id").alias("query_id"), F.col("direction").alias("actual")), "query_id").withColumnRenamed("winner", "predicted")
    return met, votes, cases, lib


def knn_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir)[1].select("query_id", "support", "up_bp", "range_bp", "down_bp", "winner", "edge_bp")


def weighted_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    met, votes, _, _ = _votes(spark, sf_dir)
    return S.weighted_horizon(met, votes)


def knn_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reliability(_votes(spark, sf_dir)[2])


def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recall(_votes(spark, sf_dir)[2])


def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cases, lib = _votes(spark, sf_dir)
    found = scoring.summary(cases, lib)
    return found.select("cases", "correct", "accuracy_bp", "balanced_accuracy_bp", *[F.round(c, 8).alias(c) for c in ("brier", "climatology", "skill", "calibration_error")])


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(_votes(spark, sf_dir)[2])


def publication_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)[1]
    return scoring.publish(votes, 0.05, 1_000, {"UP": 6_000, "RANGE": 5_500, "DOWN": 4_000}).groupBy("gate", "published").agg(F.count("*").alias("votes"))


def _pairs(spark: SparkSession, sf_dir: str) -> AllPairs:
    """Every sample against every sample."""
    rows = sample_rows(spark, sf_dir)
    scaled = S.normalize(rows, S.fit_normalization(rows))
    return AllPairs(scaled, scaled)


def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.compactness(_pairs(spark, sf_dir))
    return found.select("query_id", *[F.round(c, 8).alias(c) for c in found.columns[1:]])


def compactness_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.compactness(_pairs(spark, sf_dir), causal=True)
    return found.select("query_id", *[F.round(c, 8).alias(c) for c in found.columns[1:]])


def class_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.class_geometry(AllPairs(*_scaled(spark, sf_dir)))
    return found.select("query_id", "direction", "n", "nearest_rank", *[F.round(c, 8).alias(c) for c in ("least", "p10", "p25", "p50", "p75", "most")])


def neighbour_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _votes(spark, sf_dir)[0]
    return audits.top_dimensions(met).select("query_id", "place", "axis", F.round("mean_share", 8).alias("mean_share"))


def dimension_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.availability(sample_rows(spark, sf_dir))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-of-middle and upper medians of prices and quantities by flag."""
    rows = B.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    both = quantiles(rows, ["l_returnflag"], "l_extendedprice", {"median_price": 0.5}).drop("n")
    return both.join(audits.upper_median(rows, ["l_returnflag"], "q"), "l_returnflag")


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.distance_stats(B.read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return found.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("least", "p10", "p25", "p50", "p75", "most")])


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "lineitem").withColumn("flat", F.lit(1.0))
    return rows.groupBy("l_returnflag").agg(F.round(audits.guarded_corr("l_quantity", "l_extendedprice"), 8).alias("price_quantity"), audits.guarded_corr("l_quantity", "flat").alias("none"))


def optional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means that skip what is missing, and shares of a condition."""
    rows = B.read(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")))
    return rows.groupBy("l_shipdate").agg(F.round(F.avg("x"), 8).alias("mean_x"), F.round(F.avg((F.col("l_tax") > 0.04).cast("double")), 8).alias("share"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Voted cases before and from the middle query on, with a feature of the query: its first dimension."""
    _, _, cases, lib = _votes(spark, sf_dir)
    feature = lib.select(F.col("sample_id").alias("query_id"), F.col("vector")[0].alias("feature"))
    rows = stored(residuals.forecasts(cases).join(feature, "query_id").withColumn("all", F.lit("all")), "cases")
    middle = rows.agg(F.percentile("query_id", F.lit(0.5)).alias("middle"))
    parted = rows.join(F.broadcast(middle), F.lit(1) == F.lit(1))  # one row
    return parted.where("query_id < middle").drop("middle"), parted.where("query_id >= middle").drop("middle")


def residual_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of a feature on the errors of the first half of the cases."""
    found = residuals.fit(_halves(spark, sf_dir)[0], "feature", ["all"]).drop("all")
    return found.select(*[F.col(c) if c == "n" else F.round(c, 8).alias(c) for c in found.columns])


def corrected_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That fit applied to the later half, within the range that the feature had in the first."""
    early, late = _halves(spark, sf_dir)
    moved = residuals.apply(late, "feature", residuals.fit(early, "feature", ["all"]), ["all"])
    return moved.select("query_id", *[F.round(f"p_{n}", 8).alias(f"p_{n}") for n in residuals.NAMES], F.round(residuals.brier(), 8).alias("corrected_brier"))


def basis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "customer").select("c_custkey", S.basis_points(F.col("c_custkey") % 7 * 1.0, F.col("c_custkey") % 11 * 1.0, F.col("c_custkey") % 3 * 1.0).alias("bp"))
    return rows.select("c_custkey", F.col("bp")[0].alias("up_bp"), F.col("bp")[1].alias("range_bp"), F.col("bp")[2].alias("down_bp"))


def calibrated_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end-to-end fit: its parameters and its score on held-out rows."""
    model = calibrate.fit(sample_rows(spark, sf_dir))
    p = model["parameters"]
    return spark.createDataFrame([(p.lookback, p.horizon, p.held_out, p.k, p.least_support, model["power"], model["edge_bp"], model["score"]["cases"], model["score"]["brier"])], "lookback int, horizon int, held_out int, k int, least_support int, power double, edge_bp long, cases long, brier double")


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates written in three formats, and one that none fits, read back."""
    d = F.to_date("l_shipdate")
    text = F.when(F.col("l_linenumber") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("l_linenumber") % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(F.col("l_linenumber") % 4 == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    rows = B.read(spark, sf_dir, "lineitem").select(records.parse_date(text).alias("day"))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as people type them, made from nations and aliases."""
    typed = [" btc", "Btc-USDT", "eur/usd", "s&p 500", "sp500", "GOLD!", "nasdaq", "aapl", "doge", ""]
    asked = B.read(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, typed)), (F.col("n_nationkey") % len(typed) + 1).cast("int")).alias("name"))
    return catalogue.resolve(asked, catalogue.instruments(spark))


def _replies(spark: SparkSession, sf_dir: str, body) -> DataFrame:
    bars = B.order_bars(spark, sf_dir)
    week = F.floor(F.col("open_time_ns") / (30 * Q.DAY))
    return bars.withColumn("page", week).groupBy("instrument_id", "page").agg(body)


def klines_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured kline replies, a page a month, read back up to a moment."""
    ms = lambda c: F.floor(F.col(c) / 1_000_000).cast("string")
    text = lambda c: F.col(c).cast("string")
    k = F.array(ms("open_time_ns"), text("open"), text("high"), text("low"), text("close"), F.lit("-1"), ms("close_time_ns"), text("trade_count"), text("trade_count"))
    replies = _replies(spark, sf_dir, F.to_json(F.collect_list(k)).alias("reply"))
    return records.klines(replies, F.lit(10_000 * 86_400_000), "D1", "klines").select("instrument_id", "open_time_ns", "close_time_ns", "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


def aggregates_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.struct(F.floor(F.col("open_time_ns") / 1_000_000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), (F.col("trade_count") - 3.0).alias("v"), F.col("trade_count").alias("n"))
    replies = _replies(spark, sf_dir, F.to_json(F.struct(F.lit("OK").alias("status"), F.collect_list(b).alias("results"))).alias("reply"))
    return records.aggregates(replies, "aggregates").select("instrument_id", "open_time_ns", "close_time_ns", "open", "high", "low", "close", "volume", "trade_count")


def session_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.struct(catalogue.day_text(F.col("open_time_ns")).alias("session_end_date"), "open", "high", "low", "close", F.col("trade_count").cast("double").alias("volume"))
    replies = _replies(spark, sf_dir, F.to_json(F.struct(F.collect_list(b).alias("results"))).alias("reply"))
    return records.session_bars(replies, F.lit(10_000), "sessions").select("instrument_id", "open_time_ns", "close_time_ns", "open", "high", "low", "close", "volume")


def nearest_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("ticker"), (F.col("p_size") - 10).alias("days"))
    return records.nearest_contract(rows, ["p_brand"])


def daily_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order series written as CSV with odd headers, a file each, and read back as bars."""
    path = shared_path(spark, "csv")
    bars = B.order_bars(spark, sf_dir)
    text = bars.select("instrument_id", "open_time_ns", catalogue.day_text(F.col("open_time_ns")).alias("Date"), F.col("close").alias("CLOSE"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), (F.col("trade_count") - 1).alias("Vol"))
    text.repartition("instrument_id").sortWithinPartitions("instrument_id", "open_time_ns").drop("open_time_ns").write.partitionBy("instrument_id").csv(path, header=True)
    return records.read_daily_csv(spark, path, F.col("instrument_id"), "csv").select("instrument_id", "open_time_ns", "close_time_ns", "open", "high", "low", "close", "volume")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of every order series as a CSV file. One has malformed days, the manifest has a row too many for
    another and a digest that isn't a third one's."""
    path = shared_path(spark, "files")
    name, bad = F.col("instrument_id"), (F.col("instrument_id") == "2-HIGH") & F.expr(f"(open_time_ns DIV {Q.DAY}) % 50 = 0")
    bars = B.order_bars(spark, sf_dir).withColumn("bad", bad).withColumn("day", F.date_from_unix_date(F.expr(f"CAST(open_time_ns DIV {Q.DAY} AS INT)")).cast("string"))
    price = lambda c: c.cast("decimal(18,2)").cast("string")
    text = bars.select(name.alias("file"), F.col("day").alias("Date"), price(F.col("open")).alias("Open"), price(F.when(F.col("bad"), F.col("low") - 1).otherwise(F.col("high"))).alias("High"), price(F.col("low")).alias("Low"), price(F.col("close")).alias("Close"), (F.col("trade_count") - 1).alias("Volume"))
    text.repartition("file").sortWithinPartitions("file", "Date").write.partitionBy("file").csv(path, header=True)
    right = records.file_digests(spark, path).select(F.col("file").cast("string").alias("file"), "sha256")
    sound = F.when(~F.col("bad"), F.col("day"))
    told = bars.groupBy(name.alias("file")).agg((F.count("*") + F.when(F.first(name) == "5-LOW", 1).otherwise(0)).alias("rows"), F.min(sound).alias("first_day"), F.max(sound).alias("last_day")).join(right, "file")
    manifest = told.withColumn("sha256", F.when(F.col("file") == "1-URGENT", "0").otherwise(F.col("sha256")))
    return records.audit_files(spark, path, manifest).select("file", "rows", "valid_rows", "malformed", "volume_available", "first_day", "last_day", "sha256", "status")


def kernel_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel input written as CSV, blank where a control does not apply, and read back."""
    path = shared_path(spark, "kernel")
    k = F.col("c_custkey")
    rows = B.read(spark, sf_dir, "customer").select((k * 1_000_000_000).alias("timestamp_ns"), F.col("c_acctbal").cast("double").alias("omega"), F.when(k % 3 != 0, F.col("c_acctbal") / 2).alias("expected"), F.when(k % 4 == 0, k * 0.5).alias("u_lambda"), F.when(k % 5 != 0, k % 2 == 0).alias("sigma_op"))
    rows.write.csv(path, header=True)
    return records.read_kernel_csv(spark, path).withColumn("sigma_op", F.col("sigma_op").cast("string"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests appended twice to a log of JSON lines, and read back."""
    path = shared_path(spark, "log")
    rows = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    for _ in range(2):
        records.write_documents(rows, path, "append")
    return spark.read.schema("key long, name string").json(path).groupBy("key", "name").agg(F.count("*").alias("entries"))


def source_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source serves each of a table of requests."""
    k = F.col("c_custkey")
    asked = F.when(k % 4 == 0, "SUPPLIED_CORPUS").otherwise("AUTO")
    rows = B.read(spark, sf_dir, "customer").select("c_custkey", records.chosen_source(asked, F.when(k % 7 != 0, k % 3 == 0), k % 5 != 0).alias("s"))
    return rows.select("c_custkey", "s.source", "s.status")


def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each of a table of requests."""
    k = F.col("c_custkey")
    frames = F.filter(F.array(F.lit("D1"), F.when(k % 2 == 0, "W1"), F.when(k % 7 == 0, "D1"), F.when(k % 11 == 0, "H1")), lambda f: f.isNotNull())
    problem = validation.request_problems(frames, F.when(k % 13 == 0, F.array(F.lit("k"))), F.when(k % 17 == 0, "LIVE_PREVIEW").otherwise("HISTORICAL"))
    return B.read(spark, sf_dir, "customer").select(F.coalesce(problem, F.lit("SERVED")).alias("problem")).groupBy("problem").agg(F.count("*").alias("requests"))


def profile_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which profiles can be served, given their state and the audit of their corpus."""
    k = F.col("n_nationkey")
    nations = B.read(spark, sf_dir, "nation")
    profiles = nations.select(F.col("n_name").alias("instrument_id"), F.explode(F.array(F.lit("D1"), F.lit("W1"))).alias("timeframe"), (k % 5 != 0).alias("loaded"), F.when(k % 7 != 3, k % 4 != 1).alias("valid"))
    corpus = nations.where("n_nationkey % 6 <> 2").select(F.col("n_name").alias("instrument_id"), F.when(k % 3 == 0, "REJECTED").otherwise("ACCEPTED").alias("status"))
    return validation.readiness(profiles, corpus)


def weekly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars made once from daily ones, and left alone the second time."""
    once = resample.closed_weekly_once(B.lineitem_bars(spark, sf_dir), "D1")
    return resample.closed_weekly_once(once, "W1").groupBy("instrument_id").agg(F.count("*").alias("weeks"), F.round(F.sum("close"), 4).alias("closes"))


def scalar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, numeric strings and rubbish out of JSON documents."""
    rows = B.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    odd = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 5 == 1, "-3").when(F.col("event_id") % 5 == 2, " 7.5 ").otherwise(F.col("k"))
    return rows.select("event_id", records.finite(odd).alias("number"), records.optional(odd).alias("amount"))


def day_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, their exclusive ends, and timeframe names in any case."""
    frame = F.element_at(F.array(*map(F.lit, ("d1", " W1", "h4", "x9"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = B.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), catalogue.timeframe_of(frame).alias("timeframe"))
    return rows.select("o_orderkey", catalogue.day_end_ns(F.col("d")).alias("day_end_ns"), catalogue.day_text(F.unix_date("d").cast("long") * Q.DAY).alias("day"), "timeframe")


def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each nation's canonical document (its fields come unordered)."""
    docs = B.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return docs.select("n_nationkey", profiles.digest(docs, ["region", "name", "key"]).alias("digest"))


def signal_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response document of each series: status, bars, last close, and its digest."""
    bars = B.event_bars(spark, sf_dir, "D1").unionByName(B.order_bars(spark, sf_dir))
    last = bars.groupBy("instrument_id").agg(F.count("*").alias("bars"), F.max("close_time_ns").alias("watermark_ns"))
    status = F.when(F.col("bars") < 60, "INSUFFICIENT_DATA").otherwise("STALE_DATA")
    doc = F.concat(F.lit('{"bars":'), F.col("bars").cast("string"), F.lit(',"instrument":"'), F.col("instrument_id"), F.lit('","status":"'), status, F.lit('"}'))
    return last.select("instrument_id", status.alias("status"), "watermark_ns", doc.alias("document"), F.concat(F.lit("sha256:"), F.sha2(doc, 256)).alias("response_sha256"))


QUERIES = {f.__name__: f for f in (normalization_fit, normalized_samples, knn_neighbours, temporal_neighbours, kth_distances, knn_votes, weighted_horizons, knn_reliability, knn_recall, knn_scores, confusion_matrix, publication_gates, compactness, compactness_causal, class_geometry, neighbour_anatomy, dimension_availability, medians, price_quantiles, correlations, optional_means, residual_slopes, corrected_forecasts, basis_points, calibrated_model, parsed_dates, resolved_names, klines_json, aggregates_json, session_json, nearest_contracts, daily_csv, corpus_files, kernel_csv, document_log, source_choices, request_problems, profile_readiness, weekly_once, scalar_fields, day_texts, canonical_digests, signal_responses)}

_CELLS = ", ".join(f"CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END" if i == 3 else f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(DIMS))
SAMPLES = f"""sm AS (SELECT vec_id AS sample_id, [{_CELLS}] AS v, ['UP', 'RANGE', 'DOWN'][label % 3 + 1] AS direction, CAST(vec_id % 10 + 1 AS INTEGER) AS fp FROM embeddings),
cl AS (SELECT sample_id, unnest(v) AS x, unnest(range({DIMS})) AS axis FROM sm),
c1 AS (SELECT axis, coalesce(quantile_cont(x, 0.5), 0) AS med, max(x) - min(x) AS wide FROM cl GROUP BY 1),
nm AS (SELECT axis, med, CASE WHEN coalesce(quantile_cont(abs(x - med), 0.5), 0) > 0 THEN quantile_cont(abs(x - med), 0.5) WHEN any_value(wide) > 0 THEN any_value(wide) / 2 ELSE 1 END AS scale, any_value(coalesce(wide, 0)) > 0 AS eff FROM cl JOIN c1 USING (axis) GROUP BY 1, 2)"""
SCALED = f"""{SAMPLES}, sc AS (SELECT sm.sample_id, any_value(direction) AS direction, any_value(fp) AS fp, list(coalesce((cl.x - med) / scale, 0) ORDER BY axis) AS v, list(cl.x IS NOT NULL AND eff ORDER BY axis) AS m,
  string_agg(CASE WHEN cl.x IS NOT NULL AND eff THEN '1' ELSE '0' END, '' ORDER BY axis) AS mask_key FROM sm JOIN cl USING (sample_id) JOIN nm USING (axis) GROUP BY 1)"""
_DIST = f"sqrt(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: CASE WHEN q.m[i] THEN (q.v[i] - l.v[i]) * (q.v[i] - l.v[i]) ELSE 0 END)) / len(list_filter(q.m, lambda x: x)))"
EVERY_PAIR = f"{SCALED}, pr AS (SELECT q.sample_id AS query_id, l.sample_id, q.direction AS qd, l.direction AS ld, l.fp, q.v AS qv, l.v AS lv, q.m AS qm, {_DIST} AS distance FROM sc q JOIN sc l ON q.mask_key = l.mask_key)"
PAIRS = f"{EVERY_PAIR[:-1]} WHERE q.sample_id % {EVERY} = 0)"
MET = f"{PAIRS}, met AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, sample_id) AS rank FROM pr WHERE sample_id <> query_id AND distance <= 4.0 QUALIFY rank <= {K})"


def _bp(up: str, rng: str, down: str) -> str:
    """Largest remainder over three masses: a list of three numbers."""
    total = f"({up} + {rng} + {down})"
    exact = f"[{up} / {total} * 10000, {rng} / {total} * 10000, {down} / {total} * 10000]"
    return f"""CASE WHEN {total} > 0 THEN list_transform(range(1, 4), lambda i: CAST(floor({exact}[i]) AS BIGINT) +
    CASE WHEN list_position(list_transform(list_sort(list_transform(range(1, 4), lambda j: {{'f': floor({exact}[j]) - {exact}[j], 'j': j}})), lambda s: s.j), i) <= 10000 - list_sum(list_transform({exact}, lambda e: floor(e))) THEN 1 ELSE 0 END)
    ELSE [0::BIGINT, 10000::BIGINT, 0::BIGINT] END"""


_W = "1.0 / greatest(distance, pow(2.0, -26))"
VOTES = f"""{MET}, ms AS (SELECT query_id, any_value(qd) AS actual, count(*) AS support, sum(CASE WHEN ld = 'UP' THEN {_W} ELSE 0 END) AS u, sum(CASE WHEN ld = 'RANGE' THEN {_W} ELSE 0 END) AS g, sum(CASE WHEN ld = 'DOWN' THEN {_W} ELSE 0 END) AS d FROM met GROUP BY 1 HAVING count(*) >= {LEAST}),
b3 AS (SELECT *, {_bp('u', 'g', 'd')} AS bp FROM ms),
vt AS (SELECT query_id, actual, support, bp[1] AS up_bp, bp[2] AS range_bp, bp[3] AS down_bp, CASE WHEN bp[1] >= bp[2] AND bp[1] >= bp[3] THEN 'UP' WHEN bp[2] >= bp[3] THEN 'RANGE' ELSE 'DOWN' END AS winner, list_reverse_sort(bp)[1] - list_reverse_sort(bp)[2] AS edge_bp FROM b3)"""
_Z = "1.959963984540054::DOUBLE"


def _ratio(a: str, b: str) -> str:
    return f"CAST(({a} * 10000 + {b} // 2) // {b} AS BIGINT)"


_BRIER = "pow(up_bp / 10000.0 - (CASE WHEN actual = 'UP' THEN 1 ELSE 0 END), 2) + pow(range_bp / 10000.0 - (CASE WHEN actual = 'RANGE' THEN 1 ELSE 0 END), 2) + pow(down_bp / 10000.0 - (CASE WHEN actual = 'DOWN' THEN 1 ELSE 0 END), 2)"
STATS = "round(min(distance), 8) AS least, round(quantile_cont(distance, 0.1), 8) AS p10, round(quantile_cont(distance, 0.25), 8) AS p25, round(quantile_cont(distance, 0.5), 8) AS p50, round(quantile_cont(distance, 0.75), 8) AS p75, round(max(distance), 8) AS most"


def _compact(where: str) -> str:
    share = lambda k: f"round(count(*) FILTER (same AND rank <= {k}) / count(*) FILTER (rank <= {k}), 8) AS same_share_{k}"
    return f"""WITH {EVERY_PAIR}, r AS (SELECT *, qd = ld AS same, row_number() OVER (PARTITION BY query_id ORDER BY distance, sample_id) AS rank FROM pr WHERE {where})
SELECT query_id, round(min(distance) FILTER (same), 8) AS nearest_same, round(min(distance) FILTER (NOT same), 8) AS nearest_other, {share(5)}, {share(10)}, {share(20)} FROM r GROUP BY 1"""


_CASES = f"""WITH {VOTES}, ca AS (SELECT vt.*, v[1] AS f FROM vt JOIN sc ON sc.sample_id = vt.query_id), mid AS (SELECT quantile_cont(query_id, 0.5) AS middle FROM ca),
early AS (SELECT ca.* FROM ca, mid WHERE query_id < middle), late AS (SELECT ca.* FROM ca, mid WHERE query_id >= middle)"""


def fit_sql(src: str, name: str, feature: str, p: str = "{}_bp / 10000.0", by: str = "") -> str:
    """CTEs of a residual fit, as ``residuals.fit``."""
    err = lambda c: f"((CASE WHEN actual = '{c.upper()}' THEN 1.0 ELSE 0.0 END) - {p.format(c)})"
    key, group, using = (f"{by}, ", f" GROUP BY {by}", f"JOIN {name}_m USING ({by})") if by else ("", "", f", {name}_m")
    cols = ", ".join(f"(sum(z * {err(c)}) - avg({err(c)}) * sum(z)) / sum(z * z) AS slope_{c}" for c in ("up", "range", "down"))
    return f"""{name}_m AS (SELECT {key}avg({feature}) AS mean, stddev_pop({feature}) AS dev FROM {src} WHERE {feature} IS NOT NULL{group}), {name}_z AS (SELECT *, ({feature} - mean) / dev AS z FROM {src} {using} WHERE {feature} IS NOT NULL),
{name} AS (SELECT {key}count(*) AS n, any_value(mean) AS mean, any_value(dev) AS dev, min(z) AS low, max(z) AS high, {', '.join(f'avg({err(c)}) AS intercept_{c}' for c in ('up', 'range', 'down'))}, {cols} FROM {name}_z{group})"""


def apply_sql(src: str, fitted: str, name: str, feature: str, p: str = "{}_bp / 10000.0", by: str = "") -> str:
    """CTEs of its application: {name} has the columns of ``src`` with p_up, p_range and p_down."""
    met = f"{src} JOIN {fitted} USING ({by})" if by else f"{src}, {fitted}"
    raw = ", ".join(f"greatest({p.format(c)} + slope_{c} * greatest(least(({feature} - mean) / dev, high), low), 0) AS m_{c}" for c in ("up", "range", "down"))
    drop = "" if p.startswith("{}_bp") else " EXCLUDE (p_up, p_range, p_down)"
    total = "(m_up + m_range + m_down)"
    share = ", ".join(f"CASE WHEN {total} > 0 THEN m_{c} / {total} ELSE 1.0 / 3 END AS p_{c}" for c in ("up", "range", "down"))
    return f"{name}_r AS (SELECT {src}.*, {raw} FROM {met}), {name} AS (SELECT *{drop}, {share} FROM {name}_r)".replace(f"SELECT *{drop}, CASE", f"SELECT * EXCLUDE (m_up, m_range, m_down{', p_up, p_range, p_down' if drop else ''}), CASE")


BRIER_P = " + ".join(f"pow(p_{c} - (CASE WHEN actual = '{c.upper()}' THEN 1 ELSE 0 END), 2)" for c in ("up", "range", "down"))

WEEKLY_ONCE = f"SELECT instrument_id, count(*) AS weeks, round(sum(close), 4) AS closes FROM ({bar_queries.ORACLE['weekly_bars']}) GROUP BY 1"

ORACLE = {
    "normalization_fit": f"WITH {SAMPLES} SELECT CAST(axis AS INTEGER) AS axis, round(med, 10) AS median, round(scale, 10) AS scale, eff AS effective FROM nm",
    "normalized_samples": f"WITH {SCALED} SELECT sample_id, mask_key, {', '.join(f'round(v[{i + 1}], 8) AS x{i}' for i in range(DIMS))} FROM sc",
    "knn_neighbours": f"WITH {MET} SELECT query_id, CAST(rank AS INTEGER) AS rank, sample_id, round(distance, 8) AS distance FROM met",
    "temporal_neighbours": f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, sample_id) AS rank FROM pr WHERE sample_id < query_id AND sample_id + fp < query_id QUALIFY rank <= {K}) SELECT query_id, CAST(rank AS INTEGER) AS rank, sample_id, round(distance, 8) AS distance FROM t",
    "kth_distances": f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, sample_id) AS rank FROM pr WHERE sample_id <> query_id QUALIFY rank <= {K}) SELECT query_id, round(max(distance), 8) AS kth_distance, count(*) AS n FROM t GROUP BY 1",
    "knn_votes": f"WITH {VOTES} SELECT query_id, support, up_bp, range_bp, down_bp, winner, edge_bp FROM vt",
    "weighted_horizons": f"""WITH {VOTES}, w AS (SELECT met.query_id, fp AS bars, {_W} AS wt, rank FROM met JOIN vt ON met.query_id = vt.query_id AND ld = winner),
cu AS (SELECT *, sum(wt) OVER (PARTITION BY query_id ORDER BY bars, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, sum(wt) OVER (PARTITION BY query_id) AS t FROM w)
SELECT query_id, min(bars) FILTER (r >= t * 0.25) AS p25_bars, min(bars) FILTER (r >= t * 0.5) AS median_bars, min(bars) FILTER (r >= t * 0.75) AS p75_bars, CAST(min(bars) FILTER (r >= t * 0.5) AS BIGINT) * 86400 AS median_seconds FROM cu GROUP BY 1""",
    "knn_reliability": f"""WITH {VOTES}, c AS (SELECT winner AS direction, count(*) AS cases, count(*) FILTER (winner = actual) AS correct FROM vt GROUP BY 1), p AS (SELECT *, correct / cases AS p, {_Z} * {_Z} AS z2 FROM c)
SELECT direction, cases, correct, {_ratio('correct', 'cases')} AS precision_bp, CAST(floor(greatest(least(((p + z2 / (2 * cases)) - {_Z} * sqrt((p * (1 - p) + z2 / (4 * cases)) / cases)) / (1 + z2 / cases), 1), 0) * 10000 + 0.5) AS BIGINT) AS lower_bp FROM p""",
    "knn_recall": f"WITH {VOTES}, c AS (SELECT actual AS direction, count(*) AS cases, count(*) FILTER (winner = actual) AS correct FROM vt GROUP BY 1) SELECT *, {_ratio('correct', 'cases')} AS recall_bp FROM c",
    "knn_scores": f"""WITH {VOTES}, rc AS (SELECT CAST(floor(avg(r)) AS BIGINT) AS bal FROM (SELECT {_ratio("count(*) FILTER (winner = actual)", "count(*)")} AS r FROM vt GROUP BY actual)),
lb AS (SELECT count(*) FILTER (direction = 'UP') / count(*) AS fu, count(*) FILTER (direction = 'RANGE') / count(*) AS fr, count(*) FILTER (direction = 'DOWN') / count(*) AS fd FROM sc),
s AS (SELECT count(*) AS cases, count(*) FILTER (winner = actual) AS correct, avg({_BRIER}) AS brier, avg(pow(fu - (CASE WHEN actual = 'UP' THEN 1 ELSE 0 END), 2) + pow(fr - (CASE WHEN actual = 'RANGE' THEN 1 ELSE 0 END), 2) + pow(fd - (CASE WHEN actual = 'DOWN' THEN 1 ELSE 0 END), 2)) AS clim,
  (abs(avg(up_bp / 10000.0) - count(*) FILTER (actual = 'UP') / count(*)) + abs(avg(range_bp / 10000.0) - count(*) FILTER (actual = 'RANGE') / count(*)) + abs(avg(down_bp / 10000.0) - count(*) FILTER (actual = 'DOWN') / count(*))) / 3 AS gap FROM vt, lb)
SELECT cases, correct, {_ratio('correct', 'cases')} AS accuracy_bp, bal AS balanced_accuracy_bp, round(brier, 8) AS brier, round(clim, 8) AS climatology, round(1 - brier / clim, 8) AS skill, round(gap, 8) AS calibration_error FROM s, rc""",
    "confusion_matrix": f"WITH {VOTES}, c AS (SELECT unnest(['UP', 'RANGE', 'DOWN']) AS n), g AS (SELECT a.n AS actual, p.n AS predicted FROM c a, c p) SELECT g.actual, g.predicted, count(vt.query_id) AS cases FROM g LEFT JOIN vt ON vt.actual = g.actual AND vt.winner = g.predicted GROUP BY 1, 2",
    "publication_gates": f"WITH {VOTES}, g AS (SELECT CASE WHEN edge_bp < 1000 THEN 'EDGE_TOO_SMALL' WHEN winner = 'DOWN' THEN 'UNRELIABLE' ELSE 'PUBLISHED' END AS gate, winner FROM vt) SELECT gate, CASE WHEN gate = 'PUBLISHED' THEN winner ELSE 'UNRESOLVED' END AS published, count(*) AS votes FROM g GROUP BY 1, 2",
    "compactness": _compact("sample_id <> query_id"),
    "compactness_causal": _compact("sample_id < query_id"),
    "class_geometry": f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, sample_id) AS rank FROM pr WHERE sample_id <> query_id) SELECT query_id, ld AS direction, count(*) AS n, CAST(min(rank) AS INTEGER) AS nearest_rank, {STATS} FROM r GROUP BY 1, 2",
    "neighbour_anatomy": f"""WITH {MET}, sq AS (SELECT query_id, sample_id, unnest(range({DIMS})) AS axis, unnest(list_transform(range(1, {DIMS + 1}), lambda i: CASE WHEN qm[i] THEN (qv[i] - lv[i]) * (qv[i] - lv[i]) ELSE 0 END)) AS s FROM met),
sh AS (SELECT query_id, axis, s / sum(s) OVER (PARTITION BY query_id, sample_id) AS share FROM sq), me AS (SELECT query_id, axis, avg(share) AS ms FROM sh GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(ms, 12) DESC, axis) AS INTEGER) AS place, CAST(axis AS INTEGER) AS axis, round(ms, 8) AS mean_share FROM me QUALIFY place <= 5""",
    "dimension_availability": f"WITH {SAMPLES} SELECT CAST(axis AS INTEGER) AS axis, count(*) AS rows, {_ratio('count(x)', 'count(*)')} AS available_bp FROM cl GROUP BY 1",
    "medians": "WITH s AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median_price, list(CAST(l_quantity AS BIGINT) ORDER BY l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, median_price, q[len(q) // 2 + 1] AS upper_median FROM s",
    "price_quantiles": f"SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, {STATS.replace('distance', 'l_extendedprice').replace(', 8)', ', 6)')} FROM lineitem GROUP BY 1, 2",
    "correlations": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS price_quantity, CAST(NULL AS DOUBLE) AS \"none\" FROM lineitem GROUP BY 1",
    "optional_means": "SELECT l_shipdate, round(avg(CASE WHEN l_linenumber > 2 THEN l_quantity END), 8) AS mean_x, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 8) AS share FROM lineitem GROUP BY 1",
    "residual_slopes": f"{_CASES}, {fit_sql('early', 'sl', 'f')} SELECT n, {', '.join(f'round({c}, 8) AS {c}' for c in ('mean', 'dev', 'low', 'high', *[f'{x}_{c}' for x in ('intercept', 'slope') for c in ('up', 'range', 'down')]))} FROM sl",
    "corrected_forecasts": f"{_CASES}, {fit_sql('early', 'sl', 'f')}, {apply_sql('late', 'sl', 'mv', 'f')} SELECT query_id, round(p_up, 8) AS p_up, round(p_range, 8) AS p_range, round(p_down, 8) AS p_down, round({BRIER_P}, 8) AS corrected_brier FROM mv",
    "basis_points": f"WITH m AS (SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) AS u, CAST(c_custkey % 11 AS DOUBLE) AS g, CAST(c_custkey % 3 AS DOUBLE) AS d FROM customer), b AS (SELECT c_custkey, {_bp('u', 'g', 'd')} AS bp FROM m) SELECT c_custkey, bp[1] AS up_bp, bp[2] AS range_bp, bp[3] AS down_bp FROM b",
    "parsed_dates": "SELECT CASE WHEN l_linenumber % 4 <> 3 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day, count(*) AS rows FROM lineitem GROUP BY 1",
    "resolved_names": """WITH t AS (SELECT DISTINCT [' btc', 'Btc-USDT', 'eur/usd', 's&p 500', 'sp500', 'GOLD!', 'nasdaq', 'aapl', 'doge', ''][n_nationkey % 10 + 1] AS name FROM nation),
a(k, i) AS (VALUES ('BTC', 'crypto:binance:BTCUSDT'), ('BTCUSDT', 'crypto:binance:BTCUSDT'), ('EURUSD', 'forex:massive:EURUSD'), ('SP500', 'index:massive:SPX'), ('GOLD', 'futures:massive:GC'), ('NASDAQ', 'index:massive:NDX'), ('AAPL', 'stock:massive:AAPL'))
SELECT name, CASE WHEN i IS NULL THEN 'UNSUPPORTED' ELSE 'FOUND' END AS status, coalesce(i, '') AS instrument_ids FROM t LEFT JOIN a ON regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') = k""",
    "klines_json": f"WITH {Q.ORDER_BARS} SELECT instrument_id, open_time_ns, close_time_ns, open, high, low, close, CAST(NULL AS DOUBLE) AS volume, CAST(trade_count AS DOUBLE) AS quote_volume, trade_count FROM bars WHERE close_time_ns < {10_000 * Q.DAY}",
    "aggregates_json": f"WITH {Q.ORDER_BARS} SELECT instrument_id, open_time_ns, close_time_ns - 1 AS close_time_ns, open, high, low, close, CASE WHEN trade_count >= 3 THEN trade_count - 3.0::DOUBLE END AS volume, trade_count FROM bars",
    "session_json": f"WITH {Q.ORDER_BARS} SELECT instrument_id, open_time_ns, close_time_ns - 1 AS close_time_ns, open, high, low, close, CAST(trade_count AS DOUBLE) AS volume FROM bars WHERE open_time_ns < {10_000 * Q.DAY}",
    "nearest_contracts": "WITH p AS (SELECT p_brand, p_name AS ticker, p_size - 10 AS days FROM part), c AS (SELECT p_brand, coalesce(min({'d': days, 't': ticker}) FILTER (days >= 20), min({'d': days, 't': ticker}) FILTER (days >= 0)) AS c FROM p GROUP BY 1) SELECT p_brand, c.t AS ticker, c.d AS days FROM c",
    "daily_csv": f"WITH {Q.ORDER_BARS} SELECT instrument_id, open_time_ns, close_time_ns, open, high, low, close, CASE WHEN trade_count > 1 THEN CAST(trade_count - 1 AS DOUBLE) END AS volume FROM bars",
    "kernel_csv": "SELECT c_custkey * 1000000000 AS timestamp_ns, CAST(c_acctbal AS DOUBLE) AS omega, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 2 END AS expected, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 0.5::DOUBLE END AS u_lambda, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 2 = 0 AS VARCHAR) END AS sigma_op FROM customer",
    "document_log": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, 2 AS entries FROM nation",
    "corpus_files": f"""WITH {Q.ORDER_BARS}, t AS (SELECT *, instrument_id = '2-HIGH' AND (open_time_ns // {Q.DAY}) % 50 = 0 AS bad, CAST(CAST(make_timestamp_ns(open_time_ns) AS DATE) AS VARCHAR) AS day FROM bars),
l AS (SELECT *, day || ',' || CAST(CAST(open AS DECIMAL(18,2)) AS VARCHAR) || ',' || CAST(CAST(CASE WHEN bad THEN low - 1 ELSE high END AS DECIMAL(18,2)) AS VARCHAR) || ',' || CAST(CAST(low AS DECIMAL(18,2)) AS VARCHAR) || ',' || CAST(CAST(close AS DECIMAL(18,2)) AS VARCHAR) || ',' || (trade_count - 1) || chr(10) AS line FROM t)
SELECT instrument_id AS file, count(*) AS rows, count(*) FILTER (NOT bad) AS valid_rows, count(*) FILTER (bad) AS malformed, count(*) FILTER (NOT bad AND trade_count > 1) AS volume_available, min(day) FILTER (NOT bad) AS first_day, max(day) FILTER (NOT bad) AS last_day,
  sha256('Date,Open,High,Low,Close,Volume' || chr(10) || string_agg(line, '' ORDER BY day)) AS sha256, CASE WHEN instrument_id IN ('1-URGENT', '5-LOW') THEN 'REJECTED' WHEN count(*) FILTER (bad) > 0 THEN 'ACCEPTED_WITH_EXCLUSIONS' ELSE 'ACCEPTED' END AS status FROM l GROUP BY 1""",
    "source_choices": """WITH r AS (SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0 AS live, c_custkey % 5 <> 0 AS corpus FROM customer)
SELECT c_custkey, CASE WHEN live THEN 'LIVE' WHEN corpus THEN 'CORPUS' ELSE 'NONE' END AS source, CASE WHEN live THEN 'OK' WHEN corpus THEN 'STALE_DATA' ELSE 'UNAVAILABLE' END AS status FROM r""",
    "request_problems": "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'DUPLICATE_TIMEFRAME' WHEN c_custkey % 11 = 0 THEN 'UNSUPPORTED_TIMEFRAME' WHEN c_custkey % 13 = 0 THEN 'OVERRIDES_NOT_ALLOWED' WHEN c_custkey % 17 = 0 THEN 'PREVIEW_NOT_ALLOWED' ELSE 'SERVED' END AS problem, count(*) AS requests FROM customer GROUP BY 1",
    "profile_readiness": """SELECT n_name AS instrument_id, unnest(['D1', 'W1']) AS timeframe, CASE WHEN n_nationkey % 5 = 0 THEN 'PROFILE_MISSING' WHEN n_nationkey % 7 = 3 OR n_nationkey % 4 = 1 THEN 'PROFILE_INVALID'
  WHEN n_nationkey % 6 = 2 THEN 'CORPUS_MISSING' WHEN n_nationkey % 3 = 0 THEN 'CORPUS_REJECTED' ELSE 'READY' END AS readiness FROM nation""",
    "weekly_once": WEEKLY_ONCE,
    "scalar_fields": "WITH k AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -3.0 WHEN 2 THEN 7.5 ELSE try_cast(props->>'$.k' AS DOUBLE) END AS x FROM events) SELECT event_id, CAST(x AS DOUBLE) AS number, CAST(CASE WHEN x >= 0 THEN x END AS DOUBLE) AS amount FROM k",
    "day_texts": f"SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1) * {Q.DAY} AS day_end_ns, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE o_orderkey % 4 WHEN 0 THEN 'D1' WHEN 1 THEN 'W1' WHEN 2 THEN 'H4' END AS timeframe FROM orders",
    "canonical_digests": """SELECT n_nationkey, 'sha256:' || sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation""",
    "signal_responses": f"""WITH {Q.ORDER_BARS.replace('bars AS', 'a AS', 1)}, {Q.bars('b', 'event_type', 'epoch_ns(ts)', 'value', 'event_id', 'events', 'D1', 86_400, 'events', '1')}, u AS (SELECT instrument_id, close_time_ns FROM a UNION ALL SELECT instrument_id, close_time_ns FROM b),
g AS (SELECT instrument_id, count(*) AS bars, max(close_time_ns) AS watermark_ns, CASE WHEN count(*) < 60 THEN 'INSUFFICIENT_DATA' ELSE 'STALE_DATA' END AS status FROM u GROUP BY 1), d AS (SELECT *, '{{"bars":' || bars || ',"instrument":"' || instrument_id || '","status":"' || status || '"}}' AS document FROM g)
SELECT instrument_id, status, watermark_ns, document, 'sha256:' || sha256(document) AS response_sha256 FROM d""",
}
