"""Bars from CSV files and from captured JSON replies; sinks for documents.

Nothing here goes to a network: replies are strings in a column, read by Spark's own parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bars import NS

DAY_NS = 86_400 * NS
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")


def parse_date(text: Column) -> Column:
    """A date in the first of three formats that fits, else null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in DATE_FORMATS])


def finite(text: Column) -> Column:
    """A double from a number or a numeric string; null for blank, malformed, NaN and infinite."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def required(value: Column, name: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"{name} is missing or not a finite number")).cast("double")).otherwise(value)


def optional(value: Column) -> Column:
    """A finite number of at least 0, or null (not available)."""
    return F.when(finite(value) >= 0, finite(value))


def read_daily_csv(spark: SparkSession, path: str, instrument_id: str | Column, source: str, zero_volume_is_missing: bool = True, drop_malformed: bool = False) -> DataFrame:
    """Closed D1 bars from CSV files with a header in any order and case.

    The date is the first column, by place, named date, timestamp or time; volume (or vol) is
    optional. A missing column, a date in no known format or a price that is no finite number raises,
    and so do a bar that breaks ``low <= open, close <= high`` (unless ``drop_malformed``) and a day that
    does not come after the one on the line before it. ``instrument_id`` may be a column of a folder's
    partitions; a series' files are read in the order of their paths, and all have the header of the first.
    """
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    place: dict[str, str] = {}
    for c in raw.columns:
        place.setdefault(c.strip().lower(), c)
    date = next((c for c in raw.columns if c.strip().lower() in ("date", "timestamp", "time")), None)
    lacking = [n for n in ("open", "high", "low", "close") if n not in place] + ([] if date else ["date"])
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    volume = next((place[n] for n in ("volume", "vol") if n in place), None)
    price = lambda n: required(finite(F.col(f"`{place[n]}`")), n).alias(n)
    amount = optional(F.col(f"`{volume}`")) if volume else F.lit(None).cast("double")
    if zero_volume_is_missing:
        amount = F.when(amount > 0, amount)
    day = parse_date(F.col(f"`{date}`"))
    day = F.when(day.isNull(), F.raise_error(F.lit("a date is in no known format")).cast("date")).otherwise(day)
    named = (instrument_id if isinstance(instrument_id, Column) else F.lit(instrument_id)).cast("string").alias("instrument_id")
    place_in = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    rows = raw.select(named, *place_in, (F.unix_date(day).cast("long") * DAY_NS).alias("open_time_ns"), price("open"), price("high"), price("low"), price("close"), amount.alias("volume"))
    bars = rows.select("file", "block", "line", "instrument_id", F.lit("D1").alias("timeframe"), "open_time_ns", (F.col("open_time_ns") + DAY_NS).alias("close_time_ns"), "open", "high", "low", "close", F.lit(True).alias("is_closed"), F.lit(source).alias("source"), "volume", F.lit(None).cast("double").alias("quote_volume"), F.lit(None).cast("long").alias("trade_count"))
    sound = F.expr("low <= high AND high >= greatest(open, close) AND low <= least(open, close)")
    bars = bars.where(sound) if drop_malformed else bars.withColumn("low", F.when(sound, F.col("low")).otherwise(F.raise_error(F.lit("a malformed bar"))))
    before = F.lag("open_time_ns").over(Window.partitionBy("instrument_id").orderBy("file", "block", "line"))
    later = F.coalesce(F.col("open_time_ns") > before, F.lit(True))
    return bars.withColumn("open_time_ns", F.when(later, F.col("open_time_ns")).otherwise(F.raise_error(F.lit("days are repeated or go back")).cast("long"))).drop("file", "block", "line")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of whole files, with the columns of a folder's partitions."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), *[c for c in files.columns if c not in ("path", "modificationTime", "length", "content")])


def audit_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Audit of the daily CSV files below ``path``, one for each partition of file (``file=...``): ``rows`` of all
    lines, ``valid_rows``, ``malformed`` ones, first and last valid day, days with a volume, the digest of the
    whole file and its status by ``manifest``; a file that isn't there, or has no valid row, is rejected."""
    name = F.col("file").cast("string")
    lines = spark.read.csv(path, header=True).groupBy(name.alias("file")).agg(F.count("*").alias("rows"))
    day = lambda c: F.date_from_unix_date(F.expr(f"CAST({c}(open_time_ns) DIV {DAY_NS} AS INT)")).cast("string")
    sound = read_daily_csv(spark, path, F.col("file"), "file", drop_malformed=True).groupBy(F.col("instrument_id").alias("file")).agg(F.count("*").alias("valid_rows"), F.count("volume").alias("volume_available"), day("min").alias("first_day"), day("max").alias("last_day"))
    digests = file_digests(spark, path).select(name.alias("file"), "sha256")
    found = lines.join(digests, "file").join(sound, "file", "left").withColumn("malformed", F.col("rows") - F.coalesce("valid_rows", F.lit(0)))
    return audit_status(found, manifest)


def audit_status(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each file of the manifest against what was found: rows, first and last day, digest."""
    m = manifest.select("file", *[F.col(c).alias(f"want_{c}") for c in ("rows", "first_day", "last_day", "sha256")])
    both = m.join(found, "file", "left")
    same = F.lit(True)
    for c in ("rows", "first_day", "last_day", "sha256"):
        same = same & F.col(c).eqNullSafe(F.col(f"want_{c}"))
    return both.withColumn("status", F.when(~same, "REJECTED").when(F.coalesce(F.col("malformed"), F.lit(0)) > 0, "ACCEPTED_WITH_EXCLUSIONS").otherwise("ACCEPTED"))


def klines(replies: DataFrame, as_of_ms: Column, timeframe: str, source: str) -> DataFrame:
    """Closed bars from replies (instrument_id, reply) that are arrays of arrays of nine or more fields:
    open ms, open, high, low, close, volume, close ms, quote volume, trades. Numbers may be strings.
    Bars that close at or after ``as_of_ms`` are not closed and go."""
    rows = replies.select("instrument_id", F.explode(F.from_json("reply", "array<array<string>>")).alias("k"))
    at = lambda i: F.get("k", F.lit(i))
    price = lambda i, n: required(finite(at(i)), n).alias(n)
    closed = rows.where(at(6).try_cast("long") < as_of_ms)
    return closed.select("instrument_id", F.lit(timeframe).alias("timeframe"), (at(0).cast("long") * 1_000_000).alias("open_time_ns"), (at(6).cast("long") * 1_000_000).alias("close_time_ns"), price(1, "open"), price(2, "high"), price(3, "low"), price(4, "close"), F.lit(True).alias("is_closed"), F.lit(source).alias("source"), optional(at(5)).alias("volume"), optional(at(7)).alias("quote_volume"), at(8).cast("long").alias("trade_count"))


def aggregates(replies: DataFrame, source: str) -> DataFrame:
    """Closed D1 bars from replies {status, results: [{t, o, h, l, c, v, n}]}; another status raises.
    A bar closes one nanosecond before the next day. A negative volume is not available."""
    shape = "status string, results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, n: bigint>>"
    read = replies.select("instrument_id", F.from_json("reply", shape).alias("r"))
    status = F.when(F.col("r.status").eqNullSafe("OK"), F.col("r.results")).otherwise(F.raise_error(F.concat(F.lit("reply status "), F.coalesce("r.status", F.lit("missing")))).cast("array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, n: bigint>>"))
    rows = read.select("instrument_id", F.explode(status).alias("b"))
    return rows.select("instrument_id", F.lit("D1").alias("timeframe"), (F.col("b.t") * 1_000_000).alias("open_time_ns"), (F.col("b.t") * 1_000_000 + DAY_NS - 1).alias("close_time_ns"), *[required(F.col(f"b.{k}"), n).alias(n) for k, n in zip("ohlc", ("open", "high", "low", "close"), strict=True)], F.lit(True).alias("is_closed"), F.lit(source).alias("source"), F.when(F.col("b.v") >= 0, F.col("b.v")).alias("volume"), F.lit(None).cast("double").alias("quote_volume"), F.col("b.n").alias("trade_count"))


def nearest_contract(contracts: DataFrame, group: list[str]) -> DataFrame:
    """The contract to read for each group (columns ticker, days): the least (days, ticker) with 20
    days or more left, else the least that has not ended."""
    far = F.min(F.when(F.col("days") >= 20, F.struct("days", "ticker")))
    near = F.min(F.when(F.col("days") >= 0, F.struct("days", "ticker")))
    return contracts.groupBy(*group).agg(F.coalesce(far, near).alias("c")).select(*group, F.col("c.ticker").alias("ticker"), F.col("c.days").alias("days"))


def session_bars(replies: DataFrame, today_day: Column, source: str) -> DataFrame:
    """Closed D1 bars from futures replies {results: [{session_end_date, open, high, low, close,
    volume}]}: sessions that ended before today; the close is the last nanosecond of the day."""
    shape = "results array<struct<session_end_date: string, open: double, high: double, low: double, close: double, volume: double>>"
    rows = replies.select("instrument_id", F.explode(F.from_json("reply", shape)["results"]).alias("b")).withColumn("day", F.unix_date(parse_date(F.col("b.session_end_date"))).cast("long"))
    return rows.where(F.col("day") < today_day).select("instrument_id", F.lit("D1").alias("timeframe"), (F.col("day") * DAY_NS).alias("open_time_ns"), ((F.col("day") + 1) * DAY_NS - 1).alias("close_time_ns"), *[required(F.col(f"b.{n}"), n).alias(n) for n in ("open", "high", "low", "close")], F.lit(True).alias("is_closed"), F.lit(source).alias("source"), F.when(F.col("b.volume") >= 0, F.col("b.volume")).alias("volume"))


KERNEL_INPUT = T.StructType([T.StructField("timestamp_ns", T.LongType(), False), T.StructField("omega", T.DoubleType(), False), T.StructField("expected", T.DoubleType()), T.StructField("u_lambda", T.DoubleType()), T.StructField("sigma_op", T.BooleanType())])


def read_kernel_csv(spark: SparkSession, path: str) -> DataFrame:
    """Kernel replay input; blank controls are null (not applicable)."""
    return spark.read.csv(path, header=True, schema=KERNEL_INPUT, mode="FAILFAST")


def write_documents(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON document a line; ``append`` makes a growing log."""
    df.write.mode(mode).json(path)


def chosen_source(requested: Column, live_ready: Column, corpus_ready: Column) -> Column:
    """A struct of source and status: live where asked for and ready, else the corpus, marked stale. A null
    flag is not ready."""
    live = (requested != "SUPPLIED_CORPUS") & F.coalesce(live_ready, F.lit(False))
    corpus = F.coalesce(corpus_ready, F.lit(False))
    pick = lambda a, b, c: F.when(live, a).when(corpus, b).otherwise(c)
    return F.struct(pick("LIVE", "CORPUS", "NONE").alias("source"), pick("OK", "STALE_DATA", "UNAVAILABLE").alias("status"))
