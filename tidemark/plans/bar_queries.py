"""Queries on bars: building, checking and resampling them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resample, validation
from ..sources import bars as B
from ..streaming import bars as streamed
from . import sql as Q

BAR_COLUMNS = ["instrument_id", "timeframe", "open_time_ns", "close_time_ns", "open", "high", "low", "close", "volume", "trade_count"]


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_bars(spark, sf_dir).select(BAR_COLUMNS)


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_bars(spark, sf_dir).select(BAR_COLUMNS)


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lineitem_bars(spark, sf_dir).select(BAR_COLUMNS)


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: the hourly bars that are closed once the newest event is an hour past them."""
    schema = B.read(spark, sf_dir, "events").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    closed = streamed.closed_bars(ticks, "event_type", "ts", F.col("value"), F.col("event_id"), "H1", "events", F.lit(1.0))
    return streamed.until_now(spark, closed, "streamed").select(BAR_COLUMNS)


def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as malformed bars: what each row breaks first."""
    rows = B.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("instrument_id"), F.lit("lineitem").alias("source"), F.lit(0).cast("long").alias("open_time_ns"), F.col("l_linenumber").cast("long").alias("close_time_ns"), F.col("l_quantity").alias("open"), (F.col("l_quantity") + 20).alias("high"), (F.col("l_quantity") - 100 * F.col("l_tax")).alias("low"), (F.col("l_quantity") + 600 * F.col("l_discount") - 30).alias("close"), F.lit(1.0).alias("volume"), F.lit(None).cast("double").alias("quote_volume"), (F.col("l_linenumber") - 2).cast("long").alias("trade_count"))
    return rows.groupBy(F.coalesce(validation.bar_violation(), F.lit("VALID")).alias("violation")).agg(F.count("*").alias("bars"))


def cadence_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.cadence_anomalies(B.order_bars(spark, sf_dir), 1, 1)


def series_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.series_status(B.event_bars(spark, sf_dir, "D1").unionByName(B.lineitem_bars(spark, sf_dir)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.observations(B.order_bars(spark, sf_dir))
    return found.select("instrument_id", "timeframe", "timestamp_ns", F.round("omega", 8).alias("omega"), F.round(F.nanvl("expected", F.lit(None).cast("double")), 8).alias("expected"))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.weekly(B.lineitem_bars(spark, sf_dir)).select("instrument_id", "timeframe", "open_time_ns", "close_time_ns", "open", "high", "low", "close", "volume", "days")


def _resampled(frm: str, to: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return resample.resample(B.event_bars(spark, sf_dir, frm), frm, to).select(BAR_COLUMNS)

    return query


def h4_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.by_clock(B.event_bars(spark, sf_dir, "H1"), "H4", B.SECONDS["H4"])


def admitted_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's wished frames (made up from its key) against what is served."""
    key = F.col("c_custkey")
    wished = F.filter(F.array(F.when(key % 2 == 0, "W1"), F.when(key % 3 == 0, "H1"), F.when(key % 5 == 0, "D1")), lambda x: x.isNotNull())
    return B.read(spark, sf_dir, "customer").select("c_custkey", F.array_join(validation.admitted_timeframes(wished, F.array(F.lit("D1"), F.lit("W1"))), ",").alias("timeframes"))


def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per instrument: rows, first and last day, cadence anomalies, volume and malformed counts."""
    bars = B.lineitem_bars(spark, sf_dir)
    counts = bars.groupBy("instrument_id").agg(F.count("*").alias("rows"), F.min(F.expr("date_from_unix_date(CAST(open_time_ns DIV 86400000000000 AS INT))")).cast("string").alias("first_day"), F.max(F.expr("date_from_unix_date(CAST(open_time_ns DIV 86400000000000 AS INT))")).cast("string").alias("last_day"), F.count("volume").alias("volume_available"), F.count_if(validation.bar_violation() == "MALFORMED_OHLC").alias("malformed"))
    gaps = validation.cadence_anomalies(bars, 1, 4).groupBy("instrument_id").agg(F.count("*").alias("gaps"))
    audit = counts.join(gaps, "instrument_id", "left").withColumn("cadence_anomalies", F.coalesce("gaps", F.lit(0)).cast("long")).drop("gaps")
    return audit.withColumn("status", F.when(F.col("malformed") > 0, "ACCEPTED_WITH_EXCLUSIONS").otherwise("ACCEPTED"))


QUERIES = {
    "bars_orders": bars_orders,
    "bars_events": bars_events,
    "streamed_bars": streamed_bars,
    "bars_lineitem": bars_lineitem,
    "bar_violations": bar_violations,
    "cadence_anomalies": cadence_anomalies,
    "series_status": series_status,
    "observations": observations,
    "weekly_bars": weekly_bars,
    "m5_from_m1": _resampled("M1", "M5"),
    "h1_from_m1": _resampled("M1", "H1"),
    "h1_from_m5": _resampled("M5", "H1"),
    "h4_from_h1": _resampled("H1", "H4"),
    "h4_by_clock": h4_by_clock,
    "admitted_timeframes": admitted_timeframes,
    "corpus_audit": corpus_audit,
}

_SELECT = f"SELECT {', '.join(BAR_COLUMNS)} FROM bars"
WEEK = 7 * Q.DAY


def _count_sql(base: str, size: int, to: str) -> str:
    return f"""WITH {base},
n AS (SELECT *, (row_number() OVER (PARTITION BY instrument_id ORDER BY open_time_ns) - 1) // {size} AS bucket FROM bars)
SELECT instrument_id, '{to}' AS timeframe, min(open_time_ns) AS open_time_ns, max(close_time_ns) AS close_time_ns,
  arg_min(open, open_time_ns) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ns) AS close,
  CASE WHEN count(volume) = count(*) THEN sum(volume) END AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count
FROM n GROUP BY instrument_id, bucket HAVING count(*) = {size}"""


ORACLE = {
    "bars_orders": f"WITH {Q.ORDER_BARS} {_SELECT}",
    "bars_events": f"WITH {Q.EVENT_BARS} {_SELECT}",
    "streamed_bars": f"WITH {Q.EVENT_BARS} {_SELECT} WHERE close_time_ns <= (SELECT max(epoch_ns(ts)) FROM events WHERE value IS NOT NULL) - {Q.HOUR}",
    "bars_lineitem": f"WITH {Q.LINE_BARS} {_SELECT}",
    "bar_violations": """SELECT violation, count(*) AS bars FROM (SELECT CASE
  WHEN trim(coalesce(l_returnflag, '')) = '' THEN 'MISSING_IDENTITY'
  WHEN l_linenumber <= 0 THEN 'INVALID_TIME'
  WHEN NOT (l <= h AND h >= greatest(o, c) AND l <= least(o, c)) THEN 'MALFORMED_OHLC'
  WHEN l_linenumber - 2 < 0 THEN 'NEGATIVE_VOLUME' ELSE 'VALID' END AS violation
  FROM (SELECT *, l_quantity AS o, l_quantity + 20 AS h, l_quantity - 100 * l_tax AS l, l_quantity + 600 * l_discount - 30 AS c FROM lineitem)) GROUP BY violation""",
    "cadence_anomalies": f"""WITH {Q.ORDER_BARS}, g AS (SELECT {Q.SERIES}, open_time_ns, lag(open_time_ns) OVER (PARTITION BY {Q.SERIES} ORDER BY open_time_ns) AS previous_open_ns FROM bars)
SELECT *, open_time_ns - previous_open_ns AS gap_ns FROM g WHERE open_time_ns - previous_open_ns <> {Q.DAY}""",
    "series_status": f"""WITH {Q.LINE_BARS.replace('bars AS', 'a AS', 1)}, {Q.bars('b', 'event_type', 'epoch_ns(ts)', 'value', 'event_id', 'events', 'D1', 86_400, 'events', '1')},
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT instrument_id, timeframe, count(*) AS bars, CASE WHEN NOT bool_and(high > 0 AND low > 0 AND close > 0) THEN 'INVALID_PRICE' WHEN count(*) < 60 THEN 'INSUFFICIENT_BARS' ELSE 'OK' END AS status FROM u GROUP BY ALL""",
    "observations": f"""WITH {Q.ORDER_BARS}, o AS (SELECT {Q.SERIES}, close_time_ns AS timestamp_ns, (high - low) / lag(close) OVER ({Q.BY}) AS omega FROM bars),
p AS (SELECT * FROM o WHERE omega IS NOT NULL)
SELECT {Q.SERIES}, timestamp_ns, round(omega, 8) AS omega, round(lag(omega) OVER (PARTITION BY {Q.SERIES} ORDER BY timestamp_ns), 8) AS expected FROM p""",
    "weekly_bars": f"""WITH {Q.LINE_BARS}, w AS (SELECT *, epoch_ns(date_trunc('week', make_timestamp_ns(open_time_ns))) AS week_ns FROM bars),
g AS (SELECT instrument_id, week_ns, min(open_time_ns) AS open_time_ns, max(close_time_ns) AS close_time_ns, arg_min(open, open_time_ns) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, open_time_ns) AS close, CASE WHEN count(volume) = count(*) THEN sum(volume) END AS volume, count(*) AS days FROM w GROUP BY 1, 2),
m AS (SELECT *, max(week_ns) OVER (PARTITION BY instrument_id) AS latest FROM g)
SELECT instrument_id, 'W1' AS timeframe, open_time_ns, close_time_ns, open, high, low, close, volume, days FROM m WHERE week_ns < latest OR close_time_ns + 1000000 >= week_ns + {WEEK}""",
    "m5_from_m1": _count_sql(Q.EVENT_M1, 5, "M5"),
    "h1_from_m1": _count_sql(Q.EVENT_M1, 60, "H1"),
    "h1_from_m5": _count_sql(Q.EVENT_M5, 12, "H1"),
    "h4_from_h1": _count_sql(Q.EVENT_BARS, 4, "H4"),
    "h4_by_clock": f"""WITH {Q.EVENT_BARS}, s AS (SELECT *, (open_time_ns // {4 * Q.HOUR}) * {4 * Q.HOUR} AS slot FROM bars)
SELECT instrument_id, 'H4' AS timeframe, slot AS open_time_ns, slot + {4 * Q.HOUR} AS close_time_ns, arg_min(open, open_time_ns) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ns) AS close, count(*) AS parts FROM s GROUP BY instrument_id, slot""",
    "admitted_timeframes": """SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN 'D1,W1'
  ELSE concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'W1' END, CASE WHEN c_custkey % 5 = 0 THEN 'D1' END) END AS timeframes FROM customer""",
    "corpus_audit": f"""WITH {Q.LINE_BARS}, g AS (SELECT *, open_time_ns - lag(open_time_ns) OVER (PARTITION BY instrument_id ORDER BY open_time_ns) AS gap FROM bars)
SELECT instrument_id, count(*) AS rows, CAST(CAST(make_timestamp_ns(min(open_time_ns)) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(make_timestamp_ns(max(open_time_ns)) AS DATE) AS VARCHAR) AS last_day,
  count(volume) AS volume_available, CAST(count(*) FILTER (NOT (low <= high AND high >= greatest(open, close) AND low <= least(open, close))) AS BIGINT) AS malformed,
  CAST(count(*) FILTER (gap < {Q.DAY} OR gap > {4 * Q.DAY}) AS BIGINT) AS cadence_anomalies, 'ACCEPTED' AS status FROM g GROUP BY instrument_id""",
}
