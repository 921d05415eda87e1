"""Instruments and their aliases; scalar helpers on classes and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The instruments that queries may name, each with its aliases.
INSTRUMENTS = {
    "crypto:binance:BTCUSDT": ["BTC", "BTCUSDT"],
    "crypto:binance:XRPUSDT": ["XRP", "XRPUSDT"],
    "stock:massive:AAPL": ["AAPL"],
    "stock:massive:MSFT": ["MSFT"],
    "index:massive:SPX": ["SPX", "SP500", "S&P500"],
    "index:massive:NDX": ["NDX", "NASDAQ"],
    "forex:massive:EURUSD": ["EURUSD", "EUR/USD"],
    "futures:massive:GC": ["GC", "GOLD"],
    "crypto:binance:ETHUSDT": ["ETH", "ETHUSDT"],
    "crypto:binance:SOLUSDT": ["SOL", "SOLUSDT"],
}


def normalized(name: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def instruments(spark: SparkSession, entries: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in (entries or INSTRUMENTS).items()], "instrument_id string, aliases array<string>")


def resolve(names: DataFrame, catalogue: DataFrame, column: str = "name") -> DataFrame:
    """Each different name with FOUND, AMBIGUOUS or UNSUPPORTED and the matching ids in order."""
    aliases = catalogue.select("instrument_id", F.explode("aliases").alias("alias")).select("instrument_id", normalized(F.col("alias")).alias("key")).distinct()
    asked = names.select(F.col(column).alias("name")).distinct().withColumn("key", normalized(F.col("name")))
    met = asked.join(aliases, "key", "left").groupBy("name").agg(F.sort_array(F.collect_set("instrument_id")).alias("ids"))
    n = F.size("ids")
    return met.select("name", F.when(n == 0, "UNSUPPORTED").when(n == 1, "FOUND").otherwise("AMBIGUOUS").alias("status"), F.array_join("ids", ",").alias("instrument_ids"))


def class_index(direction: Column) -> Column:
    """UP 0, RANGE and UNRESOLVED 1, DOWN 2."""
    return F.when(direction == "UP", 0).when(direction == "DOWN", 2).otherwise(1)


def day_text(ns: Column) -> Column:
    """The UTC day of nanoseconds since 1970, as text."""
    return F.date_from_unix_date(F.floor(ns / 86_400_000_000_000).cast("int")).cast("string")


def day_end_ns(day: Column) -> Column:
    """Exclusive end of a day."""
    return (F.unix_date(day).cast("long") + 1) * 86_400_000_000_000


def timeframe_of(text: Column) -> Column:
    """A timeframe's name in any case, else null."""
    up = F.upper(F.trim(text))
    return F.when(up.isin("M1", "M5", "H1", "H4", "D1", "W1"), up)
