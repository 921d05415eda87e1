"""Profiles as content-addressed documents: canonical form, self-hash and checks, all in JVM expressions.

A profile is a row of named fields with ``profile_sha256``, the SHA-256 of the canonical JSON (RFC 8785) of
the others. Every rule is a row of ``checks``, so that a profile that breaks several says so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH = "profile_sha256"
VERSION = "resolution_v1"
ENGINE = "1.0.0"
#: First part of an instrument's name for each asset class.
ASSETS = {"crypto": "CRYPTO", "stock": "STOCK", "index": "INDEX", "forex": "FOREX", "futures": "FUTURES", "commodity": "COMMODITY"}

#: What JSON has short escapes for.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _text(x: Column) -> Column:
    escapes = SHORT | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in SHORT}
    escaped = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), escapes.items(), x)  # the backslash comes first
    return F.concat(F.lit('"'), F.when(x.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(x), F.lit('"'))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _double(x: Column) -> Column:
    """ECMAScript's shortest form of a double. Subnormal numbers have the digits that Java gives them."""

    def shortest(size: Column) -> Column:
        tries = [F.format_string(f"%.{places}e", size) for places in (14, 15, 16)]  # 17 digits always give the number back
        return F.coalesce(*[F.when(t.cast("double") == size, t) for t in tries[:2]], tries[2])

    def written(s: Column) -> Column:
        digits = F.rtrim(F.replace(F.substring_index(s, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        return _let(F.struct(digits.alias("d"), (F.substring_index(s, "e", -1).cast("int") + 1).alias("p")), placed)

    def placed(v: Column) -> Column:
        digits, point = v["d"], v["p"]  # the point is behind so many digits
        n, e = F.length(digits), point - 1
        scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), F.when(e > 0, "+").otherwise("-"), F.abs(e).cast("string"))
        plain = F.when(n <= point, F.rpad(digits, F.greatest(point, F.lit(1)), F.lit("0"))).otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)
        return F.when((point > 0) & (point <= 21), plain).when((point <= 0) & (point > -6), small).otherwise(scientific)

    sound = ~F.isnan(x) & (F.abs(x) != float("inf"))
    text = _let(_let(F.abs(x), shortest), written)
    return F.when(~sound, F.raise_error(F.lit("no JSON number for NaN or infinity")).cast("string")).when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def canonical(x: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of any nesting of structs, arrays, texts, booleans and numbers."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        parts = [F.concat(_text(F.lit(f.name)), F.lit(":"), canonical(x[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        out = _text(x)
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = x.cast("string")
        if isinstance(kind, T.LongType):  # beyond 2^53 a JSON number is a double
            out = F.when(F.abs(x) < (1 << 53), out).otherwise(_double(x.cast("double")))
    elif isinstance(kind, T.DoubleType | T.FloatType):
        out = _double(x.cast("double"))
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.coalesce(F.when(x.isNotNull(), out), F.lit("null"))


def digest(df: DataFrame, fields: list[str]) -> Column:
    """sha256: and the SHA-256 of the canonical document of ``fields``."""
    kind = T.StructType([df.schema[f] for f in fields])
    return F.concat(F.lit("sha256:"), F.sha2(canonical(F.struct(*fields), kind), 256))


def signed(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``profile_sha256``."""
    return profiles.withColumn(HASH, digest(profiles, [c for c in profiles.columns if c != HASH]))


def profile_id() -> Column:
    return F.concat_ws(":", "instrument_id", "timeframe", F.lit(VERSION))


def checks(profiles: DataFrame, boundary_ns: int, engine: str = ENGINE) -> DataFrame:
    """profile_id, profile_sha256, check and passed: a row for each profile and rule. A missing value fails
    its rule.

    ``profiles`` has profile_id, version, engine_version, instrument_id, asset_class, timeframe, k,
    least_support, most, power, barrier_up, barrier_down, dimensions, effective (booleans), samples, last_ns,
    untouched_test, split_ns and profile_sha256. ``boundary_ns`` is when forecasts were registered.
    """
    c, own = F.col, [x for x in profiles.columns if x != HASH]
    asset = F.create_map(*[F.lit(x) for pair in ASSETS.items() for x in pair])
    finite = lambda x: (c(x) > 0) & ~F.isnan(x) & (c(x) < float("inf"))
    rules = {
        "VERSION": c("version") == VERSION,
        "ENGINE": c("engine_version") == engine,
        "IDENTITY": c("profile_id") == profile_id(),
        "ASSET_CLASS": F.try_element_at(asset, F.substring_index("instrument_id", ":", 1)) == c("asset_class"),
        "SAMPLES": c("samples") > 0,
        "SUPPORT": (c("least_support") > 0) & (c("k") >= c("least_support")),
        "DISTANCE": finite("most"),
        "POWER": finite("power"),
        "SYMMETRIC_BARRIER": finite("barrier_up") & (c("barrier_up") == c("barrier_down")),
        "DIMENSIONS": (c("dimensions") > 0) & (F.size("effective") == c("dimensions")) & F.exists("effective", lambda x: x),
        "PROSPECTIVE_TEST": ~c("untouched_test") | ((c("split_ns") > boundary_ns) & (c("last_ns") <= boundary_ns)),
        "HASH": c(HASH) == digest(profiles, own),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(rule, F.lit(False)).alias("passed")) for name, rule in rules.items()])
    return profiles.select("profile_id", HASH, F.explode(rows).alias("r")).select("profile_id", HASH, "r.check", "r.passed")
