"""Canonical JSON (RFC 8785) and digests of documents."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float | int) -> str:
    """ECMAScript's shortest form of a double."""
    if isinstance(x, int) and abs(x) < 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("no JSON number for NaN or infinity")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exponent
    if 0 < point <= 21:
        out = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        e = point - 1
        out = (text if len(text) == 1 else f"{text[0]}.{text[1:]}") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * sign + out


def canonical(value: object) -> str:
    """Keys in the order of their UTF-16 code units, no white space."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int | float):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list | tuple):
        return f"[{','.join(map(canonical, value))}]"
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"


def digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def digest_of_json(document: Column) -> Column:
    """Digest of each JSON document's canonical form; a null has none."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else digest(json.loads(t)))

    return run(document)
