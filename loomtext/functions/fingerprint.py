"""Fingerprints of rule files: what can't change a result doesn't change them."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_DIGITS = 16


def _number(x: float) -> str:
    """A number as the shortest text that gives the same double; a power of ten only from 10^21 and below 10^-6."""
    if x in (float("inf"), float("-inf")):
        return "null"
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        text = format(Decimal(repr(abs(x))), "f").removesuffix(".0")
        return f"-{text}" if x < 0 else text
    digits, _, power = repr(x).partition("e")
    return f"{digits}e{int(power):+d}"


def _place(key: str) -> tuple:
    """Keys that are list indexes come first, by size; the others by their UTF-16 units."""
    index = key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < 2**32 - 1
    return (0, int(key), b"") if index else (1, 0, key.encode("utf-16-be", "surrogatepass"))


def canonical(value: object) -> str:
    """JSON without white space, keys in a fixed order, keys that begin with an underscore left out at every depth."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=_place) if not k.startswith("_")) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _refuse(name: str) -> None:
    raise ValueError(name)


def _one(text: str | None) -> tuple[str | None, str | None]:
    if text is None:
        return None, "null"
    try:
        plain = canonical(json.loads(text, parse_int=float, parse_constant=_refuse))
        return "sha256:" + hashlib.sha256(plain.encode("utf-8")).hexdigest()[:_DIGITS], None
    except (ValueError, RecursionError):
        return None, "invalid JSON"


@F.pandas_udf(StructType([StructField("fingerprint", StringType()), StructField("error", StringType())]))
def _fingerprints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_one(t) for t in texts], columns=["fingerprint", "error"])


def fingerprint(text: Column) -> Column:
    """A struct (fingerprint, error): a hash of the canonical form of JSON. Null and broken texts have an error instead."""
    return _fingerprints(text)


def combined(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, combined, n) over files (by, name, fingerprint): a hash of `name:fingerprint` lines in order of name, whatever
    order they come in. Files without a fingerprint don't count. A group is one set of rule files and is sorted as such."""
    lines = F.array_sort(F.collect_list(F.when(F.col("fingerprint").isNotNull(), F.struct("name", "fingerprint"))))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x["name"], F.lit(":"), x["fingerprint"])), "\n")
    hashed = F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, _DIGITS))
    return files.groupBy(*by).agg(hashed.alias("combined"), F.count("fingerprint").alias("n"))
