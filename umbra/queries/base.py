"""Registration, tables, and lines synthesised alike in Spark and DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbra.functions.digests import pads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SALT = b"deterministic-test-salt-do-not-use-in-anger"


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def concat(template: str, values: dict[str, str], spark: bool = False) -> str:
    """A SQL concat of the template's literal pieces and of the expressions that its {names} stand for."""
    pieces = [values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else (f"r{quoted(p)}" if spark and "\\" in p else quoted(p)) for p in re.split(r"(\{\w+\})", template) if p]
    return f"concat({', '.join(pieces)})"


def duck_hmac(kind: str, value: str, salt: bytes = SALT) -> str:
    inner, outer = pads(salt)
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode('{kind}') || from_hex('00') || encode({value}))))"


def duck_tag(kind: str, value: str, digits: int = 6) -> str:
    return f"substr(ltrim({duck_hmac(kind, value)}, '0'), 1, {digits})"
