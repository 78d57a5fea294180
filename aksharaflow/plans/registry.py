"""Registers queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.devanagari import Rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_rules(expr: str, rules: Rules) -> str:
    """The same ordered rules as nested SQL calls."""
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return expr


def sql_keys(expr: str, keys: dict[str, str]) -> str:
    names, values = (", ".join(map(quoted, x)) for x in (keys.keys(), keys.values()))
    return f"array_to_string(list_transform(string_split({expr}, ''), lambda c: coalesce(map([{names}], [{values}])[c], c)), '')"
