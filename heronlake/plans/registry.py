"""Registered queries: a function of (session, folder), and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Cases: small literal inputs with the rows that they give. They are tested as queries are, and aren't registered.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASES_SQL: dict[str, str] = {}


def case(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        CASES[f.__name__], CASES_SQL[f.__name__] = f, sql
        return f

    return add


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: DuckDB pieces that several queries share.
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_''-]*'), lambda x: lower(x))"
WORDS = r"list_filter(regexp_split_to_array({0}, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+'), lambda x: x <> '')"
