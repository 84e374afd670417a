"""Registered queries and the SQL that they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with DuckDB SQL for its rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """A derived table that both engines read: v(columns)."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns}))"


def over(table_: str, key: str, columns: str, rows: list[tuple], **changed: str) -> str:
    """A derived table that both engines read: each row of a given table with
    one of ``rows`` in turn. ``changed``: what a column becomes, an expression
    of the rows' columns and the table's."""
    names = [c.strip() for c in columns.split(",")]
    picked = ", ".join(f"{changed.get(c, 'v.' + c)} AS {c}" for c in names)
    cases = ", ".join(f"({', '.join(map(literal, (i, *r)))})" for i, r in enumerate(rows))
    return f"(SELECT {picked} FROM {table_} JOIN (SELECT * FROM (VALUES {cases}) AS w(n, {columns})) AS v ON {table_}.{key} % {len(rows)} = v.n)"


def per(table_: str, key: str, id_: str, n: int, columns: str, source: str) -> str:
    """A derived table that both engines read: for each row of a given table
    the rows of ``source`` (columns) with one of ``n`` ids (from 1) in turn,
    under the row's key as the id."""
    picked = ", ".join(f"{table_}.{key} AS {id_}" if c.strip() == id_ else f"v.{c.strip()} AS {c.strip()}" for c in columns.split(","))
    return f"(SELECT {picked} FROM {table_} JOIN {source} v ON v.{id_} = 1 + {table_}.{key} % {n})"


def inline(spark: SparkSession, source: str, sf_dir: str | None = None) -> DataFrame:
    """A derived table; given tables that it names are read from ``sf_dir``."""
    if sf_dir is not None:
        for name in set(re.findall(r"\b(?:FROM|JOIN) (region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|benchmark|conversations)\b", source)):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {source}")
