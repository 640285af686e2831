"""Query registry and the inputs that queries derive from the given tables.

An input is a SELECT in the common subset of Spark SQL and DuckDB SQL. The
same text feeds the Spark query (as a view over the Parquet scans) and the
SQL twin (as a common table expression), so both sides start from equal rows.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

INPUTS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Inputs whose queries do long text work per row, with the megabytes of input files a task gets; whole texts stay in their splits.
HEAVY = {"urls": 4, "receipts": 4, "docs": None, "records": 4}

_REF = re.compile(r"\{([a-z][a-z0-9_]*)\}")


def define_input(name: str, sql: str) -> None:
    INPUTS[name] = sql


class Data:
    """Access to the tables and derived inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        rows = self.sql(INPUTS[name])
        return spread(rows, task_mb=HEAVY[name]) if name in HEAVY else rows

    def sql(self, text: str) -> DataFrame:
        refs = {r: getattr(self, r) for r in dict.fromkeys(_REF.findall(text))}
        return self.spark.sql(text, **refs) if refs else self.spark.sql(text)


def _twin(text: str) -> str:
    """Prepend the derived inputs a SQL twin refers to, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for ref in _REF.findall(INPUTS[name]):
            visit(ref)
        order.append(name)

    for ref in _REF.findall(text):
        visit(ref)
    body = _REF.sub(r"\1", text)
    ctes = [f"{n} AS MATERIALIZED ({_REF.sub(chr(92) + '1', INPUTS[n])})" for n in order]
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {', '.join(ctes)}, {stripped[14:]}"
    if stripped[:4].upper() == "WITH":
        return f"WITH {', '.join(ctes)}, {stripped[4:]}"
    return f"WITH {', '.join(ctes)} {body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = _twin(sql)
        return fn

    return add


def sql_array(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
