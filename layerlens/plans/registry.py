"""The named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

Run = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of additions does not show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in doubles})


def rounded_sql(sql: str, doubles: list[str]) -> str:
    replaced = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})" if doubles else sql


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Registers a query; `doubles` names the result columns rounded on both sides."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"Query {name} is there already")
        text = rounded_sql(sql, doubles.split()) if sql is not None else None
        QUERIES[name] = Query(name, lambda spark, sf: rounded(run(spark, sf)), text)
        return run

    return register
