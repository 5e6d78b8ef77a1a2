"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

    python -m tests.oracle [sf] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when both sides have the same columns, types and rows."""
    names = sorted(df.columns)
    spark_rows = df.select(*[f"`{n}`" for n in names]).collect()
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} and {sorted(relation.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN"}
    for field in df.schema.fields:
        want = same.get(field.dataType.simpleString())
        if want and types[field.name] != want:
            return f"type of {field.name}: {want} and {types[field.name]}"
    quoted = ", ".join(f'"{n}"' for n in names)
    sql_rows = relation.project(quoted).fetchall()
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    for a, b in zip(_sorted(spark_rows), _sorted(sql_rows)):
        if a != b:
            return f"{names}: {str(a)[:400]} and {str(b)[:400]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from layerlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.perf_counter()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = differences(df, con, oracles[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "rows" if name not in oracles else "equal"
        print(f"{name}: {problem or kind} ({time.perf_counter() - started:.1f} s)", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
