"""Result tables: appending rows, joining tables with differing columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_results(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Adds result rows; the table is made when it is not there yet."""
    df.write.mode("append").format(fmt).save(folder)


def union_results(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose hyperparameter columns differ; what is absent is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of result files with differing columns, as one table."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def spread_params(df: DataFrame, names: list[str]) -> DataFrame:
    """Hyperparameters as columns of their own."""
    return df.select("*", *[F.col("params")[n].alias(n) for n in names]).drop("params")


def write_evaluation(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """The evaluation tables, one sub-folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
