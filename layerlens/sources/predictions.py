"""Prediction files: one file per layer, pooling and probe, or per prompt type.

The name of a file carries the key. A file `layer_3_mean_naive_bayes.tsv` may also be a
folder of that name holding part files, which is how Spark writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window as W, functions as F

from layerlens.functions.sizing import small_side
from layerlens.session import written
from layerlens.sources.labelled import whole_number

RUN_KEY = ("layer", "pooling", "probe")


def run_file(layer: Column, pooling: Column, probe: Column) -> Column:
    name = F.concat_ws("_", F.lit("layer"), layer, pooling, probe)
    return F.concat(name, F.lit(".tsv"))


def write_predictions(df: DataFrame, folder: str, by=("dataset", "model", *RUN_KEY)) -> None:
    """Puts predictions into a long table with explicit keys; a run written again replaces itself.

    Rebalancing keeps the files few per key and splits a key that holds many rows.
    """
    _replacing(df.hint("rebalance", *by)).partitionBy(*by).parquet(folder)


def _replacing(df: DataFrame) -> DataFrameWriter:
    """Replaces the partitions that the rows are in and leaves the others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def write_run_files(df: DataFrame, folder: str, file: Column) -> None:
    """One tab-separated file (folder) per run, named by `file`, with id and y_pred.

    A run written again replaces its file.
    """
    rows = df.select(file.alias("run"), "id", "y_pred").hint("rebalance", "run")
    _replacing(rows).partitionBy("run").option("sep", "\t").option("header", True).csv(folder)


def file_stem(path: Column) -> Column:
    """`layer_3_mean_knn` from any path to that .tsv file or to a part of it."""
    return F.regexp_extract(path, r"([^/=]+)\.tsv(?:/[^/]*)?$", 1)


def parse_run(stem: Column) -> Column:
    """(layer, pooling, probe) from a file stem; null when it has fewer than four parts.

    The probe's name may hold underscores.
    """
    parts = F.split(stem, "_")
    key = F.struct(
        F.try_element_at(parts, F.lit(2)).try_cast("int").alias("layer"),
        F.try_element_at(parts, F.lit(3)).alias("pooling"),
        F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "_").alias("probe"),
    )
    return F.when(F.size(parts) >= 4, key)


FILES = {"recursiveFileLookup": True, "pathGlobFilter": "*.{tsv,csv}"}


def lines(reader, folder: str) -> DataFrame:
    """Every line of every file but blank ones, header lines too, with where it came from."""
    return reader.options(**FILES).text(folder).where(F.trim("value") != "").select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def cells() -> Column:
    """The cells of a line, without quotes around them."""
    return F.transform(F.split("value", "\t"), lambda x: F.regexp_replace(x, '^"(.*)"$', "$1"))


def prediction_files(rows: DataFrame) -> DataFrame:
    """The files whose header names a `y_pred`: path, at, stem and run key.

    `at` holds the places of `y_pred` and of the id from 0: the column `id`, or else a first
    column without a name or right before `y_pred`. Names are parsed once per file, not per line.
    """
    y_pred, own = (F.array_position("cells", name).cast("int") - 1 for name in ("y_pred", "id"))
    first = (F.element_at("cells", 1) == "") | (y_pred == 1)
    at = F.struct(y_pred.alias("y_pred"), F.when(own >= 0, own).when(first & (y_pred > 0), 0).alias("id"))
    stem = file_stem(F.col("path"))
    headers = rows.withColumn("cells", cells()).filter(F.array_contains("cells", "y_pred"))
    files = headers.groupBy("path").agg(F.min(at).alias("at"))
    return files.withColumn("stem", stem).withColumn("key", parse_run(F.col("stem")))


def parsed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of the given files with `id` (if there) and `y_pred` as numbers.

    Header lines have no `y_pred`; any other line without a whole one is an error.
    """
    found = rows.join(small_side(files), "path").withColumn("cells", cells())
    y_pred = F.get("cells", F.col("at.y_pred"))
    found = found.withColumn("id", F.get("cells", F.col("at.id")).try_cast("long"))
    wrong = whole_number(y_pred).isNull() & (F.coalesce(y_pred, F.lit("")) != "y_pred")
    count, example = found.filter(wrong).agg(F.count("*"), F.min("path")).first()
    if count:
        raise ValueError(f"{count} predictions are not whole numbers, for example in {example}")
    return found.withColumn("y_pred", whole_number(y_pred)).drop("value", "cells", "at")


def runs(rows: DataFrame) -> DataFrame:
    """Keyed predictions with a row id; files whose name does not parse are skipped."""
    files = prediction_files(rows).filter(F.col("key.layer").isNotNull())
    files = files.select("path", "at", "key.*")
    return (
        parsed(rows, files).filter(F.col("y_pred").isNotNull()).select(*RUN_KEY, "id", "y_pred")
    )


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with their row id, keyed by what the file name says.

    Files whose name does not parse are skipped, and so are files without predictions.
    """
    return runs(lines(spark.read, folder))


def read_prompt_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt predictions; the file's name is the prompt type."""
    rows = lines(spark.read, folder)
    files = prediction_files(rows).select("path", "at", F.col("stem").alias("prompt_type"))
    return (
        parsed(rows, files).filter(F.col("y_pred").isNotNull()).select("prompt_type", "id", "y_pred")
    )


def read_positional_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Plain one-column files, where a row's position in the file is its identity.

    Files may be split between tasks. Lines of a split are numbered in order, and the sizes
    of the splits before it give the first position. The numbered lines are stored first, so
    both steps see the same splits. A file must be one file here, not a folder of parts.
    """
    numbered = lines(spark.read, folder).withColumn("line", F.monotonically_increasing_id())
    numbered = written(numbered, "lines")
    splits = numbered.groupBy("path", "start").agg(
        F.count("*").alias("n"), F.min("line").alias("first_line")
    )
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "path", "start", "first_line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    # The header line has position 0.
    position = F.col("line") - F.col("first_line") + F.col("before")
    placed = numbered.join(small_side(offsets), ["path", "start"]).withColumn("position", position)
    files = prediction_files(placed).filter(F.col("key.layer").isNotNull())
    return (
        parsed(placed, files.select("path", "at", "key.*"))
        .filter(F.col("position") > 0)
        .select(*RUN_KEY, "position", "y_pred")
    )
