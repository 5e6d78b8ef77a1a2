"""Labelled texts: reading, checking and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from layerlens.functions.text import text_or_nan
from layerlens.session import written
from layerlens.sources.quoted import read_quoted

# The languages a multilingual dataset has, one folder each.
LANGUAGES = (
    "arabic",
    "english",
    "french",
    "german",
    "hindi",
    "italian",
    "portuguese",
    "spanish",
)
MULTILINGUAL_NAME = "tweet_sentiment_multilingual"
# Texts that a missing value is written as in a CSV file.
MISSING_TEXTS = (
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def normalise_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keeps `text` and `label` (and `id`); a `sentence` column is taken as the text."""
    if "text" not in df.columns:
        if "sentence" not in df.columns:
            raise ValueError("No 'text' or 'sentence' column")
        df = df.withColumnRenamed("sentence", "text")
    if "label" not in df.columns:
        raise ValueError("No 'label' column")
    return df.select(*[c for c in ("id", "split", "lang", "text", "label", *keep) if c in df.columns])


def labelled(df: DataFrame) -> DataFrame:
    """The table classifiers work on: text as string, a missing text as `nan`."""
    missing = {"text", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"Missing columns: {', '.join(sorted(missing))}")
    return df.withColumn("text", text_or_nan(F.col("text")))


def whole_number(value: Column) -> Column:
    """`1` and `1.0` as an integer; null for anything else."""
    number = value.try_cast("double")
    return F.coalesce(value.try_cast("int"), F.when(number == F.floor(number), number.try_cast("int")))


def label_of(value: Column) -> Column:
    """The integer label; null where it is missing, an error where it is no whole number."""
    missing = value.isNull() | (F.trim(value) == "") | F.trim(value).isin(*MISSING_TEXTS)
    problem = F.raise_error(F.concat(F.lit("Label is not a whole number: "), value)).cast("int")
    return F.when(~missing, F.coalesce(whole_number(value), problem))


#: A dataset's parts get ids this far apart; places within a part stay below it.
PART_IDS = 1 << 57


def longest_file(spark: SparkSession, path: str) -> int:
    """The bytes of the longest file under a path or pattern."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    longest = 0
    for status in system.globStatus(hadoop) or []:
        files = system.listFiles(status.getPath(), True)
        while files.hasNext():
            longest = max(longest, files.next().getLen())
    return longest


def _placed_split(spark: SparkSession, path: str) -> DataFrame:
    """A split with each row's place in it under `_at`."""
    if longest_file(spark, path) > _bytes(spark, "spark.sql.files.maxPartitionBytes"):
        raw = read_quoted(spark, path)
    else:
        raw = spark.read.options(**CSV_OPTIONS).csv(path).withColumn("_at", F.monotonically_increasing_id())
    df = normalise_columns(raw, keep=("_at",))
    text = F.when(~F.col("text").isin(*MISSING_TEXTS), F.col("text"))
    return df.withColumn("text", text).withColumn("label", label_of(F.col("label")))


def _bytes(spark: SparkSession, setting: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """One CSV split, columns found by name; missing texts and labels are null.

    Quoted texts may span lines. A file that fits one scan task is read by one; longer ones are
    read by many tasks each (`quoted.read_quoted`), with the same rows.
    """
    return _placed_split(spark, path).drop("_at")


def read_dataset(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Train and test split of a dataset, with `split`, and `lang` for a language dataset.

    `multilingual` reads every language; a language's name reads that folder only. Files
    without an `id` get one by line order, unique over all splits; the numbered table is stored,
    so that every later step sees the same numbers.
    """
    languages = LANGUAGES if dataset == "multilingual" else (dataset,)
    parts = []
    for name in languages:
        base = f"{root}/{name}"
        if name in LANGUAGES:
            base = f"{root}/multilingual/{name}/{MULTILINGUAL_NAME}"
        for split in ("train", "test"):
            part = _placed_split(spark, f"{base}_{split}.csv").withColumn("split", F.lit(split))
            part = part.withColumn("_at", F.col("_at") + F.lit(len(parts) * PART_IDS))
            parts.append(part.withColumn("lang", F.lit(name if name in LANGUAGES else None)))
    numbered = all("id" in part.columns for part in parts)
    parts = [part.drop("_at") if numbered else part.drop("id").withColumnRenamed("_at", "id") for part in parts]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return labelled(whole if numbered else written(whole, "dataset"))


def in_languages(df: DataFrame, languages) -> DataFrame:
    """Rows of the given languages; with `lang` as partition column only those are read."""
    return df.filter(F.col("lang").isin(list(languages)))


def write_splits(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """One folder per split."""
    writer = df.write.mode("overwrite").partitionBy("split")
    (writer.options(header=True, escape='"') if fmt == "csv" else writer).format(fmt).save(folder)


def head(df: DataFrame, n: int = 100, by: str = "split") -> DataFrame:
    """The first rows of each split; every task keeps at most `n` rows before the shuffle."""
    order = W.partitionBy(by).orderBy("id")
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")
