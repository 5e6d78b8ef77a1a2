"""Experiment grids and what of them is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from layerlens.operators.pooling import POOLINGS
from layerlens.sources.labelled import LANGUAGES

CELL = ("dataset", "model", "layer", "pooling", "probe")
EXPERIMENT = (
    "models array<string>, datasets array<string>, probes array<string>, "
    "n_layers int, token_level boolean"
)


def from_yaml(spark: SparkSession, path: str, n_layers: int) -> DataFrame:
    """Experiments of a configuration file, one row each."""
    import yaml

    with open(path) as handle:
        config = yaml.safe_load(handle)
    token_level = bool(config.get("options", {}).get("token_level_exploration", False))
    rows = [
        (e["model_name"], e["dataset_name"], e["probe_types"], n_layers, token_level)
        for e in config.get("experiment", [])
    ]
    return spark.createDataFrame(rows, EXPERIMENT)


def work_grid(experiments: DataFrame) -> DataFrame:
    """One row per (dataset, model, layer, pooling, probe).

    Without token-level exploration the only pooling is the mean; a dataset list that
    starts with `multilingual` stands for all languages.
    """
    texts = lambda values: F.array(*map(F.lit, values))
    multilingual = F.element_at("datasets", 1) == "multilingual"
    poolings = F.when(F.col("token_level"), texts(POOLINGS)).otherwise(texts(["mean"]))
    datasets = F.when(multilingual, texts(LANGUAGES)).otherwise(F.col("datasets"))
    return (
        experiments.filter(F.col("n_layers") > 0)
        .withColumn("model", F.explode("models"))
        .withColumn("dataset", F.explode(datasets))
        .withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("n_layers") - 1)))
        .withColumn("pooling", F.explode(poolings))
        .withColumn("probe", F.explode("probes"))
        .select(*CELL)
    )


def remaining(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells not completed yet."""
    return grid.join(done.select(*CELL), list(CELL), "left_anti")


COMPLETED = "completed_probes map<string,map<string,array<string>>>, last_layer int"


def completed_cells(df: DataFrame) -> DataFrame:
    """Completed cells from checkpoint documents: (dataset, model, checkpoint as JSON)."""
    state = F.from_json("checkpoint", COMPLETED)
    return (
        df.select("dataset", "model", state.alias("s"))
        .select("dataset", "model", F.explode("s.completed_probes").alias("layer", "by_pooling"))
        .select("dataset", "model", "layer", F.explode("by_pooling").alias("pooling", "probes"))
        .select(
            "dataset",
            "model",
            F.col("layer").cast("int").alias("layer"),
            "pooling",
            F.explode("probes").alias("probe"),
        )
    )


def checkpoint_documents(done: DataFrame) -> DataFrame:
    """Checkpoint documents from completed cells, one JSON text per dataset and model."""
    probes = done.groupBy("dataset", "model", "layer", "pooling").agg(
        F.array_sort(F.collect_set("probe")).alias("probes")
    )
    poolings = probes.groupBy("dataset", "model", "layer").agg(
        F.map_from_entries(F.collect_list(F.struct("pooling", "probes"))).alias("p")
    )
    layer = F.col("layer").cast("string")
    layers = poolings.groupBy("dataset", "model").agg(
        F.map_from_entries(F.collect_list(F.struct(layer, "p"))).alias("completed_probes"),
        (F.max("layer") + 1).alias("last_layer"),
    )
    document = F.to_json(F.struct("completed_probes", "last_layer"))
    return layers.select("dataset", "model", document.alias("checkpoint"))
