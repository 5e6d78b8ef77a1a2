"""Reading and writing: texts, predictions, results, experiment grids, arriving files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from layerlens.operators import metrics, significance
from layerlens.operators.metrics import METRICS
from layerlens.operators.pooling import POOLINGS
from layerlens.plans.inputs import (
    KEYS,
    SQL_INCOMPLETE,
    SQL_LABELLED,
    SQL_PREDICTIONS,
    SQL_PROMPT_PREDICTIONS,
    SQL_RESULTS,
    aligned,
    incomplete_texts,
    labelled_texts,
    predictions,
    prompt_predictions,
    results,
    sql_scores,
    table,
    truth,
)
from layerlens.plans.metric_queries import PAIR, RESULT_COLUMNS, TEST_KEYS, TESTS_SQL
from layerlens.plans.registry import query
from layerlens.session import new_folder
from layerlens.sources import experiments, labelled, results as result_tables
from layerlens.sources import predictions as prediction_files
from layerlens.sources.quoted import read_quoted
from layerlens.streaming import evaluation


@query(
    "s1_labelled_source",
    f"WITH {SQL_INCOMPLETE} SELECT id, dataset, coalesce(text, 'nan') AS text, label FROM incomplete",
)
def labelled_source(spark, sf):
    return labelled.labelled(incomplete_texts(spark, sf))


@query(
    "s1_quoted_csv",
    f"WITH {SQL_INCOMPLETE} SELECT id, dataset, coalesce(text, 'nan') AS text, label FROM incomplete",
)
def quoted_csv(spark, sf):
    """The texts as quoted CSV files, each read by as many tasks as it has ranges."""
    folder = new_folder(spark, "quoted")
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    incomplete_texts(spark, sf).write.options(header=True, escape='"', **spaces).csv(folder)
    rows = read_quoted(spark, folder).withColumn("label", labelled.label_of(F.col("label")))
    return labelled.labelled(rows.select(F.col("id").cast("long").alias("id"), "dataset", "text", "label"))


@query(
    "s2_language_source",
    """SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars
    FROM documents WHERE lang IN ('fr', 'de') GROUP BY lang""",
)
def language_source(spark, sf):
    """Documents stored by language; only the wanted languages' folders are read."""
    folder = new_folder(spark, "by-language")
    table(spark, sf, "documents").write.partitionBy("lang").parquet(folder)
    rows = labelled.in_languages(spark.read.parquet(folder), ["fr", "de"])
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s3_normalised_columns", f"WITH {SQL_LABELLED} SELECT id, split, lang, text, label FROM labelled")
def normalised_columns(spark, sf):
    raw = labelled_texts(spark, sf).withColumnRenamed("text", "sentence")
    return labelled.normalise_columns(raw)


@query("s4_split_writer", f"WITH {SQL_LABELLED} SELECT id, lang, text, label, split FROM labelled")
def split_writer(spark, sf):
    folder = new_folder(spark, "splits")
    labelled.write_splits(labelled_texts(spark, sf).drop("source"), folder)
    return spark.read.parquet(folder)


@query(
    "s5_head_rows",
    f"""WITH {SQL_LABELLED}
    SELECT id, split, label FROM (
      SELECT *, row_number() OVER (PARTITION BY split ORDER BY id) AS place FROM labelled)
    WHERE place <= 100""",
)
def head_rows(spark, sf):
    return labelled.head(labelled_texts(spark, sf).select("id", "split", "label"))


@query(
    "s6_prediction_sink",
    f"""WITH {SQL_PREDICTIONS}
    SELECT dataset, 'rules' AS model, layer, pooling, probe, id, y_pred FROM preds""",
)
def prediction_sink(spark, sf):
    folder = new_folder(spark, "predictions")
    rows = predictions(spark, sf).withColumn("model", F.lit("rules"))
    for _ in range(2):  # a run written again replaces itself
        prediction_files.write_predictions(rows, folder)
    return spark.read.parquet(folder)


@query(
    "s7_prompt_prediction_sink",
    f"""WITH {SQL_PROMPT_PREDICTIONS}
    SELECT dataset, 'rules' AS model, prompt_type, id, y_pred FROM preds""",
)
def prompt_prediction_sink(spark, sf):
    folder = new_folder(spark, "prompt-predictions")
    rows = prompt_predictions(spark, sf).withColumn("model", F.lit("rules"))
    prediction_files.write_predictions(rows, folder, ("dataset", "model", "prompt_type"))
    return spark.read.parquet(folder)


DATASETS = ("quality", "lang")


def _each(df):
    """(dataset, its rows): a folder of run files holds one dataset."""
    return [(d, df.filter(F.col("dataset") == d).drop("dataset")) for d in DATASETS]


def _of_each(read, folder):
    """What `read` finds in the folder of each dataset."""
    return reduce(DataFrame.unionByName, [read(f"{folder}/{d}").withColumn("dataset", F.lit(d)) for d in DATASETS])


def _run_name():
    return prediction_files.run_file(F.col("layer"), F.col("pooling"), F.col("probe"))


@query(
    "s8_prediction_source",
    f"""WITH {SQL_PREDICTIONS}
    SELECT dataset, layer, pooling, probe, id, y_pred FROM preds""",
)
def prediction_source(spark, sf):
    """Run files written and read back by name; files with a malformed name are skipped."""
    folder = new_folder(spark, "runs")
    nameless = F.concat(F.lit("layer_"), F.col("layer"), F.lit(".tsv"))
    for dataset, preds in _each(predictions(spark, sf)):
        for name in (_run_name(), nameless):
            prediction_files.write_run_files(preds, f"{folder}/{dataset}", name)
    return _of_each(lambda own: prediction_files.read_runs(spark, own), folder)


@query(
    "s9_prompt_prediction_source",
    f"""WITH {SQL_PROMPT_PREDICTIONS}
    SELECT dataset, prompt_type, id, y_pred FROM preds""",
)
def prompt_prediction_source(spark, sf):
    folder = new_folder(spark, "prompt-runs")
    for dataset, preds in _each(prompt_predictions(spark, sf)):
        prediction_files.write_run_files(preds, f"{folder}/{dataset}", F.concat("prompt_type", F.lit(".tsv")))
    return _of_each(lambda own: prediction_files.read_prompt_runs(spark, own), folder)


@query("s10_result_append", f"WITH {SQL_RESULTS} SELECT * FROM scored", RESULT_COLUMNS)
def result_append(spark, sf):
    """Two datasets' results added to one table, one after the other."""
    folder = new_folder(spark, "results")
    whole = results(spark, sf)
    for dataset in ("quality", "lang"):
        result_tables.append_results(whole.filter(F.col("dataset") == dataset), folder)
    return result_tables.read_results(spark, folder)


@query(
    "s11_result_union",
    f"""WITH {SQL_RESULTS}
    SELECT dataset, layer, pooling, probe, accuracy, NULL::DOUBLE AS C, layer + 2 AS n_neighbors
    FROM scored WHERE probe = 'knn'
    UNION ALL SELECT dataset, layer, pooling, probe, accuracy, 1.0 / (layer + 1), NULL
    FROM scored WHERE probe = 'linear-svm'
    UNION ALL SELECT dataset, layer, pooling, probe, accuracy, NULL, NULL
    FROM scored WHERE probe = 'naive_bayes'""",
    "accuracy C",
)
def result_union(spark, sf):
    whole = results(spark, sf).select(*KEYS, "accuracy")
    of = lambda probe: whole.filter(F.col("probe") == probe)
    return result_tables.union_results(
        [
            of("knn").withColumn("n_neighbors", F.col("layer") + 2),
            of("linear-svm").withColumn("C", 1.0 / (F.col("layer") + 1)),
            of("naive_bayes"),
        ]
    )


@query(
    "s12_evaluation_sinks",
    f"""WITH {SQL_PREDICTIONS}, {TESTS_SQL}
    SELECT 't_test' AS "table", {PAIR}, t_stat AS stat, t_p_value AS p_value FROM tests
    UNION ALL SELECT 'wilcoxon', {PAIR}, wilcoxon_stat, wilcoxon_p_value FROM tests""",
    "stat p_value",
)
def evaluation_sinks(spark, sf):
    folder = new_folder(spark, "evaluation")
    pairs = significance.discordance(aligned(spark, sf), TEST_KEYS)
    tables = {
        "t_test": significance.t_test(pairs).withColumnRenamed("t_stat", "stat"),
        "wilcoxon": significance.wilcoxon(pairs),
    }
    result_tables.write_evaluation(tables, folder)
    columns = [*TEST_KEYS, "probe_1", "probe_2", "stat", "p_value"]
    stored = [
        spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("table"), *columns)
        for name in tables
    ]
    return result_tables.union_results(stored)


# Experiments: each source is a model, run on the languages it has texts in. ----------

SQL_GRID = f"""experiments AS (
  SELECT source AS model, list_sort(list(DISTINCT lang)) AS datasets,
         count(DISTINCT lang) AS n_layers, length(source) = 4 AS token_level
  FROM documents GROUP BY source),
grid AS (
  SELECT dataset, model, layer::INTEGER AS layer, pooling, probe
  FROM (SELECT model, unnest(datasets) AS dataset, n_layers, token_level FROM experiments) e,
       range(100) r(layer),
       (VALUES {", ".join(f"('{p}')" for p in POOLINGS)}) p(pooling),
       (VALUES ('knn'), ('mlp')) q(probe)
  WHERE layer < n_layers AND (token_level OR pooling = 'mean')),
done AS (
  SELECT * FROM grid
  WHERE substr(md5(concat_ws('|', dataset, model, layer, pooling, probe)), 1, 1) < '8')"""


def _grid(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(
        F.array_sort(F.collect_set("lang")).alias("datasets")
    )
    return experiments.work_grid(
        rows.select(
            F.array("source").alias("models"),
            "datasets",
            F.array(F.lit("knn"), F.lit("mlp")).alias("probes"),
            F.size("datasets").alias("n_layers"),
            (F.length("source") == 4).alias("token_level"),
        )
    )


def _done(grid):
    name = F.concat_ws("|", *experiments.CELL)
    return grid.filter(F.substring(F.md5(name), 1, 1) < "8")


@query("s13_experiment_grid", f"WITH {SQL_GRID} SELECT * FROM grid")
def experiment_grid(spark, sf):
    return _grid(spark, sf)


REMAINING_SQL = f"WITH {SQL_GRID} SELECT * FROM grid EXCEPT SELECT * FROM done"


@query("s14_resume_list", REMAINING_SQL)
def resume_list(spark, sf):
    """What is left to do, with the completed cells read from checkpoint documents."""
    grid = _grid(spark, sf)
    documents = experiments.checkpoint_documents(_done(grid))
    return experiments.remaining(grid, experiments.completed_cells(documents))


@query("j3_resume_anti_join", REMAINING_SQL)
def resume_anti_join(spark, sf):
    grid = _grid(spark, sf)
    return experiments.remaining(grid, _done(grid))


@query(
    "v2_incremental_evaluation",
    f"""WITH {SQL_PREDICTIONS}, {sql_scores("dataset, layer, pooling, probe", "macro")}
    SELECT dataset, layer, pooling, probe, {", ".join(METRICS)} FROM scored""",
    RESULT_COLUMNS,
)
def incremental_evaluation(spark, sf):
    """Run files arrive in two deliveries; each is scored once, by a resumed stream."""
    root = new_folder(spark, "incremental")
    labels = dict(_each(truth(spark, sf)))
    for first in (True, False):
        for dataset, preds in _each(predictions(spark, sf).filter((F.col("layer") == 0) == first)):
            own = f"{root}/{dataset}"
            prediction_files.write_run_files(preds, f"{own}/runs", _run_name())
            evaluation.score_new_files(
                spark, f"{own}/runs", labels[dataset], f"{own}/counts", f"{own}/checkpoint"
            ).awaitTermination()
    return _of_each(lambda own: evaluation.scores_so_far(spark, f"{own}/counts", "macro"), root)
