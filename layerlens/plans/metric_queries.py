"""Scores, comparisons and paired tests of the predictions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from layerlens.operators import compare, metrics, significance
from layerlens.operators.metrics import METRICS
from layerlens.operators.probes import best_of_trials
from layerlens.plans.inputs import (
    KEYS,
    PROBES,
    SQL_PREDICTIONS,
    SQL_PROMPT_PREDICTIONS,
    SQL_RESULTS,
    SQL_TRUTH,
    aligned,
    predictions,
    prompt_predictions,
    results,
    sql_scores,
    table,
    truth,
)
from layerlens.plans.registry import query

KEY_LIST = ", ".join(KEYS)
ON = ["dataset", "id"]
CURVE = ["dataset", "pooling", "probe"]


@query("j1_alignment", f"WITH {SQL_PREDICTIONS} SELECT * FROM aligned")
def alignment(spark, sf):
    return aligned(spark, sf)


@query(
    "j1_alignment_by_position",
    f"""WITH {SQL_PREDICTIONS},
    p AS (SELECT row_number() OVER (PARTITION BY layer, pooling, probe ORDER BY id) AS position,
                 layer, pooling, probe, y_pred
          FROM preds WHERE dataset = 'lang'),
    t AS (SELECT row_number() OVER (ORDER BY id) AS position, label AS y_true
          FROM truth WHERE dataset = 'quality')
    SELECT position, layer, pooling, probe, y_pred, y_true FROM p JOIN t USING (position)""",
)
def alignment_by_position(spark, sf):
    """Runs over all documents against a shorter truth table."""
    of = lambda df, name: df.filter(F.col("dataset") == name).drop("dataset")
    labels = truth(spark, sf)
    numbered = metrics.with_id_position(of(labels, "lang").select("id"), "id")
    preds = of(predictions(spark, sf), "lang").join(numbered, "id").drop("id")
    return metrics.align_by_position(preds, of(labels, "quality")).drop("id")


@query(
    "p7_correctness",
    f"""WITH {SQL_PREDICTIONS}
    SELECT {KEY_LIST}, id, (y_pred = y_true)::INTEGER AS correct FROM aligned""",
)
def correctness(spark, sf):
    return metrics.correctness(aligned(spark, sf)).select(*KEYS, "id", "correct")


@query(
    "p9_task_types",
    f"""WITH {SQL_TRUTH}
    SELECT dataset, count(DISTINCT label) AS n_classes, count(DISTINCT label) > 2 AS multi_class
    FROM truth GROUP BY dataset""",
)
def task_types(spark, sf):
    return metrics.task_types(truth(spark, sf), ["dataset"])


@query(
    "p6_group_filters",
    f"""WITH {SQL_PREDICTIONS}
    SELECT dataset, probe, pooling, layer, count(*) AS n, sum(y_pred)::BIGINT AS predicted
    FROM aligned GROUP BY ALL""",
)
def group_filters(spark, sf):
    """Every sub-result by probe, pooling and layer in one aggregate."""
    return aligned(spark, sf).groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.sum("y_pred").alias("predicted")
    )


@query(
    "a13_accuracy",
    f"""WITH {SQL_PREDICTIONS}
    SELECT {KEY_LIST}, avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM aligned GROUP BY ALL""",
    "accuracy",
)
def accuracy(spark, sf):
    return metrics.accuracy(aligned(spark, sf), KEYS)


def _averaged(spark, sf, average):
    return metrics.evaluate(predictions(spark, sf), truth(spark, sf), ON, KEYS, average)


for _number, _average in (("a14", "binary"), ("a15", "macro"), ("a16", "weighted")):

    @query(
        f"{_number}_{_average}_scores",
        f"""WITH {SQL_PREDICTIONS}, {sql_scores(KEY_LIST, _average)}
        SELECT {KEY_LIST}, precision, recall, f1_score FROM scored""",
        "precision recall f1_score",
    )
    def averaged(spark, sf, average=_average):
        return _averaged(spark, sf, average).drop("accuracy", "mcc")


@query(
    "a17_matthews_correlation",
    f"WITH {SQL_PREDICTIONS}, {sql_scores(KEY_LIST, 'macro')} SELECT {KEY_LIST}, mcc FROM scored",
    "mcc",
)
def matthews_correlation(spark, sf):
    return _averaged(spark, sf, "macro").select(*KEYS, "mcc")


MATRIX_SQL = f"""cells AS (
  SELECT {KEY_LIST}, y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
seen AS (
  SELECT {KEY_LIST}, y_true AS label FROM cells UNION SELECT {KEY_LIST}, y_pred FROM cells),
grid AS (
  SELECT {", ".join("a." + k for k in KEYS)}, a.label AS y_true, b.label AS y_pred
  FROM seen a JOIN seen b USING ({KEY_LIST})),
matrix AS (
  SELECT {KEY_LIST}, y_true, y_pred, coalesce(n, 0) AS n
  FROM grid LEFT JOIN cells USING ({KEY_LIST}, y_true, y_pred))"""


@query("a18_confusion_matrix", f"WITH {SQL_PREDICTIONS}, {MATRIX_SQL} SELECT * FROM matrix")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(metrics.confusion(aligned(spark, sf), KEYS), KEYS)


@query(
    "a19_confusion_flatten",
    f"""WITH {SQL_PREDICTIONS}, {MATRIX_SQL}
    SELECT {KEY_LIST}, string_agg(n::VARCHAR, ',' ORDER BY y_true, y_pred) AS confusion_matrix
    FROM matrix GROUP BY {KEY_LIST}""",
)
def confusion_flatten(spark, sf):
    cells = metrics.confusion(aligned(spark, sf), KEYS)
    return metrics.flatten_confusion(metrics.confusion_matrix(cells, KEYS), KEYS)


@query(
    "a20_evaluation_loss",
    """WITH long AS (
      SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
    means AS (SELECT label AS c, dim, avg(x) AS m FROM long GROUP BY label, dim),
    logits AS (SELECT vec_id, label, c, sum(x * m) AS s FROM long JOIN means USING (dim) GROUP BY vec_id, label, c),
    chances AS (
      SELECT vec_id, label, c, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM logits)
    SELECT label, avg(-ln(p)) AS eval_loss FROM chances WHERE c = label GROUP BY label""",
    "eval_loss",
)
def evaluation_loss(spark, sf):
    """Class scores are the products of a vector with the mean vector of each label, over all
    dimensions; their probabilities are the scores' softmax."""
    vectors = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    means = vectors.groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m")
    ).agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("means"))
    scored = vectors.withColumn("means", means.scalar())
    product = lambda m: F.aggregate(
        F.zip_with("x", m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    scored = scored.withColumn("s", F.transform("means", lambda c: product(c["m"])))
    peaks = F.transform("s", lambda v: F.exp(v - F.array_max("s")))
    scored = scored.withColumn("peaks", peaks)
    total = F.aggregate("peaks", F.lit(0.0), lambda acc, v: acc + v)
    scored = scored.withColumn("total", total).withColumn(
        "probability", F.transform("peaks", lambda v: v / F.col("total"))
    )
    # A label's place among all labels is where its probability stands.
    place = F.array_position(F.transform("means", lambda c: c["label"]), F.col("label")) - 1
    scored = scored.select(F.col("label").alias("own"), place.alias("label"), "probability")
    return metrics.cross_entropy(scored, ["own"]).withColumnRenamed("own", "label")


RESULT_COLUMNS = " ".join(METRICS)


@query("a21_evaluation_results", f"WITH {SQL_RESULTS} SELECT * FROM scored", RESULT_COLUMNS)
def evaluation_results(spark, sf):
    return results(spark, sf)


@query(
    "a22_prompt_results",
    f"WITH {SQL_PROMPT_PREDICTIONS}, {sql_scores('dataset, prompt_type', 'auto')} SELECT * FROM scored",
    RESULT_COLUMNS,
)
def prompt_results(spark, sf):
    return metrics.evaluate(
        prompt_predictions(spark, sf), truth(spark, sf), ON, ["dataset", "prompt_type"]
    )


@query(
    "a23_mean_metrics",
    f"""WITH {SQL_RESULTS}
    SELECT layer, pooling, probe, avg(accuracy) AS accuracy, avg(precision) AS precision,
           avg(recall) AS recall, avg(f1_score) AS f1_score, avg(mcc) AS mcc
    FROM scored GROUP BY layer, pooling, probe""",
    RESULT_COLUMNS,
)
def mean_metrics(spark, sf):
    return compare.mean_metrics(results(spark, sf), ["layer", "pooling", "probe"])


@query(
    "a24_layer_pooling_interaction",
    f"""WITH {SQL_RESULTS},
    slots AS (
      SELECT dataset, layer, pooling, accuracy,
             row_number() OVER (PARTITION BY dataset, layer, pooling ORDER BY probe) - 1 AS slot,
             count(*) OVER (PARTITION BY dataset, layer, pooling) AS size
      FROM scored),
    draws AS (
      SELECT dataset, layer, pooling, r AS replicate,
             ('0x' || substr(md5(concat_ws('|', dataset, layer, pooling, r, slot + 1, 42)), 1, 7))::BIGINT
               % size AS pick
      FROM slots, range(1, 1001) t(r)),
    means AS (
      SELECT d.dataset, d.layer, d.pooling, d.replicate, avg(s.accuracy) AS mean
      FROM draws d JOIN slots s ON s.dataset = d.dataset AND s.layer = d.layer
           AND s.pooling = d.pooling AND s.slot = d.pick
      GROUP BY ALL)
    SELECT dataset, layer, pooling, accuracy, ci_low, ci_high
    FROM (SELECT dataset, layer, pooling, avg(accuracy) AS accuracy FROM scored GROUP BY ALL)
    JOIN (SELECT dataset, layer, pooling, quantile_cont(mean, 0.025) AS ci_low,
                 quantile_cont(mean, 0.975) AS ci_high
          FROM means GROUP BY ALL) USING (dataset, layer, pooling)""",
    "accuracy ci_low ci_high",
)
def layer_pooling_interaction(spark, sf):
    return compare.interaction(results(spark, sf), ["dataset", "layer", "pooling"], "probe")


def _best_sql(by: str, columns: str, order: str) -> str:
    return f"""WITH {SQL_RESULTS}
    SELECT {columns} FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS place FROM scored)
    WHERE place = 1"""


@query(
    "w4_best_per_pooling",
    _best_sql("dataset, pooling", "dataset, pooling, accuracy, layer, probe",
              "accuracy DESC, layer, probe"),
    "accuracy",
)
def best_per_pooling(spark, sf):
    return compare.best(
        results(spark, sf), ["dataset", "pooling"], "accuracy", ["layer", "probe"]
    )


@query(
    "w5_best_per_layer_pooling",
    f"""WITH {SQL_RESULTS}
    SELECT dataset, layer, pooling, max(accuracy) AS best_accuracy FROM scored GROUP BY ALL""",
    "best_accuracy",
)
def best_per_layer_pooling(spark, sf):
    return compare.best_value(results(spark, sf), ["dataset", "layer", "pooling"], "accuracy")


@query(
    "w6_best_pooling_per_layer",
    f"""WITH {SQL_RESULTS},
    means AS (SELECT layer, pooling, probe, avg(accuracy) AS accuracy FROM scored GROUP BY ALL)
    SELECT layer, accuracy, pooling, probe FROM (
      SELECT *, row_number() OVER (PARTITION BY layer
                                   ORDER BY accuracy DESC, pooling, probe) AS place FROM means)
    WHERE place = 1""",
    "accuracy",
)
def best_pooling_per_layer(spark, sf):
    means = compare.mean_metrics(results(spark, sf), ["layer", "pooling", "probe"])
    return compare.best(means, ["layer"], "accuracy", ["pooling", "probe"])


@query(
    "w7_best_layer_per_probe_pooling",
    _best_sql("dataset, probe, pooling", "dataset, probe, pooling, accuracy, layer",
              "accuracy DESC, layer"),
    "accuracy",
)
def best_layer_per_probe_pooling(spark, sf):
    return compare.best(
        results(spark, sf), ["dataset", "probe", "pooling"], "accuracy", ["layer"]
    )


@query(
    "w8_best_trial",
    f"""WITH {SQL_PREDICTIONS}, {sql_scores(KEY_LIST, 'weighted')},
    trials AS (
      SELECT dataset, probe, layer * 2 + CASE pooling WHEN 'max' THEN 1 ELSE 0 END AS trial,
             round(f1_score, 2) AS f1_score
      FROM scored)
    SELECT dataset, probe, trial, f1_score FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1_score DESC, trial, probe) AS place
      FROM trials)
    WHERE place = 1""",
    "f1_score",
)
def best_trial(spark, sf):
    """Layer and pooling taken as trials; scores are cut to two digits so that some tie."""
    scored = _averaged(spark, sf, "weighted")
    trials = scored.select(
        "dataset",
        "probe",
        (F.col("layer") * 2 + (F.col("pooling") == "max").cast("int")).alias("trial"),
        F.round("f1_score", 2).alias("f1_score"),
    )
    return best_of_trials(trials, ["dataset"], "f1_score", ["trial", "probe"])


@query(
    "w11_accuracy_curve",
    f"""WITH {SQL_RESULTS}
    SELECT dataset, pooling, probe, layer, accuracy,
           accuracy - lag(accuracy) OVER (PARTITION BY dataset, pooling, probe ORDER BY layer) AS change
    FROM scored""",
    "accuracy change",
)
def accuracy_curve(spark, sf):
    return compare.accuracy_curve(results(spark, sf), CURVE)


@query(
    "r4_melted_metrics",
    f"""WITH {SQL_RESULTS}
    SELECT dataset, layer, pooling, probe, metric, value FROM (
      UNPIVOT scored ON accuracy, precision, recall, f1_score, mcc INTO NAME metric VALUE value)""",
    "value",
)
def melted_metrics(spark, sf):
    return metrics.melt(results(spark, sf), KEYS)


# Paired tests ------------------------------------------------------------------------

TEST_KEYS = ["dataset", "layer", "pooling"]
PAIRS_SQL = """pair_rows AS (
  SELECT a.dataset, a.layer, a.pooling, a.probe AS probe_1, b.probe AS probe_2,
         (a.y_pred = a.y_true)::INTEGER AS correct_1, (b.y_pred = b.y_true)::INTEGER AS correct_2
  FROM aligned a JOIN aligned b ON a.dataset = b.dataset AND a.layer = b.layer
       AND a.pooling = b.pooling AND a.id = b.id AND a.probe < b.probe),
pairs AS (
  SELECT dataset, layer, pooling, probe_1, probe_2, count(*) AS n,
         count(*) FILTER (WHERE correct_1 = 1 AND correct_2 = 0) AS b,
         count(*) FILTER (WHERE correct_1 = 0 AND correct_2 = 1) AS c
  FROM pair_rows GROUP BY ALL),
t_values AS (
  SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE
    ((b - c) / n) / sqrt(((b + c) - (b - c) * (b - c) / n) / (n - 1) / n) END AS t_stat
  FROM pairs),
t_tests AS (
  SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, {tail} / {whole}) END AS t_p_value
  FROM t_values),
w_tests AS (
  SELECT *, least(b, c) * (b + c + 1) / 2 AS wilcoxon_stat,
         CASE WHEN b + c = 0 THEN 0.0 ELSE (b - c) / sqrt(b + c) END AS z
  FROM t_tests),
tests AS (
  SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {normal}) END AS wilcoxon_p_value
  FROM w_tests)"""


def _simpson(low: str, high: str, density: str) -> str:
    x = f"({low} + i * (({high}) - ({low})) / 2000)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    terms = f"list_transform(range(0, 2001), lambda i: {weight} * {density.format(x=x)})"
    return f"(list_sum({terms}) * (({high}) - ({low})) / 6000)"


_ANGLE = "atan(abs(t_stat) / sqrt(n - 1))"
_COSINE = "pow(greatest(cos({x}), 0), n - 2)"
TESTS_SQL = PAIRS_SQL.format(
    tail=_simpson(_ANGLE, f"least(pi() / 2, {_ANGLE} + 14 / sqrt(n - 1))", _COSINE),
    whole=_simpson("0", "least(pi() / 2, 14 / sqrt(n - 1))", _COSINE),
    normal=_simpson("abs(z)", "abs(z) + 14", "exp(-0.5 * {x} * {x}) / sqrt(2 * pi())"),
)
PAIR = "dataset, layer, pooling, probe_1, probe_2"


def _pairs(spark, sf):
    return significance.discordance(aligned(spark, sf), TEST_KEYS, PROBES)


@query(
    "j2_probe_pairs",
    f"""WITH {SQL_PREDICTIONS}, {TESTS_SQL}
    SELECT {PAIR}, correct_1, correct_2, count(*) AS n FROM pair_rows GROUP BY ALL""",
)
def probe_pairs(spark, sf):
    return significance.pair_answers(aligned(spark, sf), TEST_KEYS, PROBES)


@query("x1_discordance", f"WITH {SQL_PREDICTIONS}, {TESTS_SQL} SELECT {PAIR}, n, b, c FROM pairs")
def discordance(spark, sf):
    return _pairs(spark, sf)


@query(
    "x2_paired_t_test",
    f"""WITH {SQL_PREDICTIONS}, {TESTS_SQL}
    SELECT {PAIR}, n, b, c, t_stat, t_p_value AS p_value FROM tests""",
    "t_stat p_value",
)
def paired_t_test(spark, sf):
    return significance.t_test(_pairs(spark, sf))


@query(
    "x3_wilcoxon",
    f"""WITH {SQL_PREDICTIONS}, {TESTS_SQL}
    SELECT {PAIR}, n, b, c, wilcoxon_stat AS stat, z, wilcoxon_p_value AS p_value FROM tests""",
    "stat z p_value",
)
def wilcoxon(spark, sf):
    return significance.wilcoxon(_pairs(spark, sf))


@query(
    "x4_test_table",
    f"""WITH {SQL_PREDICTIONS}, {TESTS_SQL}
    SELECT {PAIR}, t_stat, t_p_value, wilcoxon_stat, wilcoxon_p_value FROM tests""",
    "t_stat t_p_value wilcoxon_stat wilcoxon_p_value",
)
def test_table(spark, sf):
    return significance.test_table(_pairs(spark, sf), TEST_KEYS)
