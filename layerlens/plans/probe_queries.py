"""Probes trained on the embeddings and scored on their test part."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlens.operators import metrics, neighbours, pooling, probes, vector_index
from layerlens.plans import jobs
from layerlens.plans.inputs import (
    MARK,
    SEQUENCE,
    SQL_FEATURES,
    SQL_MARKED,
    SQL_TEST,
    features,
    marked_features,
    table,
    token_states,
)
from layerlens.plans.registry import query
from layerlens.session import new_folder

SEED, K, TRIALS = 42, 5, 5


def _parts(df):
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")


def _predicted(spark, sf, probe, params, rows=features):
    train, test = _parts(rows(spark, sf))
    preds = probes.fit(train, probe, params, SEED).predict(test)
    return metrics.align(preds, test.select("id", "label"), ["id"])


# Parameters of the registered fits, all within the search spaces.
FITS = {
    "m1_logistic_regression": ("logistic-regression", {"C": 1.0}),
    "m2_linear_svm": ("linear-svm", {"C": 1.0}),
    "m3_multilayer_perceptron": ("mlp", {"hidden_layer_sizes": (64,), "alpha": 1e-2}),
    "m4_kernel_svm": ("non-linear-svm", {"C": 1.0, "kernel": "rbf"}),
    "m5_decision_tree": ("decision-tree", {"max_depth": 12}),
    "m6_random_forest": ("random-forest", {"n_estimators": 50, "max_depth": 8}),
    "m7_boosted_trees": ("xgboost", {"n_estimators": 50, "learning_rate": 0.3}),
    "m8_boosted_trees_by_leaves": (
        "lightgbm",
        {"n_estimators": 50, "learning_rate": 0.3, "num_leaves": 31},
    ),
}

for _name, (_probe, _params) in FITS.items():

    @query(_name, SQL_MARKED)
    def fitted_probe(spark, sf, probe=_probe, params=_params):
        return _predicted(spark, sf, probe, params, marked_features)


def _bayes_sql(features: str, train: str, test: str, columns: str) -> str:
    """Class priors and normal densities with smoothed variances, written out."""
    return f"""WITH {features},
    long AS (
      SELECT id, split, label, unnest(features) AS x, generate_subscripts(features, 1) AS dim
      FROM features),
    smoothing AS (
      SELECT 1e-9 * max(v) AS eps FROM (
        SELECT var_pop(x) AS v FROM long WHERE {train} GROUP BY dim)),
    model AS (
      SELECT label AS class, dim, avg(x) AS mean, var_pop(x) + any_value(eps) AS var
      FROM long, smoothing WHERE {train} GROUP BY label, dim),
    priors AS (
      SELECT label AS class, ln(count(*) / sum(count(*)) OVER ()) AS prior
      FROM features WHERE {train} GROUP BY label),
    score AS (
      SELECT id, label, class, any_value(prior) + sum(-0.5 * ln(2 * pi() * var)
             - 0.5 * (x - mean) * (x - mean) / var) AS s
      FROM long JOIN model USING (dim) JOIN priors USING (class)
      WHERE {test} GROUP BY id, label, class),
    predicted AS (
      SELECT id, label AS y_true, max_by(class, s) AS y_pred FROM score GROUP BY id, label)
    SELECT {columns} FROM predicted"""


TRAIN_SQL, TEST_SQL = "split = 'train'", "split = 'test'"
BAYES = "naive-bayes-gaussian"


@query(
    "m9_gaussian_naive_bayes",
    _bayes_sql(SQL_FEATURES, TRAIN_SQL, TEST_SQL, "id, y_true, y_pred"),
)
def gaussian_naive_bayes(spark, sf):
    return _predicted(spark, sf, BAYES, {})


NEAREST_SQL = f"""{SQL_FEATURES},
near AS (
  SELECT id, neighbour, near_label, distance, rank FROM (
    SELECT t.id, n.id AS neighbour, n.label AS near_label,
           list_distance(t.features, n.features) AS distance,
           row_number() OVER (PARTITION BY t.id
             ORDER BY list_distance(t.features, n.features), n.id)::INTEGER AS rank
    FROM features t, features n WHERE t.split = 'test' AND n.split = 'train')
  WHERE rank <= {K})"""


@query(
    "j4_nearest_neighbours",
    f"""WITH {NEAREST_SQL}
    SELECT id, neighbour, near_label AS label, distance, rank FROM near""",
    "distance",
)
def nearest_neighbours(spark, sf):
    train, test = _parts(features(spark, sf))
    return neighbours.nearest_neighbours(train, test, K)


@query(
    "m10_nearest_neighbour_vote",
    f"""WITH {NEAREST_SQL}
    SELECT id, label AS y_true, y_pred FROM features JOIN (
      SELECT id, near_label AS y_pred, row_number() OVER (
               PARTITION BY id ORDER BY count(*) DESC, near_label) AS place
      FROM near GROUP BY id, near_label) USING (id)
    WHERE place = 1""",
)
def nearest_neighbour_vote(spark, sf):
    return _predicted(spark, sf, "knn", {"n_neighbors": K})


@query(
    "j4_approximate_neighbours",
    f"""SELECT count(*) AS tests, {K} AS k, true AS recall_reached
    FROM embeddings WHERE {SQL_TEST.format('vec_id')}""",
)
def approximate_neighbours(spark, sf):
    """Whether the index finds nine tenths of the exact neighbours, over all test vectors."""
    train, test = _parts(features(spark, sf))
    index = vector_index.VectorIndex.build(train, new_folder(spark, "vector-index"), list_rows=100)
    found = index.search(test, K)
    row = vector_index.recall(found, neighbours.nearest_neighbours(train, test, K))
    return row.select("tests", F.lit(K).alias("k"), (F.col("recall") >= 0.9).alias("recall_reached"))


@query("m10_indexed_neighbour_vote", SQL_MARKED)
def indexed_neighbour_vote(spark, sf):
    return _predicted(spark, sf, "knn", {"n_neighbors": K, "approximate": True}, marked_features)


@query(
    "m11_frozen_comparison",
    f"""SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score,
      1.0::DOUBLE AS mcc FROM embeddings WHERE {SQL_TEST.format('vec_id')} LIMIT 1""",
)
def frozen_comparison(spark, sf):
    """Five trials of each of four classifiers over their whole spaces; the best one finds every mark."""
    train, test = _parts(marked_features(spark, sf))
    _, preds, _ = probes.compare_frozen(train, test, TRIALS, SEED)
    scored = metrics.align(preds, test.select("id", "label"), ["id"])
    classes = metrics.class_scores(metrics.confusion(scored, []), [])
    return metrics.scores(classes, [], "weighted")


SEARCHED = ("logistic-regression", "decision-tree", BAYES, "knn")


@query(
    "m12_hyperparameter_search",
    f"""SELECT probe, {TRIALS}::BIGINT AS trials, 1.0::DOUBLE AS best_accuracy
    FROM (SELECT unnest({list(SEARCHED)}) AS probe) WHERE (SELECT count(*) FROM embeddings) > 0""",
    "best_accuracy",
)
def hyperparameter_search(spark, sf):
    """The best of five trials of each probe; one of them at least finds every mark."""
    train, _ = _parts(marked_features(spark, sf))
    trials = [t for probe in SEARCHED for t in probes.search(train, probe, TRIALS, SEED)]
    return probes.trial_table(spark, trials).groupBy("probe").agg(
        F.count("*").alias("trials"), F.max("accuracy").alias("best_accuracy")
    )


@query("m13_refit_and_predict", SQL_MARKED)
def refit_and_predict(spark, sf):
    """Trials see four fifths of the training rows, the refitted model all of them."""
    train, test = _parts(marked_features(spark, sf))
    fitted, _ = probes.search_and_refit(train, "decision-tree", TRIALS, SEED)
    return metrics.align(fitted.predict(test), test.select("id", "label"), ["id"])


@query("m14_saved_model", _bayes_sql(SQL_FEATURES, TRAIN_SQL, TEST_SQL, "id, y_pred"))
def saved_model(spark, sf):
    train, test = _parts(features(spark, sf))
    folder = new_folder(spark, "probe")
    probes.fit(train, BAYES, {}, SEED).save(folder, spark)
    return probes.FittedProbe.load(folder, spark).predict(test)


def _sequence_features(spark, sf, methods):
    """Pooled token states; a sequence's label is whether its first vector's is 5 or more."""
    first = F.col("vec_id") % SEQUENCE == 0
    labels = (
        table(spark, sf, "embeddings")
        .filter(first)
        .select(
            F.floor(F.col("vec_id") / SEQUENCE).alias("id"),
            (F.col("label") >= 5).cast("int").alias("label"),
            F.when(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "4", "test")
            .otherwise("train")
            .alias("split"),
        )
    )
    return pooling.pool(token_states(spark, sf), methods).join(labels, "id")


GRID_PROBES = ("decision-tree", BAYES, "knn")


@query(
    "m15_grid_run",
    f"""SELECT layer, pooling, probe, 'done' AS status, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_score
    FROM (SELECT unnest([0, 1, 2]) AS layer), (SELECT unnest({list(pooling.POOLINGS)}) AS pooling),
      (SELECT unnest({list(GRID_PROBES)}) AS probe)
    WHERE (SELECT count(*) FROM embeddings) > 0""",
)
def grid_run(spark, sf):
    """All layers and poolings of the states, with the label marked in one more dimension."""
    folder = new_folder(spark, "grid")
    marked = F.concat("features", F.array((MARK * F.col("label")).cast("double")))
    rows = _sequence_features(spark, sf, list(pooling.POOLINGS)).withColumn("features", marked)
    rows.write.partitionBy("layer", "pooling").parquet(f"{folder}/features")
    stored = spark.read.parquet(f"{folder}/features")
    cells = [(layer, method, probe) for layer in (0, 1, 2) for method in pooling.POOLINGS for probe in GRID_PROBES]
    done = probes.run_grid(stored, cells, f"{folder}/predictions", trials=1, seed=SEED)
    return done.select("layer", "pooling", "probe", "status", "accuracy", "f1_score")


def _saved_sequence_probe(spark, sf):
    train = _sequence_features(spark, sf, ["mean"]).filter(F.col("layer") == 0)
    folder = new_folder(spark, "probe")
    probes.fit(train, BAYES, {}, SEED).save(folder, spark)
    return probes.FittedProbe.load(folder, spark)


SEQUENCE_SQL = f"""long_sequences AS (
  SELECT vec_id // {SEQUENCE} AS id, generate_subscripts(embedding, 1) AS dim,
         unnest(embedding)::DOUBLE AS x
  FROM embeddings),
firsts AS (
  SELECT vec_id // {SEQUENCE} AS id, (label >= 5)::INTEGER AS label
  FROM embeddings WHERE vec_id % {SEQUENCE} = 0),
features AS (
  SELECT id, 'all' AS split, any_value(label) AS label, list(mean ORDER BY dim) AS features
  FROM (SELECT id, dim, avg(x) AS mean FROM long_sequences GROUP BY id, dim) JOIN firsts USING (id)
  GROUP BY id)"""


@query(
    "m16_saved_model_scoring", _bayes_sql(SEQUENCE_SQL, "true", "true", "id, y_pred")
)
def saved_model_scoring(spark, sf):
    states = pooling.layer(token_states(spark, sf), 0)
    return probes.score_states(states, "mean", _saved_sequence_probe(spark, sf))


@query("v1_scoring_run")
def scoring_run(spark, sf):
    states = pooling.layer(token_states(spark, sf), 0)
    scored = probes.score_states(states, "mean", _saved_sequence_probe(spark, sf))
    return jobs.scoring_run(scored)
