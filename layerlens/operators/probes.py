"""Probe classifiers over pooled features, with search, refit, saving and scoring.

Feature tables have `id`, `features array<double>` and `label`; any integers will do, as a fit
numbers the distinct labels and gives them back in its predictions.
Training is MLlib's, or for boosted trees and perceptrons this package's own; the rows stay on
the executors, and only coefficients, trees and per-dimension statistics reach the driver.
"""

from __future__ import annotations

import json
import logging
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from layerlens.functions.draws import is_validation
from layerlens.operators import calibration, guided, metrics, neighbours
from layerlens.operators.boosting import BoostedTrees, Growth, fit as fit_boosted
from layerlens.operators.hinge import LinearMargins, fit as fit_margins
from layerlens.operators.kernels import KernelMargins, fit as fit_kernel
from layerlens.operators.perceptron import Perceptron, fit as fit_perceptron, gathered
from layerlens.operators.vector_index import VectorIndex
from layerlens.operators.pooling import pool, standardise
from layerlens.session import new_folder, written

log = logging.getLogger(__name__)

TOLERANCE = 1e-4  # where linear fits stop


@dataclass(frozen=True)
class TableFacts:
    """What estimators need to know about a training table."""

    rows: int
    labels: tuple[int, ...]  # distinct, in order
    dims: int
    variance: float  # over all entries of the feature matrix

    @property
    def classes(self) -> int:
        return len(self.labels)


def facts(train: DataFrame) -> TableFacts:
    """One pass; the result is one row with two numbers per dimension and the classes."""
    return _facts_in(train.agg(*_fact_columns()).first())


def _fact_columns() -> list[Column]:
    vector = array_to_vector(F.col("features"))
    summary = Summarizer.metrics("count", "mean", "variance").summary(vector)
    return [summary.alias("s"), F.sort_array(F.collect_set("label")).alias("labels")]


def _facts_in(row: Row) -> TableFacts:
    n, means, spread = row.s["count"], row.s["mean"].toArray(), row.s["variance"].toArray()
    variance = float((spread * (n - 1) / n).mean() + means.var())
    return TableFacts(n, tuple(row.labels), len(means), variance)


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


# The ranges hyperparameters are drawn from.
SPACES = {
    "logistic-regression": lambda rng, f: {"C": _log_uniform(rng, 1e-4, 1e2)},
    "linear-svm": lambda rng, f: {"C": _log_uniform(rng, 1e-4, 1e2)},
    "mlp": lambda rng, f: {
        "hidden_layer_sizes": rng.choice([(64,), (128,), (64, 64), (128, 64)]),
        "alpha": _log_uniform(rng, 1e-4, 1e-1),
    },
    "non-linear-svm": lambda rng, f: {
        "C": _log_uniform(rng, 1e-4, 1e2),
        "kernel": rng.choice(["linear", "rbf", "poly", "sigmoid"]),
    },
    "decision-tree": lambda rng, f: {"max_depth": rng.randint(3, 30)},
    "random-forest": lambda rng, f: {
        "n_estimators": rng.randint(50, 200),
        "max_depth": rng.randint(3, 30),
    },
    "xgboost": lambda rng, f: {
        "n_estimators": rng.randint(50, 200),
        "learning_rate": _log_uniform(rng, 1e-4, 1.0),
    },
    "lightgbm": lambda rng, f: {
        "n_estimators": rng.randint(50, 200),
        "learning_rate": _log_uniform(rng, 1e-4, 1.0),
    },
    "naive-bayes-gaussian": lambda rng, f: {},
    "knn": lambda rng, f: {"n_neighbors": rng.randint(2, max(2, f.classes))},
}

# The ranges for classifiers on a frozen encoder's vectors.
FROZEN_SPACES = {
    "non-linear-svm": lambda rng, f: {
        "C": _log_uniform(rng, 1e-3, 1e2),
        "kernel": rng.choice(["linear", "rbf"]),
    },
    "logistic-regression": lambda rng, f: {"C": _log_uniform(rng, 1e-3, 1e2)},
    "mlp": lambda rng, f: {
        "hidden_layer_sizes": rng.choice([(50,), (100,), (50, 50)]),
        "alpha": _log_uniform(rng, 1e-4, 1e-1),
        "learning_rate_init": _log_uniform(rng, 1e-5, 1e-3),
        "max_iter": 500,
    },
    "lightgbm": lambda rng, f: {
        "num_leaves": rng.randrange(31, 70, 10),
        "learning_rate": _log_uniform(rng, 1e-3, 1e-1),
        "n_estimators": rng.randrange(100, 301, 100),
    },
}
PROBES = tuple(SPACES)


def draw_params(spaces: dict, probe: str, table: TableFacts, trials: int, seed: int) -> list[dict]:
    """Seeded hyperparameter draws, one per trial."""
    if probe not in spaces:
        raise ValueError(f"Unknown model type: {probe}")
    rng = random.Random(f"{seed}-{probe}")
    return [spaces[probe](rng, table) for _ in range(trials)]


def estimator(probe: str, params: dict, table: TableFacts, seed: int) -> Pipeline:
    """The MLlib estimator for a probe, reading `vector` and `target`."""
    columns = {"featuresCol": "vector", "labelCol": "target"}
    many = table.classes > 2

    def penalty() -> float:
        # C weighs the summed loss against the penalty; MLlib weighs the penalty against the mean.
        return 1.0 / (params["C"] * table.rows)

    if probe == "logistic-regression":
        stages = [
            LogisticRegression(
                **columns,
                regParam=penalty(),
                maxIter=1000,
                tol=TOLERANCE,
                standardization=False,
                family="multinomial" if many else "auto",
            )
        ]
    elif probe == "decision-tree":
        stages = [DecisionTreeClassifier(**columns, maxDepth=params["max_depth"], seed=seed)]
    elif probe == "random-forest":
        stages = [
            RandomForestClassifier(
                **columns,
                numTrees=params["n_estimators"],
                maxDepth=params["max_depth"],
                seed=seed,
            )
        ]
    elif probe == "naive-bayes-gaussian":
        stages = [NaiveBayes(**columns, modelType="gaussian")]
    else:
        raise ValueError(f"Unknown model type: {probe}")
    return Pipeline(stages=stages)


def as_vectors(df: DataFrame, labels: tuple[int, ...] | None = None) -> DataFrame:
    """MLlib columns next to the arrays; with the labels, each one's place among them too."""
    df = df.withColumn("vector", array_to_vector(F.col("features")))
    if labels is not None:
        place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
        df = df.withColumn("target", (F.when(place > 0, place) - 1).cast("double"))
    return df


#: Their fitted models hold a training summary and with it the session, which cannot be sent to
#: executors once the session has observed metrics. Stored and loaded, a model has none.
WITH_SUMMARY = frozenset(("logistic-regression",))


#: Probes trained here rather than by MLlib, and what their fitted models are stored as.
OWN = {
    "linear-svm": LinearMargins, "non-linear-svm": KernelMargins, "mlp": Perceptron, "xgboost": BoostedTrees,
    "lightgbm": BoostedTrees,
}
#: Of them, those whose trials take long inside one task.
ALONE = frozenset(("mlp", "xgboost", "lightgbm"))
Own = LinearMargins | KernelMargins | Perceptron | BoostedTrees | calibration.Calibrated


def fit_own(train: DataFrame, probe: str, params: dict, table: TableFacts, seed: int) -> Own:
    """Fits (id, features, label), whose labels are numbered by the table's order."""
    rows = _numbered(train, table)
    if probe == "linear-svm":
        return fit_margins(rows, table.dims, table.classes, params["C"], seed=seed)
    if probe == "non-linear-svm":
        gamma = 1.0 / (table.dims * table.variance) if table.variance > 0 else 1.0
        return fit_kernel(rows, table.dims, table.classes, params["C"], params["kernel"], gamma, seed)
    if probe == "mlp":
        return fit_perceptron(
            rows, table.rows, table.dims, table.classes, tuple(params["hidden_layer_sizes"]),
            params.get("alpha", 1e-4), params.get("learning_rate_init", 1e-3), params.get("max_iter", 1000), seed,
        )
    if probe == "xgboost":
        return fit_boosted(rows, table.classes, Growth.by_levels(params))
    return fit_boosted(rows, table.classes, Growth.by_leaves(params), from_prior=True)


def _numbered(df: DataFrame, table: TableFacts) -> DataFrame:
    """(id, features, target): labels by their place among the table's."""
    place = F.array_position(F.array(*map(F.lit, table.labels)), F.col("label")) - 1
    return df.select("id", "features", place.cast("int").alias("target"))


def _sigmoids(train: DataFrame, probe: str, params: dict, table: TableFacts, seed: int):
    """Sigmoids for the scores of a probe, from rows that a fit on the others has not seen."""
    held_out = is_validation(F.col("id"), seed)
    model = fit_own(train.filter(~held_out), probe, params, table, seed)
    scored = _numbered(train.filter(held_out), table).withColumn("features", _of_vectors(model.scores))
    counts = {r.target: r.n for r in scored.groupBy("target").agg(F.count("*").alias("n")).collect()}
    return calibration.fit(scored, table.classes, [counts.get(c, 0) for c in range(table.classes)], seed)


def _of_vectors(measure):
    """A column of `features` to what measure(matrix) gives for each row."""

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            for start in range(0, len(vectors), 1024):
                yield pd.Series(list(measure(np.stack(vectors.iloc[start : start + 1024].to_list()))))

    return measured("features")


@dataclass
class FittedProbe:
    """A trained probe; nearest neighbours keep their training table or their index."""

    probe: str
    params: dict
    model: PipelineModel | None = None
    train: DataFrame | None = field(default=None, repr=False)
    labels: list[int] = field(default_factory=list)
    own: Own | None = field(default=None, repr=False)
    index: VectorIndex | None = field(default=None, repr=False)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """(id, probabilities): one for each of `labels`, in their order; null where a probe has none."""
        if hasattr(self.own, "probabilities"):
            found = df.select("id", _of_vectors(self.own.probabilities).alias("p"))
        elif self.model is not None and "probability" in (scored := self.model.transform(as_vectors(df))).columns:
            found = scored.select("id", vector_to_array("probability").alias("p"))
        else:
            return df.select("id", F.lit(None).cast("array<double>").alias("probabilities"))
        return found.select("id", F.slice("p", 1, len(self.labels)).alias("probabilities"))

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, y_pred) for every row."""
        if self.index is not None:
            return self.index.classify(df, self.params["n_neighbors"])
        if self.train is not None:
            return neighbours.classify(self.train, df, self.params["n_neighbors"])
        if self.own is not None:
            scores = F.slice(_of_vectors(self.own.scores), 1, len(self.labels))
            scored = df.select("id", scores.alias("s"))
            # The first label of equals.
            best = F.array_position("s", F.array_max("s")).cast("int")
            return scored.select("id", F.element_at(F.array(*map(F.lit, self.labels)), best).alias("y_pred"))
        scored = self.model.transform(as_vectors(df))
        # A model keeps room for two classes even where it saw one.
        label = F.try_element_at(F.array(*map(F.lit, self.labels)), F.col("prediction").cast("int") + 1)
        return scored.select("id", label.alias("y_pred"))

    def save(self, folder: str, spark: SparkSession) -> None:
        about = json.dumps({"probe": self.probe, "params": self.params, "labels": self.labels})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{folder}/about")
        if self.own is not None:
            spark.createDataFrame([(self.own.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{folder}/own")
        elif self.model is None:
            self.train.write.mode("overwrite").parquet(f"{folder}/train")
        else:
            self.model.write().overwrite().save(f"{folder}/model")

    @staticmethod
    def load(folder: str, spark: SparkSession) -> FittedProbe:
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        if about["probe"] == "knn":
            return _nearest(about["params"], spark.read.parquet(f"{folder}/train"))
        if about["probe"] in OWN:
            text = spark.read.text(f"{folder}/own").first()[0]
            kind = OWN[about["probe"]]
            own = calibration.Calibrated.from_json(text, kind) if "slopes" in json.loads(text) else kind.from_json(text)
            return FittedProbe(**about, own=own)
        return FittedProbe(**about, model=PipelineModel.load(f"{folder}/model"))


def _nearest(params: dict, train: DataFrame) -> FittedProbe:
    """Exact neighbours, or with `approximate` those of an index built now."""
    out = FittedProbe("knn", params, train=train)
    if params.get("approximate"):
        out.index = VectorIndex.build(train, new_folder(train.sparkSession, "vector-index"))
    return out


def fit(
    train: DataFrame, probe: str, params: dict, seed: int = 42, table: TableFacts | None = None
) -> FittedProbe:
    if probe == "knn":
        return _nearest(params, train.select("id", "features", "label"))
    table = table or facts(train)
    if probe in OWN:
        own = fit_own(train, probe, params, table, seed)
        if params.get("probability") and not hasattr(own, "probabilities"):
            own = calibration.Calibrated(own, *_sigmoids(train, probe, params, table, seed))
        return FittedProbe(probe, params, labels=list(table.labels), own=own)
    model = estimator(probe, params, table, seed).fit(as_vectors(train, table.labels))
    if probe in WITH_SUMMARY:
        folder = new_folder(train.sparkSession, "model")
        model.write().save(folder)
        model = PipelineModel.load(folder)
    return FittedProbe(probe, params, model=model, labels=list(table.labels))


def _in_threads(spark: SparkSession, work, items: list, parallelism: int) -> list:
    """Runs Spark jobs side by side; the scheduler shares the cluster between them."""
    with ThreadPool(max(1, min(parallelism, len(items) or 1))) as threads:
        return threads.map(inheritable_thread_target(spark)(work), items)


def search(
    train: DataFrame,
    probe: str,
    trials: int = 5,
    seed: int = 42,
    parallelism: int = 4,
    spaces: dict = SPACES,
    average: str = "macro",
    folder: str | None = None,
    metric: str = "accuracy",
) -> list[dict]:
    """Trials scored on a held-out fifth of the training rows, in trial order.

    Each has `trial`, `probe`, `params`, `accuracy` and `f1_score`. The first ones are seeded
    draws, run side by side; from guided.STARTUP on each is proposed from the `metric` of all
    before it. With a shared `folder` every trial is stored as it ends, and a later search of
    the same probe and seed takes the stored ones up and goes on after them.
    """
    held_out = is_validation(F.col("id"), seed)
    fit_rows, validation = train.filter(~held_out), train.filter(held_out)
    table = facts(fit_rows)

    def run(numbered):
        trial, params = numbered
        preds = fit(fit_rows, probe, params, seed, table).predict(validation)
        truth = validation.select("id", "label")
        cells = metrics.confusion(metrics.align(preds, truth, ["id"]), [])
        row = metrics.scores(metrics.class_scores(cells, []), [], average).first()
        done = {
            "trial": trial,
            "probe": probe,
            "params": params,
            "accuracy": row.accuracy,
            "f1_score": row.f1_score,
        }
        if folder is not None:
            _store_trial(train.sparkSession, done, seed, folder)
        return done

    stored = {} if folder is None else _stored_trials(train.sparkSession, probe, seed, folder)
    drawn = draw_params(spaces, probe, table, min(trials, guided.STARTUP), seed)
    first = [(i, params) for i, params in enumerate(drawn) if i not in stored]
    for trial in _in_threads(train.sparkSession, run, first, parallelism):
        stored[trial["trial"]] = trial
    for i in range(len(drawn), trials):
        if i not in stored:
            rng = random.Random(f"{seed}-{probe}-{i}")
            candidates = [spaces[probe](rng, table) for _ in range(guided.CANDIDATES)]
            params = guided.propose(candidates, [stored[j] for j in range(i)], metric)
            stored[i] = run((i, params))
    return [stored[i] for i in range(trials)]


STORED = "seed long, trial int, probe string, params string, accuracy double, f1_score double"


def _store_trial(spark: SparkSession, trial: dict, seed: int, folder: str) -> None:
    """One row under the trial's own name, so that a repeated trial replaces itself."""
    row = (seed, trial["trial"], trial["probe"], json.dumps(trial["params"]), trial["accuracy"], trial["f1_score"])
    path = f"{folder}/{trial['probe']}-{seed}-{trial['trial']}"
    spark.createDataFrame([row], STORED).coalesce(1).write.mode("overwrite").parquet(path)


def _stored_trials(spark: SparkSession, probe: str, seed: int, folder: str) -> dict[int, dict]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    whole = hadoop.Path(f"{folder}/{probe}-{seed}-*/_SUCCESS")
    found = whole.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(whole) or []
    if not len(found):
        return {}
    paths = [f.getPath().getParent().toString() for f in found]
    rows = spark.read.schema(STORED).parquet(*paths).drop("seed").collect()
    return {r.trial: {**r.asDict(), "params": json.loads(r.params)} for r in rows}


TRIALS = "trial int, probe string, params map<string,string>, accuracy double, f1_score double"


def trial_table(spark: SparkSession, trials: list[dict]) -> DataFrame:
    rows = [{**t, "params": {k: str(v) for k, v in t["params"].items()}} for t in trials]
    return spark.createDataFrame(rows, TRIALS)


def best_trial(trials: list[dict], metric: str = "accuracy") -> dict:
    """The trial with the highest metric; the first one wins ties."""
    return max(trials, key=lambda t: t[metric])


def search_and_refit(
    train: DataFrame, probe: str, trials: int = 5, seed: int = 42, parallelism: int = 4
) -> tuple[FittedProbe, list[dict]]:
    """The best trial's probe, trained again on all training rows, and all trials."""
    done = search(train, probe, trials, seed, parallelism)
    return fit(train, probe, best_trial(done)["params"], seed), done


def compare_frozen(
    train: DataFrame,
    test: DataFrame,
    trials: int = 5,
    seed: int = 42,
    spaces: dict = FROZEN_SPACES,
    parallelism: int = 4,
) -> tuple[FittedProbe, DataFrame, DataFrame]:
    """Four kinds of classifiers on standardised vectors, kept by weighted F1.

    Gives the winner refitted on all training rows, its test predictions and the trials.
    """
    scaled = written(standardise(train, train), "scaled")  # each trial reads it several times
    table = facts(scaled)
    each = max(1, parallelism // max(len(spaces), 1))

    def of_probe(probe):
        # A trial inside one task is few jobs, which cost the driver little.
        alone = probe in ALONE and gathered(table.rows * table.dims)
        return search(scaled, probe, trials, seed, parallelism if alone else each, spaces, "weighted")

    searched = _in_threads(train.sparkSession, of_probe, list(spaces), parallelism)
    done = [t for trials_of_probe in searched for t in trials_of_probe]
    winner = best_trial(done, "f1_score")
    fitted = fit(scaled, winner["probe"], winner["params"], seed, table)
    return fitted, fitted.predict(standardise(train, test)), trial_table(train.sparkSession, done)


GRID_RESULT = (
    "layer int, pooling string, probe string, status string, error string, "
    "params map<string,string>, accuracy double, precision double, recall double, "
    "f1_score double, mcc double"
)


#: What tells the parts of a grid's features apart, and its cells.
PART, CELL = ["layer", "pooling"], ["layer", "pooling", "probe"]


def run_grid(
    features: DataFrame,
    cells: list[tuple[int, str, str]],
    folder: str,
    trials: int = 5,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """Searches, refits and scores every (layer, pooling, probe) cell.

    `features` has layer, pooling, split, id, features and label; stored partitioned by
    layer and pooling, a cell reads only its own part. Predictions are written per cell.
    A failing cell is logged and reported, the others go on.

    What all cells need alike is one job for the whole grid: the facts of its parts, the scores
    of a round of trials and those of the refitted probes. A cell only fits and predicts.
    """
    spark = features.sparkSession
    layers, poolings = ({cell[i] for cell in cells} for i in range(2))
    features = features.filter(F.col("layer").isin(*layers) & F.col("pooling").isin(*poolings))
    train, test = (features.filter(F.col("split") == split) for split in ("train", "test"))
    held_out = is_validation(F.col("id"), seed)
    fit_rows, validation = train.filter(~held_out), train.filter(held_out)
    of_trials, of_refits = _facts_of_parts(fit_rows), _facts_of_parts(train)
    trial_folder = new_folder(spark, "trials")
    found: dict[tuple, list[dict]] = {cell: [] for cell in cells}
    failed: dict[tuple, str] = {}

    def each(work) -> None:
        """Runs work(cell) for every cell that is left."""

        def tried(cell):
            try:
                work(cell)
            except Exception as problem:  # a bad cell must not stop the others
                fail(cell, problem)

        _in_threads(spark, tried, [c for c in found if c not in failed], parallelism)

    def fail(cell, problem) -> None:
        log.error("Cell %s failed", cell, exc_info=problem)
        failed[cell] = (str(problem) or type(problem).__name__).splitlines()[0]

    def of_part(rows: DataFrame, cell) -> DataFrame:
        return rows.filter((F.col("layer") == cell[0]) & (F.col("pooling") == cell[1]))

    def refit(cell, rows, known, params, ahead, where) -> FittedProbe:
        mine = of_part(rows, cell)
        fitted = fit(mine, cell[2], params, seed, known.get(cell[:2]) or facts(mine))
        fitted.predict(of_part(ahead, cell)).write.mode("overwrite").parquet(where)
        return fitted

    drawn = min(trials, guided.STARTUP)
    for trial_round in [range(drawn), *([i] for i in range(drawn, trials))]:
        asked: dict[tuple, dict] = {}

        def run_trials(cell):
            probe = cell[2]
            table = of_trials.get(cell[:2]) or facts(of_part(fit_rows, cell))
            draws = draw_params(SPACES, probe, table, drawn, seed)
            for i in trial_round:
                if i < drawn:
                    params = draws[i]
                else:
                    rng = random.Random(f"{seed}-{probe}-{i}")
                    candidates = [SPACES[probe](rng, table) for _ in range(guided.CANDIDATES)]
                    params = guided.propose(candidates, found[cell], "accuracy")
                refit(cell, fit_rows, of_trials, params, validation, _cell_path(f"{trial_folder}/trial={i}", cell))
                asked[i, *cell] = params

        each(run_trials)
        asked = {key: params for key, params in asked.items() if key[1:] not in failed}
        scored = _cell_scores(validation, trial_folder, list(asked), ["trial", *CELL])
        for key in sorted(asked, key=lambda key: key[0]):
            i, *cell = key
            if isinstance(scored[key], Exception):
                fail(tuple(cell), scored[key])
            else:
                known = {m: scored[key][m] for m in ("accuracy", "f1_score")}
                found[tuple(cell)].append({"trial": i, "probe": cell[2], "params": asked[key], **known})

    fitted: dict[tuple, dict] = {}

    def refit_best(cell):
        params = best_trial(found[cell])["params"]
        fitted[cell] = refit(cell, train, of_refits, params, test, _cell_path(folder, cell)).params
        if cell[:2] not in of_refits:
            of_refits[cell[:2]] = facts(of_part(train, cell))

    each(refit_best)
    done = [cell for cell in fitted if cell not in failed]
    many = {cell[:2]: of_refits[cell[:2]].classes > 2 for cell in done}
    scored = _cell_scores(test, folder, done, CELL, many)
    results = []
    for cell in cells:
        row = dict(zip(CELL, cell))
        if cell in done and isinstance(scored[cell], Exception):
            fail(cell, scored[cell])
        if cell in failed:
            results.append({**row, "status": "failed", "error": failed[cell]})
        else:
            params = {k: str(v) for k, v in fitted[cell].items()}
            results.append({**row, "status": "done", "params": params, **scored[cell]})
    return spark.createDataFrame(results, GRID_RESULT)


def _cell_path(folder: str, cell: tuple) -> str:
    return "/".join([folder, *(f"{name}={value}" for name, value in zip(CELL, cell))])


def _facts_of_parts(rows: DataFrame) -> dict[tuple, TableFacts]:
    """`facts` of every part in one pass; none where a part spoils it, so that each is looked at alone."""
    try:
        return {tuple(row[k] for k in PART): _facts_in(row) for row in rows.groupBy(*PART).agg(*_fact_columns()).collect()}
    except Exception:
        log.exception("The facts of all parts failed")
        return {}


def _cell_scores(
    truth: DataFrame, folder: str, keys: list[tuple], names: list[str], many: dict[tuple, bool] | None = None
) -> dict[tuple, dict | Exception]:
    """The metrics of the predictions stored under each key, which ends in a cell, or what failed.

    With `many`, macro where a part has more than two classes, else of class 1; without, macro.
    All keys are scored in one pass; if that fails, each one alone.
    """
    if not keys:
        return {}
    spark = truth.sparkSession
    kinds = {"trial": "int", "layer": "int", "pooling": "string", "probe": "string"}
    try:
        paths = [_cell_path("/".join([folder, *(f"trial={i}" for i in key[:-3])]), key[-3:]) for key in keys]
        schema = ", ".join(["id long", "y_pred int", *(f"{n} {kinds[n]}" for n in names)])
        preds = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
        pairs = metrics.align(preds, truth.select(*PART, "id", "label"), [*PART, "id"])
        classes = metrics.class_scores(metrics.confusion(pairs, names), names)
        if many is None:
            table = metrics.scores(classes, names, "macro")
        else:
            tasks = spark.createDataFrame([(*part, m) for part, m in many.items()], "layer int, pooling string, multi_class boolean")
            table = metrics.scores_by_task(classes, names, tasks)
        found = {tuple(r[n] for n in names): {m: r[m] for m in metrics.METRICS} for r in table.collect()}
    except Exception as problem:
        if len(keys) == 1:
            return {keys[0]: problem}
        return {k: v for key in keys for k, v in _cell_scores(truth, folder, [key], names, many).items()}
    return {key: found.get(key, ValueError("No row to score")) for key in keys}


def score_states(states: DataFrame, pooling: str, fitted: FittedProbe) -> DataFrame:
    """Token states to predictions with a saved probe."""
    return fitted.predict(pool(states, [pooling]))


def best_of_trials(
    trials: DataFrame, by: list[str], metric: str, ties: list[str]
) -> DataFrame:
    """The best trial per group from a trial table; the lowest `ties` columns win ties."""
    order = F.struct((-F.col(metric)).alias("order"), *ties)
    whole = F.min_by(F.struct(*[c for c in trials.columns if c not in by]), order)
    return trials.groupBy(*by).agg(whole.alias("t")).select(*by, "t.*")
