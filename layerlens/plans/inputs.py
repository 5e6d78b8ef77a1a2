"""The input tables of the registered queries, in Spark and as SQL.

All of them are whole driver tables or follow from them row by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerlens.functions.draws import hex_number, is_validation
from layerlens.functions.text import STOP_WORDS
from layerlens.operators import metrics
from layerlens.session import spread

LAYERS = 3
POOLINGS = ("mean", "max")
PROBES = ("knn", "linear-svm", "naive_bayes")
PROMPT_TYPES = ("Zero-Shot", "Few-Shot", "CoT")
KEYS = ["dataset", "layer", "pooling", "probe"]


# Given schemas save a look into the files for every read.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# Texts -------------------------------------------------------------------------------

SQL_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
SQL_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def sql_words(text: str = "text") -> str:
    return f"list_filter(string_split_regex({text}, '{SQL_SPACE}'), lambda w: w <> '')"


def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents: id, lang, source, text, label, split."""
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    test = is_validation(F.col("doc_id"), 7)
    return joined.select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        "text",
        F.col("quality").alias("label"),
        F.when(test, "test").otherwise("train").alias("split"),
    )


SQL_TEST = "substr(md5(concat({0}, '-7')), 1, 8) < '33333333'"
SQL_LABELLED = f"""labelled AS (
  SELECT doc_id AS id, lang, source, text, quality AS label,
         CASE WHEN {SQL_TEST.format('doc_id')} THEN 'test' ELSE 'train' END AS split
  FROM documents JOIN labels USING (doc_id))"""


def incomplete_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; those without a label lack it, very short ones lack their text."""
    labels = table(spark, sf, "labels")
    return documents(spark, sf).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("dataset"),
        F.when(F.col("n_chars") >= 100, F.col("text")).alias("text"),
        F.col("quality").alias("label"),
    )


SQL_INCOMPLETE = """incomplete AS (
  SELECT doc_id AS id, lang AS dataset, CASE WHEN n_chars >= 100 THEN text END AS text,
         quality AS label
  FROM documents LEFT JOIN labels USING (doc_id))"""


def dataset_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, one dataset per language, labelled by their source."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("dataset"),
        "text",
        F.col("source").alias("label"),
    )


SQL_DATASETS = """texts AS (
  SELECT doc_id AS id, lang AS dataset, text, source AS label FROM documents)"""


def all_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one dataset, labelled by language."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")
    )


SQL_TEXTS = "texts AS (SELECT doc_id AS id, text, lang AS label FROM documents)"

# Predictions -------------------------------------------------------------------------


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Two labelled datasets: `quality` with two classes, `lang` with four."""
    quality = spread(table(spark, sf, "labels")).select(
        F.lit("quality").alias("dataset"), F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    lang = F.col("lang")
    number = F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3)
    languages = documents(spark, sf).select(
        F.lit("lang").alias("dataset"), F.col("doc_id").alias("id"), number.alias("label")
    )
    return quality.unionByName(languages)


SQL_TRUTH = """truth AS (
  SELECT 'quality' AS dataset, doc_id AS id, quality AS label FROM labels
  UNION ALL
  SELECT 'lang', doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END
  FROM documents)"""


def _shifted(name: Column, limit: Column) -> Column:
    """The label, or another class for rows whose digest's first digit is below the limit."""
    noise = hex_number(F.md5(name), 1).cast("int")
    classes = F.when(F.col("dataset") == "quality", 2).otherwise(4)
    moved = (F.col("label") + 1 + noise % (classes - 1)) % classes
    return F.when(noise < limit, moved).otherwise(F.col("label"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of three probes for two poolings of three layers, for every true label."""
    strings = lambda values: F.array(*map(F.lit, values))
    limit = (
        F.lit(2)
        + F.col("layer")
        + F.array_position(strings(PROBES), F.col("probe")).cast("int")
        + (F.col("pooling") == "max").cast("int")
    )
    name = F.concat_ws("|", "dataset", "id", "layer", "pooling", "probe")
    return (
        truth(spark, sf)
        .withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))))
        .withColumn("pooling", F.explode(strings(POOLINGS)))
        .withColumn("probe", F.explode(strings(PROBES)))
        .select(*KEYS, "id", _shifted(name, limit).alias("y_pred"))
    )


SQL_PREDICTIONS = SQL_TRUTH + """, noisy AS (
  SELECT dataset, layer, pooling, probe, id, label,
         CASE dataset WHEN 'quality' THEN 2 ELSE 4 END AS k,
         ('0x' || substr(md5(concat_ws('|', dataset, id, layer, pooling, probe)), 1, 1))::INTEGER AS noise,
         2 + layer + CASE probe WHEN 'knn' THEN 1 WHEN 'linear-svm' THEN 2 ELSE 3 END
           + CASE pooling WHEN 'max' THEN 1 ELSE 0 END AS lim
  FROM truth, (VALUES (0), (1), (2)) a(layer), (VALUES ('mean'), ('max')) b(pooling),
       (VALUES ('knn'), ('linear-svm'), ('naive_bayes')) c(probe)),
preds AS (
  SELECT dataset, layer, pooling, probe, id,
         CASE WHEN noise < lim THEN (label + 1 + noise % (k - 1)) % k ELSE label END AS y_pred
  FROM noisy),
aligned AS (
  SELECT dataset, layer, pooling, probe, id, y_pred, label AS y_true
  FROM preds JOIN truth USING (dataset, id))"""


def prompt_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of three prompt types; -1 where a language answer was not understood."""
    types = F.array(*map(F.lit, PROMPT_TYPES))
    name = F.concat_ws("|", "dataset", "id", "prompt_type")
    limit = F.lit(1) + 2 * F.array_position(types, F.col("prompt_type")).cast("int")
    answer = F.when(
        (F.col("dataset") == "lang") & (hex_number(F.md5(name), 1) == 0), -1
    ).otherwise(_shifted(name, limit))
    return (
        truth(spark, sf)
        .withColumn("prompt_type", F.explode(types))
        .select("dataset", "prompt_type", "id", answer.alias("y_pred"))
    )


SQL_PROMPT_PREDICTIONS = SQL_TRUTH + """, noisy AS (
  SELECT dataset, prompt_type, id, label, CASE dataset WHEN 'quality' THEN 2 ELSE 4 END AS k,
         ('0x' || substr(md5(concat_ws('|', dataset, id, prompt_type)), 1, 1))::INTEGER AS noise,
         CASE prompt_type WHEN 'Zero-Shot' THEN 3 WHEN 'Few-Shot' THEN 5 ELSE 7 END AS lim
  FROM truth, (VALUES ('Zero-Shot'), ('Few-Shot'), ('CoT')) a(prompt_type)),
preds AS (
  SELECT dataset, prompt_type, id,
         CASE WHEN dataset = 'lang' AND noise = 0 THEN -1
              WHEN noise < lim THEN (label + 1 + noise % (k - 1)) % k ELSE label END AS y_pred
  FROM noisy),
aligned AS (
  SELECT dataset, prompt_type, id, y_pred, label AS y_true
  FROM preds JOIN truth USING (dataset, id))"""


def sql_scores(keys: str, average: str) -> str:
    """CTEs from `aligned` to `scored`, metrics per key; average as in metrics.scores."""
    means = {
        "binary": "coalesce(max({0}) FILTER (WHERE class = 1), 0.0)",
        "macro": "avg({0})",
        "weighted": "sum(support * {0}) / sum(support)",
        "auto": "CASE WHEN any_value(multi) THEN avg({0}) "
        "ELSE coalesce(max({0}) FILTER (WHERE class = 1), 0.0) END",
    }
    columns = ", ".join(
        f"{means[average].format(m)} AS {m}" for m in ("precision", "recall", "f1_score")
    )
    return f"""cells AS (
  SELECT {keys}, y_true, y_pred, count(*) AS n FROM aligned GROUP BY ALL),
classes AS (
  SELECT {keys}, class, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted,
         sum(hits)::DOUBLE AS hits
  FROM (SELECT {keys}, y_true AS class, n AS support, 0 AS predicted,
               CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hits FROM cells
        UNION ALL SELECT {keys}, y_pred, 0, n, 0 FROM cells)
  GROUP BY {keys}, class),
per_class AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1_score
  FROM classes LEFT JOIN (
    SELECT dataset, count(DISTINCT label) > 2 AS multi FROM truth GROUP BY dataset) USING (dataset)),
scored AS (
  SELECT {keys}, sum(hits) / sum(support) AS accuracy, {columns},
         CASE WHEN (sum(support) ^ 2 - sum(predicted * predicted))
                   * (sum(support) ^ 2 - sum(support * support)) > 0
              THEN (sum(hits) * sum(support) - sum(support * predicted))
                   / sqrt((sum(support) ^ 2 - sum(predicted * predicted))
                          * (sum(support) ^ 2 - sum(support * support)))
              ELSE 0 END AS mcc
  FROM per_class GROUP BY {keys})"""


SQL_RESULTS = SQL_PREDICTIONS + ", " + sql_scores("dataset, layer, pooling, probe", "auto")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.align(predictions(spark, sf), truth(spark, sf), ["dataset", "id"])


def results(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation result table: metrics per dataset, layer, pooling and probe."""
    return metrics.evaluate(predictions(spark, sf), truth(spark, sf), ["dataset", "id"], KEYS)


# Vectors -----------------------------------------------------------------------------

SEQUENCE = 8


def token_states(spark: SparkSession, sf: str) -> DataFrame:
    """Eight neighbouring vectors as the tokens of one text, seen at three layers."""
    vectors = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / SEQUENCE).alias("id"),
        (F.col("vec_id") % SEQUENCE).alias("pos"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    grouped = vectors.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("tokens")
    )
    layer = F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1)))
    seen = F.transform(
        F.col("tokens"),
        lambda t: F.transform(t["v"], lambda x: x * (F.col("layer") + 1) + F.col("layer") * 0.1),
    )
    return grouped.withColumn("layer", layer).select("id", "layer", seen.alias("states"))


SQL_STATES = f"""vectors AS (
  SELECT vec_id // {SEQUENCE} AS id, vec_id % {SEQUENCE} AS pos, unnest(embedding)::DOUBLE AS x,
         generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings),
states AS (
  SELECT id, layer, pos, dim, x * (layer + 1) + layer * 0.1 AS value
  FROM vectors, (VALUES (0), (1), (2)) l(layer))"""


def long_features(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("features").alias("dim", "value"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as pooled features, with ten classes and a train/test split."""
    test = is_validation(F.col("vec_id"), 7)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
        F.when(test, "test").otherwise("train").alias("split"),
    )


SQL_FEATURES = f"""features AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS features, label,
         CASE WHEN {SQL_TEST.format('vec_id')} THEN 'test' ELSE 'train' END AS split
  FROM embeddings)"""


MARK = 4.0


def marked_features(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors with their label marked in further dimensions: one for each label and one that
    grows with it. Whatever separates classes at all must find every label again."""
    marks = [F.when(F.col("label") == c, MARK).otherwise(0.0) for c in range(10)]
    own = F.array(*marks, F.col("label").cast("double"))
    return features(spark, sf).withColumn("features", F.concat("features", own))


#: What any right classifier gives on marked features.
SQL_MARKED = f"""SELECT vec_id AS id, label AS y_true, label AS y_pred FROM embeddings
WHERE {SQL_TEST.format('vec_id')}"""


def two_classes(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("label") >= 5).cast("int"))


# Encoder -----------------------------------------------------------------------------

ENCODER_LAYERS, ENCODER_DIMS = 2, 4


def make_digest_encoder():
    """An encoder without weights: a token's vector is made of the bytes of its digest."""
    codes: dict[str, int] = {}

    def code(token: str) -> int:
        if token not in codes:
            codes[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        return codes[token]

    def encode(batch: list[list[str]]) -> np.ndarray:
        numbers = np.array([[code(t) for t in tokens] for tokens in batch], dtype=np.int64)
        parts = (numbers[:, :, None] >> (8 * np.arange(ENCODER_DIMS))) & 255
        base = parts / 256.0
        return np.stack([base * (layer + 1) for layer in range(ENCODER_LAYERS)], axis=1)

    return encode


def make_word_rule():
    """A model without weights: it answers 1 when the prompt holds the word `der`."""

    def predict(prompts: np.ndarray) -> np.ndarray:
        return np.array(["1" if " der " in p else "0" for p in prompts], dtype=object)

    return predict
