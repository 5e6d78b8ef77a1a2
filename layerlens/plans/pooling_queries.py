"""Token truncation, pooling of token states, feature scaling, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlens.functions.text import words
from layerlens.operators import metrics, pooling, prompts
from layerlens.plans import jobs
from layerlens.plans.inputs import (
    ENCODER_DIMS,
    ENCODER_LAYERS,
    LAYERS,
    SEQUENCE,
    SQL_FEATURES,
    SQL_STATES,
    SQL_TEXTS,
    all_texts,
    features,
    long_features,
    make_digest_encoder,
    make_word_rule,
    sql_words,
    table,
    token_states,
)
from layerlens.plans.registry import query

WORDS = sql_words()

# Tokens ------------------------------------------------------------------------------


def _padded_sql(length: int) -> str:
    tokens = f"({WORDS})[1:{length}]"
    return f"""WITH {SQL_TEXTS}
    SELECT id, {length}::INTEGER AS length, least(len({WORDS}), {length})::INTEGER AS n_tokens,
           array_to_string(list_concat({tokens},
             list_transform(range({length} - len({tokens})), lambda i: '<pad>')), ' ') AS tokens
    FROM texts"""


for _name, _length in (("probing", jobs.PROBE_LENGTH), ("tuning", jobs.TUNE_LENGTH)):

    @query(f"f1_truncate_pad_{_name}", _padded_sql(_length))
    def truncate_pad(spark, sf, length=_length):
        split = all_texts(spark, sf).select("id", words(F.col("text")).alias("w"))
        mask = pooling.attention_mask(F.col("w"), length)
        return split.select(
            "id",
            F.lit(length).alias("length"),
            F.aggregate(mask, F.lit(0), lambda acc, m: acc + m).alias("n_tokens"),
            F.array_join(pooling.truncate_pad(F.col("w"), length), " ").alias("tokens"),
        )


# Pooling -----------------------------------------------------------------------------

POOLED_SQL = {
    "mean": "SELECT id, layer, dim, avg(value) AS value FROM states GROUP BY ALL",
    "last-token": "SELECT id, layer, dim, max_by(value, pos) AS value FROM states GROUP BY ALL",
    "max": "SELECT id, layer, dim, max(value) AS value FROM states GROUP BY ALL",
    "min": "SELECT id, layer, dim, min(value) AS value FROM states GROUP BY ALL",
    "concat-mean-max-min": """
      SELECT id, layer, dim, avg(value) AS value FROM states GROUP BY ALL
      UNION ALL SELECT id, layer, dim + 64, max(value) FROM states GROUP BY ALL
      UNION ALL SELECT id, layer, dim + 128, min(value) FROM states GROUP BY ALL""",
    "attention": """
      SELECT id, layer, dim, sum(value * weight) AS value
      FROM states JOIN (
        SELECT id, layer, pos, exp(score) / sum(exp(score)) OVER (PARTITION BY id, layer) AS weight
        FROM (SELECT id, layer, pos, avg(value) AS score FROM states GROUP BY ALL))
      USING (id, layer, pos) GROUP BY id, layer, dim""",
}
_NAMES = {
    "mean": "f2_mean_pooling",
    "last-token": "f3_last_token_pooling",
    "max": "f4_max_pooling",
    "min": "f5_min_pooling",
    "concat-mean-max-min": "f6_concat_pooling",
    "attention": "f7_attention_pooling",
}

for _method, _query in _NAMES.items():

    @query(
        _query,
        f"""WITH {SQL_STATES}
        SELECT id, layer, '{_method}' AS pooling, dim::INTEGER AS dim, value
        FROM ({POOLED_SQL[_method]})""",
        "value",
    )
    def one_pooling(spark, sf, method=_method):
        pooled = pooling.pool(token_states(spark, sf), [method])
        return long_features(pooled, "id", "layer", "pooling")


@query(
    "f8_masked_mean_pooling",
    f"""WITH {SQL_STATES}
    SELECT id, layer, dim::INTEGER AS dim, avg(value) AS value FROM states
    WHERE pos < 1 + id % {SEQUENCE} GROUP BY id, layer, dim""",
    "value",
)
def masked_mean_pooling(spark, sf):
    """Sequence i keeps its first 1 + i % 8 tokens."""
    kept = F.col("id") % SEQUENCE
    mask = F.transform("states", lambda _, pos: (pos <= kept).cast("int"))
    pooled = pooling.masked_mean_pool(F.col("states"), mask)
    return long_features(
        token_states(spark, sf).withColumn("features", pooled), "id", "layer"
    )


@query(
    "f9_pooling_dispatch",
    f"""WITH {SQL_STATES}, pooled AS (
      {" UNION ALL ".join(
        f"SELECT id, layer, '{m}' AS pooling, dim, value FROM ({s})" for m, s in POOLED_SQL.items())})
    SELECT id, layer, pooling, dim::INTEGER AS dim, value FROM pooled""",
    "value",
)
def pooling_dispatch(spark, sf):
    pooled = pooling.pool(token_states(spark, sf), pooling.POOLINGS)
    return long_features(pooled, "id", "layer", "pooling")


def _long_states(df, *keys):
    tokens = df.select(*keys, F.posexplode("states").alias("pos", "v"))
    return tokens.select(*keys, "pos", F.posexplode("v").alias("dim", "value"))


@query(
    "f10_layer_select",
    f"""WITH {SQL_STATES}
    SELECT id, layer, pos::INTEGER AS pos, dim::INTEGER AS dim, value FROM states WHERE layer = 1""",
    "value",
)
def layer_select(spark, sf):
    return _long_states(pooling.layer(token_states(spark, sf), 1), "id", "layer")


@query(
    "p8_depth_cutoff",
    f"""WITH {SQL_STATES}
    SELECT id, layer, layer = least({LAYERS}, 2) - 1 AS is_last, sum(value) AS total
    FROM states WHERE layer < 2 GROUP BY id, layer""",
    "total",
)
def depth_cutoff(spark, sf):
    kept = pooling.first_layers(token_states(spark, sf), 2)
    total = F.aggregate(F.flatten("states"), F.lit(0.0), lambda acc, x: acc + x)
    return kept.select("id", "layer", "is_last", total.alias("total"))


@query(
    "f11_standardised_features",
    f"""WITH {SQL_FEATURES},
    long AS (
      SELECT id, split, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS dim
      FROM features),
    stats AS (
      SELECT dim, avg(x) AS mean, stddev_pop(x) AS dev FROM long WHERE split = 'train' GROUP BY dim)
    SELECT id, split, dim::INTEGER AS dim,
           CASE WHEN dev > 0 THEN (x - mean) / dev ELSE x - mean END AS value
    FROM long JOIN stats USING (dim)""",
    "value",
)
def standardised_features(spark, sf):
    rows = features(spark, sf)
    scaled = pooling.standardise(rows.filter(F.col("split") == "train"), rows)
    return long_features(scaled, "id", "split")


@query(
    "f12_class_count",
    f"""WITH {SQL_FEATURES}
    SELECT split, count(DISTINCT label) AS n_classes FROM features GROUP BY split""",
)
def class_count(spark, sf):
    return pooling.class_count(features(spark, sf), ["split"])


@query(
    "e1_state_extraction",
    f"""WITH {SQL_TEXTS},
    padded AS (
      SELECT id, unnest(list_concat(({WORDS})[1:{jobs.PROBE_LENGTH}],
        list_transform(range({jobs.PROBE_LENGTH} - len(({WORDS})[1:{jobs.PROBE_LENGTH}])),
                       lambda i: '<pad>'))) AS token
      FROM texts),
    codes AS (SELECT id, ('0x' || substr(md5(token), 1, 8))::BIGINT AS code FROM padded)
    SELECT id, l::INTEGER AS layer, d::INTEGER AS dim,
           avg(((code >> (8 * d)) & 255) / 256.0 * (l + 1)) AS value
    FROM codes, range({ENCODER_LAYERS}) a(l), range({ENCODER_DIMS}) b(d)
    GROUP BY id, l, d""",
    "value",
)
def state_extraction(spark, sf):
    """Texts to token states of all layers in one pass, shown as their means."""
    states = jobs.extract_states(all_texts(spark, sf), make_digest_encoder)
    return long_features(pooling.pool(states, ["mean"]).drop("pooling"), "id", "layer")


# Prompts -----------------------------------------------------------------------------


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(prompt_types, task: str) -> str:
    selects = []
    for kind in prompt_types:
        for turn, role in enumerate(prompts.ROLES):
            before, hole, after = prompts.template(kind, role, task).partition("{text}")
            content = _literal(before)
            if hole:
                content += f" || text || {_literal(after)}"
            selects.append(
                f"SELECT id, {_literal(kind)} AS prompt_type, {turn}::INTEGER AS turn, "
                f"{_literal(role)} AS role, {content} AS content FROM texts"
            )
    return " UNION ALL ".join(selects)


def _prompt_rows(df, prompt_types, task):
    built = prompts.build(df, prompt_types, task)
    turns = built.select("id", "prompt_type", F.posexplode("messages").alias("turn", "m"))
    return turns.select("id", "prompt_type", "turn", "m.role", "m.content")


def _benchmark_texts(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


SQL_ITEMS = "texts AS (SELECT item_id AS id, text FROM benchmark)"

for _query, _kind in (
    ("e2_zero_shot_prompts", "Zero-Shot"),
    ("e3_few_shot_prompts", "Few-Shot"),
    ("e4_step_by_step_prompts", "CoT"),
):
    for _task in prompts.TASKS:

        @query(f"{_query}_{_task}", f"WITH {SQL_ITEMS} {_prompt_sql([_kind], _task)}")
        def one_prompt(spark, sf, kind=_kind, task=_task):
            return _prompt_rows(_benchmark_texts(spark, sf), [kind], task)


@query(
    "e5_prompt_dispatch",
    f"WITH {SQL_TEXTS} {_prompt_sql(prompts.PROMPT_TYPES, 'binary')}",
)
def prompt_dispatch(spark, sf):
    return _prompt_rows(all_texts(spark, sf), prompts.PROMPT_TYPES, "binary")


@query(
    "e6_batch_generation",
    f"""WITH {SQL_TEXTS}
    SELECT id, prompt_type, CASE WHEN contains(text, ' der ') THEN '1' ELSE '0' END AS answer,
           CASE WHEN contains(text, ' der ') THEN 1 ELSE 0 END::INTEGER AS y_pred
    FROM texts, (VALUES ('Zero-Shot'), ('CoT')) p(prompt_type)""",
)
def batch_generation(spark, sf):
    built = prompts.build(all_texts(spark, sf), ["Zero-Shot", "CoT"], "binary")
    answered = jobs.generate(built.select("id", "prompt_type", "messages"), make_word_rule)
    return answered.select(
        "id", "prompt_type", "answer", prompts.answer_label(F.col("answer"), "binary").alias("y_pred")
    )


@query(
    "e7_binary_answers",
    """SELECT doc_id AS id, CASE WHEN contains(text, '1') THEN 1 ELSE 0 END::INTEGER AS y_pred
    FROM documents""",
)
def binary_answers(spark, sf):
    """Whole documents taken as answers; any `1` in one counts."""
    label = prompts.answer_label(F.col("text"), "binary")
    return all_texts(spark, sf).select("id", label.alias("y_pred"))


@query(
    "e8_emotion_answers",
    r"""WITH answers AS (
      SELECT conv_id, turn, CASE role WHEN 'user' THEN concat(' ', turn, chr(10)) WHEN 'system' THEN text
                            ELSE concat(turn * 5, ' ') END AS answer
      FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_full_match(trim(answer, ' ' || chr(10)), '[0-5]')
                          THEN trim(answer, ' ' || chr(10))::INTEGER ELSE -1 END AS y_pred
    FROM answers""",
)
def emotion_answers(spark, sf):
    """Answers made from each turn: its number with blanks, five times it, or its text."""
    turn, role = F.col("turn"), F.col("role")
    answer = (
        F.when(role == "user", F.concat(F.lit(" "), turn.cast("string"), F.lit("\n")))
        .when(role == "system", F.col("text"))
        .otherwise(F.concat((turn * 5).cast("string"), F.lit(" ")))
    )
    label = prompts.answer_label(answer, "emotion")
    return table(spark, sf, "conversations").select("conv_id", "turn", label.alias("y_pred"))
