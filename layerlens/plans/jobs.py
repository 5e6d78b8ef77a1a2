"""Jobs that run a caller's model over texts, and their run figures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import StringType

from layerlens.functions.text import words
from layerlens.operators.pooling import truncate_pad

PROBE_LENGTH = 128  # tokens per text when probing
TUNE_LENGTH = 256  # tokens per text when fine-tuning
STATES = "id long, layer int, states array<array<double>>"


def extract_states(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[list[str]]], np.ndarray]],
    length: int = PROBE_LENGTH,
    batch: int = 32,
) -> DataFrame:
    """Token states of every layer in one pass over the texts: (id, layer, states).

    `make_encoder` runs once per task and gives a function from a batch of token lists,
    all `length` long, to an array [batch, layer, position, dimension].
    """
    tokens = df.select("id", truncate_pad(words(F.col("text")), length).alias("tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                states = encoder(part.column("tokens").to_pylist())
                yield _state_rows(part.column("id").to_numpy(), states)

    return tokens.mapInArrow(encode, STATES)


def _state_rows(ids: np.ndarray, states: np.ndarray) -> pa.RecordBatch:
    """[batch, layer, position, dimension] as one row per text and layer, without copying
    single numbers."""
    texts, layers, positions, dims = states.shape
    values = pa.array(np.ascontiguousarray(states, dtype=np.float64).reshape(-1))
    vectors = pa.ListArray.from_arrays(
        np.arange(0, len(values) + 1, dims, dtype=np.int32), values
    )
    rows = pa.ListArray.from_arrays(
        np.arange(0, len(vectors) + 1, positions, dtype=np.int32), vectors
    )
    layer = np.tile(np.arange(layers, dtype=np.int32), texts)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids, layers)), pa.array(layer), rows], ["id", "layer", "states"]
    )


def generate(
    prompts: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch: int = 64,
) -> DataFrame:
    """Adds `answer`, what a caller's model says to the messages (as JSON) of each row."""
    ask = predict_batch_udf(make_predict, return_type=StringType(), batch_size=batch)
    return prompts.withColumn("answer", ask(F.to_json("messages")))


def scoring_run(scored: DataFrame, sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Runs a scoring job to its end; one row with rows, seconds and rates.

    Rows are counted inside the job. Rates are NaN when there was nothing to score.
    """
    seen = Observation()
    watched = scored.observe(seen, F.count(F.lit(1)).alias("rows"))
    started = time.perf_counter()
    if sink is None:
        watched.write.format("noop").mode("overwrite").save()
    else:
        sink(watched)
    seconds = time.perf_counter() - started
    rows = seen.get["rows"]
    row = (rows, seconds, seconds / rows if rows else float("nan"),
           rows / seconds if rows and seconds > 0 else float("nan"))
    return scored.sparkSession.createDataFrame(
        [row], "rows long, seconds double, seconds_per_row double, rows_per_second double"
    )
