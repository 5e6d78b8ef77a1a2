"""What several operators share: inputs, word splitting and stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}

# The white space of the word contract, [\x20\x09-\x0D].
WHITE = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null id while rows are linked: it sorts before every other id.
NO_ID = -(2**63)

# Odd multipliers for combining word hashes; the 64-bit golden ratio and two primes.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that a function is given at once, about.
PIECE_BYTES = 1 << 22


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes and a row at least, none of them empty.

    What a function makes of a slice is gone before the next, and what the batch itself took goes
    back to the machine with its last slice: idle Python workers hold little memory.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema):
    """`mapInArrow` for a function of rows that need not know of each other."""

    def run(batches):
        for piece in pieces(batches):
            yield from fn(piece)

    return df.mapInArrow(run, schema)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their high bits can be used as a draw."""
    values = values ^ (values >> np.uint64(29))
    values = values * _MIX[1]
    values = values ^ (values >> np.uint64(32))
    return values * _MIX[0]


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for every run of `length` words, by doubling: any length takes few steps."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, have = None, 0  # the hash of the first `have` words of each window
    power, size = hashes, 1
    rest = length
    while rest:
        if rest & 1:
            if done is None:
                done, have = power, size
            else:
                m = len(hashes) - have - size + 1
                done, have = mixed(done[:m] * _MIX[2] + power[have : have + m]), have + size
        rest >>= 1
        if rest:
            m = len(power) - size
            power, size = mixed(power[:m] * _MIX[0] + power[size : size + m]), size * 2
    return done[:n]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_field(schema: StructType, name: str, kind) -> StructType:
    return StructType([*schema.fields, StructField(name, kind)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
