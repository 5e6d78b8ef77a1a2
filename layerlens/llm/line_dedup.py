"""Line deduplication with levelled sorted runs of line hashes.

The index of all lines seen is kept as runs: tables sorted by key, one row per key. A new
batch is reduced to one row per key, merge-anti-joined with the runs to tell first sightings
from known keys, and added as a run of its own. When a level has `FANOUT` runs they are merged
into one run of the next level, so there are few runs and a row is rewritten once per level.

Batches are taken from the largest ids down, so the first sighting of a key names its owner:
the document that keeps its lines. Only 16-byte keys and counts are joined and sorted; a line
that a third of all documents hold is one row per batch by then.

A run is deleted when it is merged into the next, and all of them when the keys that each document
loses are stored: nothing else stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from layerlens.llm.common import WHITE, fresh, map_arrow, with_field
from layerlens.session import Scratch

MIN_POINTS = 20
MIN_DOCUMENTS = 3
BATCHES = 4
FANOUT = 2


def line_key(line: str, min_points: int = MIN_POINTS) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count.

    The key is the line without ASCII white space at its ends, A-Z in lower case.
    """
    line = line.strip(WHITE)
    if len(line) < min_points:
        return None
    return xxhash.xxh3_128_digest(line.encode().lower())


def line_keys(docs: DataFrame, doc_id: str, text: str, min_points: int) -> DataFrame:
    """The distinct keys of every row: (doc_id, key)."""
    schema = StructType([StructField("doc_id", LongType()), StructField("key", BinaryType())])

    def run(batch) -> Iterator[pa.RecordBatch]:
        ids, keys = [], []
        for i, t in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist()):
            found = {line_key(line, min_points) for line in t.split("\n")} if t else set()
            found.discard(None)
            ids.extend([i] * len(found))
            keys.extend(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"]
        )

    return map_arrow(docs.select(doc_id, text), run, schema)


class Runs:
    """The levelled runs; each has (key, n_docs, owner), sorted by key."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionAll(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Adds the rows (doc_id, key) of a batch whose ids lie below those of all before."""
        own = batch.distinct().groupBy("key").agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("owner")
        )
        known = self.all()
        if known is None:
            self._push(0, own)
            return
        known = known.select("key").hint("merge")
        own = self.scratch.written(own, "batch")
        first = own.join(known, "key", "left_anti")
        again = own.join(known, "key", "left_semi").withColumn("owner", F.lit(None).cast("long"))
        self._push(0, first.unionAll(again))
        self.scratch.drop(own)

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        run = run.repartition("key").sortWithinPartitions("key")
        self.levels[level].append(self.scratch.written(run, "run"))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self.merged(full))
            self.scratch.drop(*full)

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionAll(run)
        return out.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def totals(self) -> DataFrame:
        """One row per key over all batches: in how many documents, and the owner."""
        return self.merged([run for level in self.levels for run in level])


def index(keys: DataFrame, scratch: Scratch, batches: int = BATCHES, fanout: int = FANOUT) -> Runs:
    """Feeds the rows (doc_id, key) to the runs in batches of descending ids, nulls last."""
    cuts = keys.select(
        F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")
    ).collect()[0].c
    bounds = [None, *sorted(set(cuts or []), reverse=True), None]
    runs = Runs(scratch, fanout)
    for above, below in zip(bounds, bounds[1:]):
        part = keys
        if above is not None:
            part = part.where((F.col("doc_id") < above) if below is not None
                              else (F.col("doc_id") < above) | F.col("doc_id").isNull())
        if below is not None:
            part = part.where(F.col("doc_id") >= below)
        runs.add(part)
    return runs


def repeated_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS,
                  batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The keys whose lines each document loses: (doc_id, keys), only documents that lose any."""
    scratch = Scratch(docs.sparkSession)
    keys = scratch.written(line_keys(docs, doc_id, text, min_points), "line-keys")
    totals = index(keys, scratch, batches, fanout).totals().where(F.col("n_docs") >= min_documents)
    lost = keys.join(totals, "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    out = scratch.written(lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "lost-lines")
    scratch.keep(out)
    return out


def kept_lines(text: str | None, keys: set[bytes], min_points: int) -> tuple[str, int, int]:
    """The text without the lines of these keys, its lines before, and the lines dropped."""
    lines = (text or "").split("\n")
    if not keys:
        return text or "", len(lines), 0
    left = [line for line in lines if line_key(line, min_points) not in keys]
    return "\n".join(left), len(lines), len(lines) - len(left)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS,
                batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, str]:
    """All columns of the documents, the text without repeated lines, and a struct column
    (n_lines, n_dropped) under the returned name.

    A key of `min_points` code points or more that at least `min_documents` documents hold
    loses its lines everywhere but in the document with the largest id. Documents are told
    apart by id: rows that share one count as one document and lose the same keys; a null id
    is one document below all others. A null text counts as one empty line and becomes an
    empty text; a text that loses all its lines stays as an empty one.
    """
    name, own, keys = fresh(docs, "lines", "own", "keys")
    columns = docs.columns
    lost = repeated_keys(docs, doc_id, text, min_points, min_documents, batches, fanout)
    lost = lost.select(F.col("doc_id").alias(own), F.col("keys").alias(keys))
    joined = docs.join(
        lost.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(own)), "left"
    ).select(*[f"`{c}`" for c in docs.columns], keys)
    counts = StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    schema = with_field(docs.schema, name, counts)

    def run(batch) -> Iterator[pa.RecordBatch]:
        done = [
            kept_lines(t, set(k or ()), min_points)
            for t, k in zip(batch.column(text).to_pylist(), batch.column(keys).to_pylist())
        ]
        found = pa.StructArray.from_arrays(
            [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["n_lines", "n_dropped"],
        )
        texts = pa.array([d[0] for d in done], batch.column(text).type)
        yield pa.RecordBatch.from_arrays(
            [*[texts if c == text else batch.column(c) for c in columns], found],
            names=[*columns, name],
        )

    return map_arrow(joined, run, schema), name

