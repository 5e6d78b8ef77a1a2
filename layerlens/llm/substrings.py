"""Repeated passages by level-wise doubling.

A window of `length` words can only repeat if the shorter windows inside it do. So lengths are
tried from a quarter up, each twice the one before: only windows that hold a repeated run at
one length go on to the next, until the full length decides.

At a length below the full one a window is represented by the least hash among its runs of that
length (equal windows have equal ones, at the same offset), and neighbouring windows mostly
share it. So a level moves one hash per few words instead of one per word, and only full-length
hashes of windows that survived all levels are ever compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from layerlens.llm.common import fresh, map_arrow, window_hashes, with_field, word_hashes
from layerlens.session import Scratch, bucketed

LENGTH = 35


def levels(length: int) -> list[int]:
    """The lengths tried: about a quarter, half and all of the window."""
    out = [length]
    while len(out) < 3 and out[0] > 3:
        out.insert(0, (out[0] + 1) // 2)
    return out


def least_runs(hashes: np.ndarray, span: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows lo..hi, each of `span` consecutive runs: (run, first window, last window).

    A window's run is the least hash among its runs, the first one of equals. Windows in a row
    that share it are one entry.
    """
    part = hashes[lo : hi + span]
    if span == 1:
        at = np.arange(lo, hi + 1)
        return at, at, at
    views = np.lib.stride_tricks.sliding_window_view(part, span)
    at = views.argmin(axis=1) + np.arange(lo, hi + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first + lo, last + lo


#: A range of windows is one number: the first, and the last in the lower bits.
LAST_BITS = 32


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of packed ranges, put in order and joined where they touch or overlap."""
    spans = np.sort(spans)
    first, last = spans >> LAST_BITS, np.maximum.accumulate(spans & ((1 << LAST_BITS) - 1))
    begins = np.flatnonzero(np.r_[True, first[1:] > last[:-1] + 1]) if len(spans) else np.empty(0, np.int64)
    return first[begins], last[np.r_[begins[1:] - 1, len(spans) - 1]] if len(spans) else last


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The numbers of each list, without an object per number."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] if ok else None for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]


def _runs(rows: DataFrame, length: int, size: int) -> DataFrame:
    """(hash, row, first, more): the runs of `size` words that stand for candidate windows,
    which are `first` and the `more` after it.

    Without a column `spans` every window is a candidate.
    """
    narrowed = "spans" in rows.columns

    def run(batch):
        spans = _lists(batch.column("spans")) if narrowed else None
        found: list[list[np.ndarray]] = [[], [], [], []]
        for i, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())):
            words = text.encode().split() if text else []
            if len(words) < length:
                continue
            hashes = window_hashes(word_hashes(words), size)
            if narrowed:
                at = zip(*merged(spans[i]))
            else:
                at = [(0, len(words) - length)]
            for lo, hi in at:
                runs, first, last = least_runs(hashes, length - size + 1, lo, hi)
                for column, part in zip(found, (hashes[runs].view(np.int64), np.full(len(runs), row), first, last - first)):
                    column.append(part)
        if found[0]:
            columns = [np.concatenate(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), *(pa.array(c.astype(np.int32)) for c in columns[2:])],
                names=["hash", "row", "first", "more"],
            )

    return map_arrow(rows, run, "hash long, row long, first int, more int")


def joined_spans(rows: DataFrame) -> DataFrame:
    """(row, spans) with the ranges of each row joined: a copied text is one range, not one per window."""

    def run(batch):
        found = [merged(s) for s in _lists(batch.column("spans"))]
        spans = pa.array([(first << LAST_BITS) | last for first, last in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), spans], names=["row", "spans"])

    return map_arrow(rows, run, "row long, spans array<long>")


def repeated_windows(rows: DataFrame, length: int, scratch: Scratch | None = None) -> DataFrame:
    """From (row, text) to (row, spans): the starts of repeated windows, as ranges."""
    scratch = scratch or Scratch(rows.sparkSession)
    left, spans = rows, None
    for size in levels(length):
        # Below the full length a run may stand for two ranges of a row and so count twice: a
        # candidate too many. At the full length every window is its own run, counted once.
        runs = scratch.written(_runs(left, length, size), "runs")
        twice = runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        twice = scratch.written(twice, "twice")
        span = F.shiftleft(F.col("first").cast("long"), LAST_BITS) + F.col("first") + F.col("more")
        found = runs.join(twice, "hash").select("row", span.alias("span")).groupBy("row").agg(
            F.collect_list("span").alias("spans")
        )
        before, spans = spans, scratch.written(joined_spans(found), "spans")
        scratch.drop(runs, twice, before)
        # The texts lie bucketed by row, so that only the spans move.
        left = rows.join(spans, "row")
    return spans


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, str]:
    """All columns, the text as its kept words joined by one space, and a struct (n_words,
    n_removed) under the returned name.

    A word goes if a window of `length` words that covers it also starts anywhere else, in the
    same row or another. Rows are told apart by themselves, not by an id, so repeated rows lose
    each other's words. Null, empty and blank texts become empty.
    """
    row, spans_, name = fresh(docs, "row", "spans", "repeats")
    columns = docs.columns
    # Numbered and stored in buckets of rows, so that every later step sees the same numbers
    # and no text moves again.
    rows = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row, "numbered")
    slim = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    found = repeated_windows(slim, length).select(F.col("row").alias(row), F.col("spans").alias(spans_))
    joined = rows.join(found, row, "left").select(*[f"`{c}`" for c in docs.columns], spans_)
    kind = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def run(batch):
        texts, n_words, n_removed = [], [], []
        for t, spans in zip(batch.column(text).to_pylist(), _lists(batch.column(spans_))):
            words = t.encode().split() if t else []
            before = len(words)
            if spans is not None:
                gone = np.zeros(before, bool)
                for lo, hi in zip(*merged(spans)):
                    gone[lo : hi + length] = True
                words = [words[i] for i in np.flatnonzero(~gone)]
            texts.append(b" ".join(words).decode())
            n_words.append(before)
            n_removed.append(before - len(words))
        counts = pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["n_words", "n_removed"]
        )
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns], counts],
            names=[*columns, name],
        )

    return map_arrow(joined, run, with_field(docs.schema, name, kind)), name
