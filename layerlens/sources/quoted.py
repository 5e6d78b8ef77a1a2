"""Quoted CSV files read by many tasks each.

A quoted text may hold line ends, so a byte range of a file alone does not tell where its rows
begin. Three steps settle it without moving the texts:

1. Every range of every file is scanned for what it does to the two states a line can begin in,
   outside or inside quotes; that is two flags per range.
2. The flags are composed in file order by a window over one row per range, which gives the
   state each range begins in.
3. Every range is cut into rows at true row ends. A row that goes over a range's end is put
   together from its pieces by a grouping of those pieces alone.

The state at a byte is a property of the file, not of the plan: should Spark cut the files anew
between the steps, a range either begins at a known byte or is an error, never read wrongly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from layerlens.session import new_folder, written

#: With more ranges than this their states are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_RANGES = 100_000

STATES = "path string, start long, size long, outside boolean, inside boolean"
PIECES = "path string, start long, base long, line long, kind string, record string"

#: Up to the closing quote; a doubled quote is one of the text.
CLOSE = re.compile('[^"]*+(?:""[^"]*+)*+"')


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins outside or inside quotes ends inside them.

    A quote opens only at the beginning of a field; elsewhere in an unquoted field it is text.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not (at == 0 and line[0] == '"'):
                at = line.find(sep + '"', at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        closed = CLOSE.match(line, at)
        if closed is None:
            return True
        at, inside = closed.end(), False


def ranges_of(rows: Iterable[dict]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The runs of lines of one range: a task may read several ranges after another."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead["path"], ahead["start"]

        def run():
            nonlocal ahead
            while ahead is not None and (ahead["path"], ahead["start"]) == key:
                yield ahead
                ahead = next(rows, None)

        lines = run()
        yield key, lines
        for _ in lines:
            pass


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def states_of(sep: str):
    """Step 1: one row per range."""

    def run(batches):
        found = []
        for (path, start), lines in ranges_of(_rows(batches)):
            outside, inside = False, True
            for row in lines:
                size = row["size"]
                if outside == inside:
                    outside = inside = ends_inside(row["value"], outside, sep)
                else:
                    outside, inside = (ends_inside(row["value"], s, sep) for s in (outside, inside))
            found.append({"path": path, "start": start, "size": size, "outside": outside, "inside": inside})
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
        yield pa.RecordBatch.from_pylist(found, schema)

    return run


def cut_range(lines: Iterable[dict], sep: str) -> Iterator[tuple[int, str, str]]:
    """Step 3 for one range: (line, kind, record).

    `whole` is a row; `begin` the part of one that goes on in the next range; `rest` what an
    earlier range began. The header is at line -1; empty lines between rows are none.
    """
    held: list[str] = []
    state = line = None
    for i, row in enumerate(lines):
        if i == 0:
            state, header = row["opens_inside"], row["start"] == 0
            kind, line = ("rest", 0) if state else ("whole", None)
        value = row["value"]
        if not state and not held and not value.rstrip("\r"):
            continue
        if line is None:
            line, header = (-1 if header else i), False
        held.append(value)
        state = ends_inside(value, state, sep)
        if not state:
            yield line, kind, "\n".join(held)
            held, kind, line = [], "whole", None
    if held:
        yield line, "rest" if kind == "rest" else "begin", "\n".join(held)


def pieces_of(sep: str, most_rows: int = 1000, most_chars: int = 4_000_000):
    """Step 3: batches of bounded size."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("base", pa.int64()), ("line", pa.int64()), ("kind", pa.string()), ("record", pa.string())])

    def run(batches):
        out, chars = [], 0
        for (path, start), lines in ranges_of(_rows(batches)):
            first = next(lines)

            def again(first=first, lines=lines):
                yield first
                yield from lines

            for line, kind, record in cut_range(again(), sep):
                out.append({"path": path, "start": start, "base": first["base"], "line": line, "kind": kind, "record": record})
                chars += len(record)
                if len(out) >= most_rows or chars >= most_chars:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def opening_states(states: DataFrame) -> DataFrame:
    """Step 2: path, start, whether the range opens inside quotes, and the bytes of the files before.

    A range either fixes the state it ends in or keeps or flips the one it begins with, so the
    state is that of the last fixing range, flipped by the flips since.
    """
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fixes = F.col("outside") == F.col("inside")
    flips = F.coalesce(F.sum(F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)).over(before), F.lit(0))
    rows = states.withColumn("flips", flips)
    fixed = F.last(F.when(fixes, F.struct(F.col("outside").cast("int").alias("state"), "flips")), True).over(before)
    rows = rows.withColumn("fixed", fixed)
    state = F.coalesce(F.col("fixed.state") + F.col("flips") - F.col("fixed.flips"), F.col("flips")) % 2 == 1
    files = states.groupBy("path").agg(F.max("size").alias("size"))
    earlier = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = files.select("path", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    return rows.join(files, "path").select("path", "start", state.alias("opens_inside"), "base")


def read_quoted(spark: SparkSession, path: str, sep: str = ",", at: str = "_at") -> DataFrame:
    """The columns that the header names, as text, and each row's place under the name `at`.

    Rows, nulls and quotes are as Spark's own multi-line reader has them. Places are unique over
    all files and ascend in file order. Row ends are `\\n` or `\\r\\n`. A quote that is never closed
    makes the rest of its file one row. An empty folder is an error, a file of a header no rows.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": True}
    columns = spark.read.options(header=True, **options).csv(path).schema
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
    )
    opening = written(opening_states(written(lines.mapInArrow(states_of(sep), STATES), "states")), "opening")
    opening = opening.withColumnRenamed("path", "_path").withColumnRenamed("start", "_start")
    lines = lines.drop("size")
    same = (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))
    if opening.count() <= MAX_BROADCAST_RANGES:
        placed = lines.join(F.broadcast(opening), same, "left")
    else:
        ordered = lines.withColumn("_line", F.monotonically_increasing_id())
        placed = ordered.join(opening.hint("shuffle_hash"), same, "left")
        placed = placed.repartition("path", "start").sortWithinPartitions("path", "start", "_line")
    unknown = F.raise_error(F.lit("The files changed while they were read")).cast("boolean")
    placed = placed.select("path", "start", "value", "base", F.coalesce("opens_inside", unknown).alias("opens_inside"))

    folder = new_folder(spark, "pieces")
    placed.mapInArrow(pieces_of(sep), PIECES).write.partitionBy("kind").parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    whole = pieces.filter("kind = 'whole'").select("base", "start", "line", "record")
    records = whole.unionByName(joined(pieces.filter("kind IN ('begin', 'rest')")))
    cells = F.from_csv(F.regexp_replace("record", "\r$", ""), _ddl(columns), {k: str(v) for k, v in options.items()})
    rows = records.filter("line >= 0").select(cells.alias("_cells"), (F.col("base") + F.col("start") + F.col("line")).alias(at))
    return rows.select(*[F.col("_cells").getField(c.name).alias(c.name) for c in columns], at)


def _ddl(columns) -> str:
    return ", ".join(f"`{c.name.replace('`', '``')}` string" for c in columns)


def joined(pieces: DataFrame) -> DataFrame:
    """Rows that go over range ends, each put together where it began; only such pieces move."""
    order = W.partitionBy("path").orderBy("start", F.col("kind") == "begin")
    begun = F.struct("start", "line")
    owned = pieces.withColumn("owner", F.last(F.when(F.col("kind") == "begin", begun), True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", F.col("kind") == "rest", "record")))
    return owned.groupBy("path", "base", "owner").agg(parts.alias("parts")).select(
        "base", "owner.start", "owner.line", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
    )
