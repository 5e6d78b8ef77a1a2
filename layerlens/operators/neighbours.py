"""Exact nearest neighbours and the classifier built on them.

Training vectors are grouped into cells around pivot vectors. The triangle inequality
tells which cells can hold one of the k nearest of a test vector; only those are visited.
A large cell is split into chunks of bounded size and its visitors into blocks, so one
task never holds more than a chunk and a block, and each hands on k rows per test vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from layerlens.functions.draws import draw

MAX_PIVOTS = 256
MAX_PIVOT_NUMBERS = 4_000_000  # 32 MB of doubles
CHUNK_ROWS = 2048
PIECE_NUMBERS = 1_000_000


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    columns = [np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]
    return np.stack(columns, axis=1)


def _gaps(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    """Distances of a batch to all pivots, a bounded piece at a time."""
    step = max(1, PIECE_NUMBERS // pivots.shape[1])
    starts = range(0, len(vectors), step)
    return np.concatenate(
        [_distances(_matrix(vectors.iloc[i : i + step]), pivots) for i in starts]
    )


def _pivots(train: DataFrame, rows: int, dims: int, seed: int) -> np.ndarray:
    limit = min(MAX_PIVOTS, max(1, MAX_PIVOT_NUMBERS // dims), max(1, math.isqrt(rows)))
    drawn = train.select("features", "id", draw(F.col("id"), seed).alias("draw"))
    return _matrix(r.features for r in drawn.orderBy("draw", "id").limit(limit).collect())


def _assign(pivots: np.ndarray):
    @F.pandas_udf("cell int, gap double")
    def nearest_pivot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            gaps = _gaps(vectors, pivots)
            cell = gaps.argmin(axis=1)
            yield pd.DataFrame({"cell": cell, "gap": gaps[np.arange(len(cell)), cell]})

    return nearest_pivot


def _route(pivots: np.ndarray, cells: list, k: int):
    index = np.array([c.cell for c in cells])
    radius = np.array([c.radius for c in cells])
    rows = np.array([c.n for c in cells])

    @F.pandas_udf("array<int>")
    def cells_to_visit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            gaps = _gaps(vectors, pivots[index])
            farthest = gaps + radius
            order = np.argsort(farthest, axis=1)
            enough = np.cumsum(rows[order], axis=1) >= min(k, rows.sum())
            first = enough.argmax(axis=1)
            lines = np.arange(len(gaps))
            bound = farthest[lines, order[lines, first]]
            # The bound is widened by more than its rounding error.
            visit = gaps - radius <= (bound + 1e-9 * (1 + bound))[:, None]
            yield pd.Series([index[v].tolist() for v in visit])

    return cells_to_visit


def _compare(k: int):
    def nearest(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        found = {"id": [], "neighbour": [], "label": [], "distance": []}
        if len(test) and len(train):
            x, y = _matrix(test["vector"]), _matrix(train["features"])
            ids, labels = train["id"].to_numpy(), train["label"].to_numpy()
            x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
            rough = x2[:, None] + y2[None, :] - 2 * (x @ y.T)
            last = min(k, len(y)) - 1
            # Rough distances only shortlist; the margin covers their rounding error.
            reach = np.partition(rough, last, axis=1)[:, last] + 1e-9 * (1 + x2 + y2.max())
            for i, test_id in enumerate(test["test_id"]):
                near = np.flatnonzero(rough[i] <= reach[i])
                exact = ((y[near] - x[i]) ** 2).sum(axis=1)
                top = np.lexsort((ids[near], exact))[:k]
                found["id"].extend([test_id] * len(top))
                found["neighbour"].extend(ids[near][top])
                found["label"].extend(labels[near][top])
                found["distance"].extend(np.sqrt(exact[top]))
        return pd.DataFrame(found)

    return nearest


def nearest_neighbours(train: DataFrame, test: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The k nearest training rows of every test row: id, neighbour, label, distance, rank.

    Ties go to the lower training id. With fewer than k training rows all of them are
    returned.
    """
    spark = train.sparkSession
    size = train.agg(F.count("*").alias("rows"), F.first(F.size("features")).alias("dims")).first()
    if size.rows == 0:
        raise ValueError("There are no training rows")
    pivots = _pivots(train, size.rows, size.dims, seed)
    placed = train.select("id", "features", "label", _assign(pivots)("features").alias("p"))
    placed = placed.select("id", "features", "label", "p.*")
    # At most MAX_PIVOTS rows from here on where cells are listed.
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
    cells.sort(key=lambda c: c.cell)
    # New names throughout, as both sides may come from the same table.
    visits = test.select(
        F.col("id").alias("test_id"),
        F.col("features").alias("vector"),
        F.explode(_route(pivots, cells, k)("features")).alias("cell"),
    )
    demand = {r.cell: r["count"] for r in visits.groupBy("cell").count().collect()}
    splits = F.broadcast(
        spark.createDataFrame(
            [
                (c.cell, math.ceil(c.n / CHUNK_ROWS), math.ceil(demand[c.cell] / CHUNK_ROWS))
                for c in cells
                if c.cell in demand
            ],
            "cell int, chunks int, blocks int",
        )
    )
    key = ["cell", "chunk", "block"]
    part = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    train_side = (
        placed.join(splits, "cell")
        .withColumn("chunk", part("id", "chunks"))
        .withColumn("block", each("blocks"))
        .select(*key, "id", "features", "label")
    )
    test_side = (
        visits.join(splits, "cell")
        .withColumn("block", part("test_id", "blocks"))
        .withColumn("chunk", each("chunks"))
        .select(*key, "test_id", "vector")
    )
    near = (
        test_side.groupBy(*key)
        .cogroup(train_side.groupBy(*key))
        .applyInPandas(_compare(k), "id long, neighbour long, label int, distance double")
    )
    order = W.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """The majority label of each id; the lowest label wins ties."""
    votes = neighbours.groupBy("id", "label").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("order"), "label"))
    return votes.groupBy("id").agg(best.alias("b")).select("id", F.col("b.label").alias("y_pred"))


def classify(train: DataFrame, test: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return vote(nearest_neighbours(train, test, k, seed))
