"""Approximate nearest neighbours: inverted lists over trained centres, with compressed residuals.

A vector's list is named by its nearest coarse centre and by the nearest of a second set of
centres to what the first leaves over. What both leave over is kept as one byte per group of
dimensions (product quantisation). The centres are trained by MLlib on a bounded sample, as
documented at SAMPLE_ROWS; every row is then placed and stored once.

A search takes each test vector to its `probes` nearest lists by a join, ranks their rows by
compressed distance, and compares the best of them exactly. The number of lists grows with the
rows, so a list holds about LIST_ROWS of them and the work per test vector stays the same.
Equal vectors are one entry with their lowest ids, so copies never fill a list.

The exact way is `neighbours.nearest_neighbours`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from layerlens.functions.draws import draw
from layerlens.operators.neighbours import vote

#: Rows that centres are trained on, at most, and numbers in them.
SAMPLE_ROWS, SAMPLE_NUMBERS = 65_536, 16_000_000
#: Rows a list should hold; coarse centres and residual centres at most.
LIST_ROWS = 1_000
MAX_COARSE, MAX_FINE = 4_096, 256
#: Compressed groups of dimensions, and values of a group's byte.
GROUPS, CODES = 16, 256
#: Ids kept for equal vectors, and so the largest number of neighbours.
MAX_NEIGHBOURS = 100
#: Lists visited, and candidates per neighbour wanted that are compared exactly.
PROBES, CANDIDATES = 16, 8
#: Rows of a list, or visitors of it, that one task holds at a time.
CHUNK_ROWS = 4_096
PIECE_NUMBERS = 1_000_000
SALTS = 32


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres; rounding may leave them just below 0."""
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, by distances of a bounded piece at a time."""
    step = max(1, PIECE_NUMBERS // len(centres))
    return np.concatenate([_squared(x[i : i + step], centres).argmin(axis=1) for i in range(0, len(x), step)])


def _pieces(vectors: pd.Series, width: int) -> Iterator[np.ndarray]:
    step = max(1, PIECE_NUMBERS // max(width, 1))
    for i in range(0, len(vectors), step):
        yield _matrix(vectors.iloc[i : i + step])


@dataclass
class Quantiser:
    """Trained centres: coarse, fine (of what coarse leaves) and codes[group] (of what both leave)."""

    coarse: np.ndarray
    fine: np.ndarray
    codes: list[np.ndarray]
    bounds: list[int] = field(default_factory=list)  # first dimension of each group, and the end

    @property
    def width(self) -> int:
        return max(len(self.coarse), len(self.fine), CODES, self.coarse.shape[1])

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each row."""
        first = _squared(x, self.coarse).argmin(axis=1)
        rest = x - self.coarse[first]
        second = _squared(rest, self.fine).argmin(axis=1)
        rest = rest - self.fine[second]
        code = np.empty((len(x), len(self.codes)), np.uint8)
        for g, centres in enumerate(self.codes):
            code[:, g] = _squared(rest[:, self.bounds[g] : self.bounds[g + 1]], centres).argmin(axis=1)
        return first * len(self.fine) + second, code

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([centres[code[:, g]] for g, centres in enumerate(self.codes)], axis=1)


def _sample(train: DataFrame, rows: int, dims: int, seed: int) -> DataFrame:
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dims))
    if rows <= most:
        return train.select("features")
    # A little over `most` rows by their draw, cut to it.
    share = min(1.0, 1.2 * most / rows)
    mark = F.substring(draw(F.col("id"), seed), 1, 8)
    return train.where(mark < f"{int(share * 0xFFFFFFFF):08x}").select("features").limit(most)


def _trained(rows: DataFrame, centres: int, seed: int) -> np.ndarray:
    """MLlib's k-means; equal rows may leave fewer centres than asked for. One centre is the mean."""
    if centres == 1:
        return rows.agg(Summarizer.mean(F.col("vector")).alias("m")).first().m.toArray()[None]
    model = KMeans(k=centres, seed=seed, maxIter=10, initMode="random", featuresCol="vector", tol=1e-3)
    return np.array(model.fit(rows).clusterCenters())


def _group_codes(rest: DataFrame, bounds: list[int], seed: int) -> list[np.ndarray]:
    """The centres of each group of dimensions, one task per group over the bounded sample."""

    def lloyd(key, frame):
        x = _matrix(frame["part"])
        rng = np.random.default_rng([seed, int(key[0])])
        centres = np.unique(x, axis=0)
        if len(centres) > CODES:
            centres = centres[rng.choice(len(centres), CODES, replace=False)]
            for _ in range(8):
                nearest = _nearest(x, centres)
                counts = np.bincount(nearest, minlength=len(centres))
                sums = np.stack([np.bincount(nearest, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
                centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        return pd.DataFrame({"g": [int(key[0])], "centres": [centres.ravel().tolist()]})

    parts = F.array(*[F.slice("rest", lo + 1, hi - lo) for lo, hi in zip(bounds, bounds[1:])])
    dealt = rest.select(F.posexplode(parts).alias("g", "part"))
    found = dealt.groupBy("g").applyInPandas(lloyd, "g int, centres array<double>").orderBy("g").collect()
    return [np.array(r.centres).reshape(-1, bounds[r.g + 1] - bounds[r.g]) for r in found]


def _entries(train: DataFrame) -> DataFrame:
    """(entry, features, members): one row per distinct vector, with its lowest ids and labels."""
    rows = train.select("id", "label", "features", F.xxhash64("id").alias("salt"))
    same = [F.col("features")]
    for by in ([*same, F.pmod("salt", F.lit(SALTS))], same):
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(
            F.col("place") <= MAX_NEIGHBOURS
        )
    return rows.groupBy("features").agg(
        F.min("id").alias("entry"), F.array_sort(F.collect_list(F.struct("id", "label"))).alias("members")
    )


@dataclass
class VectorIndex:
    """A stored index: `entries` (list, entry, code), `vectors` (entry, features, members)."""

    folder: str
    quantiser: Quantiser
    lists: dict[int, int]  # rows of each list
    entries: DataFrame = field(repr=False)
    vectors: DataFrame = field(repr=False)

    @staticmethod
    def build(train: DataFrame, folder: str, seed: int = 42, list_rows: int = LIST_ROWS) -> VectorIndex:
        """Trains, places all rows and stores the index in `folder`, which must be shared.

        `train` has id, features (no null, all of one length) and label.
        """
        spark = train.sparkSession
        vectors = f"{folder}/vectors"
        _entries(train).write.parquet(vectors)
        stored = spark.read.parquet(vectors)
        rows = stored.count()
        if rows == 0:
            raise ValueError("There are no training rows")
        dims = stored.select(F.size("features")).first()[0]
        sample = _sample(stored.select("features", F.col("entry").alias("id")), rows, dims, seed)
        sample = sample.select("features", array_to_vector("features").alias("vector"))
        lists = max(1, rows // list_rows)
        first = min(math.ceil(math.sqrt(lists)), MAX_COARSE)
        coarse = _trained(sample, first, seed)
        second = min(math.ceil(lists / first), MAX_FINE)

        def left(centres: list[np.ndarray]):
            @F.pandas_udf("array<double>")
            def rest(vectors: pd.Series) -> pd.Series:
                out = []
                for x in _pieces(vectors, max(map(len, centres))):
                    for c in centres:
                        x = x - c[_squared(x, c).argmin(axis=1)]
                    out.extend(x)
                return pd.Series(out)

            return rest

        after = sample.select(left([coarse])("features").alias("rest"))
        fine = _trained(after.select(array_to_vector("rest").alias("vector")), second, seed) if second > 1 else np.zeros((1, dims))
        after = sample.select(left([coarse, fine])("features").alias("rest"))
        groups = min(GROUPS, dims)
        bounds = [dims * g // groups for g in range(groups + 1)]
        quantiser = Quantiser(coarse, fine, _group_codes(after, bounds, seed), bounds)

        @F.pandas_udf("list long, code binary")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vectors in batches:
                found = [quantiser.placed(x) for x in _pieces(vectors, quantiser.width)]
                yield pd.DataFrame({
                    "list": np.concatenate([f[0] for f in found]),
                    "code": [c.tobytes() for f in found for c in f[1]],
                })

        placed = stored.select("entry", place("features").alias("p")).select("p.list", "entry", "p.code")
        placed.repartition("list").sortWithinPartitions("list").write.parquet(f"{folder}/entries")
        about = {
            "coarse": coarse.tolist(), "fine": fine.tolist(), "codes": [c.tolist() for c in quantiser.codes], "bounds": bounds,
        }
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{folder}/about")
        return VectorIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> VectorIndex:
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        entries = spark.read.parquet(f"{folder}/entries")
        # At most MAX_COARSE * MAX_FINE rows of two numbers.
        lists = {r.list: r.n for r in entries.groupBy("list").agg(F.count("*").alias("n")).collect()}
        quantiser = Quantiser(
            np.array(about["coarse"]), np.array(about["fine"]), [np.array(c) for c in about["codes"]], about["bounds"]
        )
        return VectorIndex(folder, quantiser, lists, entries, spark.read.parquet(f"{folder}/vectors"))

    def _routed(self, test: DataFrame, probes: int) -> DataFrame:
        """(test_id, vector, list): the nearest lists that hold rows."""
        quantiser = self.quantiser
        shared = test.sparkSession.sparkContext.broadcast(np.array(sorted(self.lists)))

        @F.pandas_udf("array<long>")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, many = shared.value, len(quantiser.fine)
            by_coarse = np.searchsorted(held, np.arange(len(quantiser.coarse) + 1) * many)
            counts = np.diff(by_coarse)
            for vectors in batches:
                out = []
                for x in _pieces(vectors, max(quantiser.width, 4 * probes * many)):
                    rough = _squared(x, quantiser.coarse)
                    rough[:, counts == 0] = np.inf
                    # Coarse cells from the nearest on, until they hold enough lists to choose from.
                    order = np.argsort(rough, axis=1, kind="stable")
                    enough = np.minimum(4 * probes, len(held))
                    for v, cells in zip(x, order):
                        last = np.searchsorted(np.cumsum(counts[cells]), enough) + 1
                        lists = np.concatenate([held[by_coarse[c] : by_coarse[c + 1]] for c in cells[:last]])
                        gaps = _squared(v[None], quantiser.centre(lists))[0]
                        out.append(lists[np.lexsort((lists, gaps))[:probes]].tolist())
                yield pd.Series(out)

        return test.select(
            F.col("id").alias("test_id"), F.col("features").alias("vector"), F.explode(nearest("features")).alias("list")
        )

    def search(self, test: DataFrame, k: int, probes: int = PROBES, candidates: int = CANDIDATES) -> DataFrame:
        """About the k nearest rows of every test row: id, neighbour, label, distance, rank.

        Distances are exact; equal ones go to the lower id. A test row gets fewer rows than k
        only if its lists hold fewer.
        """
        if not 1 <= k <= MAX_NEIGHBOURS:
            raise ValueError(f"k must be from 1 to {MAX_NEIGHBOURS}")
        spark = test.sparkSession
        quantiser, most = self.quantiser, k * candidates
        visits = self._routed(test, probes)
        sizes = spark.createDataFrame(
            [(l, math.ceil(n / CHUNK_ROWS)) for l, n in self.lists.items()], "list long, chunks int"
        )
        key = ["list", "chunk", "block"]
        demand = visits.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("blocks"))
        splits = sizes.join(demand, "list")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
        held = self.entries.join(splits, "list").withColumn("chunk", part("entry", "chunks")).withColumn("block", each("blocks"))
        asked = visits.join(splits, "list").withColumn("block", part("test_id", "blocks")).withColumn("chunk", each("chunks"))

        def ranked(test_rows, rows):
            if not len(test_rows) or not len(rows):
                return pd.DataFrame({"test_id": [], "entry": [], "rough": []})
            centre = quantiser.centre(np.array([rows["list"].iloc[0]]))
            x = _matrix(test_rows["vector"]) - centre
            code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            decoded, last = quantiser.decoded(code), min(most, len(rows))
            step, near, gaps = max(1, PIECE_NUMBERS // len(rows)), [], []
            for i in range(0, len(x), step):
                rough = _squared(x[i : i + step], decoded)
                near.append(np.argpartition(rough, last - 1, axis=1)[:, :last])
                gaps.append(np.take_along_axis(rough, near[-1], axis=1))
                # argpartition gives all places; only the kept ones are held on to.
                near[-1] = near[-1].astype(np.int32)
            return pd.DataFrame({
                "test_id": np.repeat(test_rows["test_id"].to_numpy(), last),
                "entry": rows["entry"].to_numpy()[np.concatenate(near)].ravel(),
                "rough": np.concatenate(gaps).ravel(),
            })

        rough = (
            asked.select(*key, "test_id", "vector").groupBy(*key)
            .cogroup(held.select(*key, "entry", "code").groupBy(*key))
            .applyInPandas(ranked, "test_id long, entry long, rough double")
        )
        place = F.row_number().over(W.partitionBy("test_id").orderBy("rough", "entry"))
        short = rough.withColumn("place", place).where(F.col("place") <= most).select("test_id", "entry")
        pairs = short.join(self.vectors, "entry").join(
            test.select(F.col("id").alias("test_id"), F.col("features").alias("vector")), "test_id"
        )
        gap = F.aggregate(F.zip_with("features", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
        found = pairs.select(F.col("test_id").alias("id"), F.sqrt(gap).alias("distance"), F.explode(F.slice("members", 1, k)).alias("m"))
        found = found.select("id", F.col("m.id").alias("neighbour"), F.col("m.label").alias("label"), "distance")
        order = W.partitionBy("id").orderBy("distance", "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def classify(self, test: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """(id, y_pred): the majority label of the k rows found, the lowest one of equals."""
        return vote(self.search(test, k, probes))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (tests, k, recall): the share of the exact neighbours that were found."""
    want = exact.select("id", "neighbour")
    hit = want.join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return hit.agg(
        F.count_distinct("id").alias("tests"), (F.count("*") / F.count_distinct("id")).alias("k"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
