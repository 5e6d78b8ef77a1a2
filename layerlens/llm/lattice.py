"""Near-duplicate vectors by hashing to points of the E8 lattice.

Unit vectors are projected to eight dimensions by Gaussian matrices, one per table, and decoded
to the nearest point of E8. Close vectors mostly share a point; where they do not, the points
are neighbours, so each vector also asks the neighbouring cells nearest to it. Candidates are
verified by the cosine in double precision. Equal vectors of a label are one node.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from layerlens.llm.common import NO_ID, map_arrow, mixed
from layerlens.llm.components import components
from layerlens.session import written

COSINE = 0.98
TABLES = 12
PROBES = 8
SCALE = 1.0


def _shortest() -> np.ndarray:
    """The 240 neighbours of the origin in E8, by their definition."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    halves = [np.array(v) / 2 for v in itertools.product((1.0, -1.0), repeat=8) if np.prod(v) > 0]
    return np.array(whole + halves)


NEIGHBOURS = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight coordinates."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _keys(points: np.ndarray, table: int) -> np.ndarray:
    key = np.full(points.shape[:-1], table + 1, np.uint64)
    for c in np.moveaxis((2 * points).astype(np.int64).view(np.uint64), -1, 0):
        key = mixed(key + c)
    return key.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE):
    """Per unit vector and table, its cell and the neighbouring cells next nearest to it."""
    n, width = unit.shape
    random = np.random.default_rng([1, width])
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        x = unit @ random.normal(size=(width, 8)) * scale
        own = decode(x)
        if probes:
            toward = np.argsort(-((x - own) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]
            out[:, t, 1:] = _keys(own[:, None, :] + NEIGHBOURS[toward], t)
        out[:, t, 0] = _keys(own, t)
    return out


def _usable(vector) -> np.ndarray | None:
    if not vector or None in vector:
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str, tables: int, probes: int, scale: float) -> DataFrame:
    """(id, label, digest, vector, cells): no digest where the vector links with nothing."""
    schema = "id long, label string, digest binary, vector binary, cells array<long>"

    def run(batch):
        labels = batch.column("label").to_pylist()
        found = [
            None if l is None else _usable(v)
            for v, l in zip(batch.column(embedding).to_pylist(), labels)
        ]
        raw = [None if v is None else (v + 0.0).tobytes() for v in found]
        held = [None] * len(found)
        for width in {len(v) for v in found if v is not None}:
            at = [i for i, v in enumerate(found) if v is not None and len(v) == width]
            unit = np.array([found[i] / np.abs(found[i]).max() for i in at])
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for i, c in zip(at, cells(unit, tables, probes, scale)):
                held[i] = c.ravel()
        ids = batch.column(vec_id).cast(pa.int64()).fill_null(NO_ID)
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("label"),
             pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()),
             pa.array(raw, pa.binary()), pa.array(held, pa.list_(pa.int64()))],
            names=["id", "label", "digest", "vector", "cells"],
        )

    rows = vectors.select(vec_id, embedding, F.col(label).cast("string").alias("label"))
    return map_arrow(rows, run, schema)


def verified(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) with at least this cosine; vectors of unlike length have none."""
    one = nodes.select(F.col("id").alias("a"), F.col("vector").alias("left"))
    two = nodes.select(F.col("id").alias("b"), F.col("vector").alias("right"))

    def run(batch):
        keep = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = np.frombuffer(x), np.frombuffer(y)
            ok = len(x) == len(y)
            if ok:
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                ok = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
            keep.append(bool(ok))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right"), run, "a long, b long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", cosine: float = COSINE, tables: int = TABLES,
                    probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Vectors are compared when their labels are equal and not null. Null, empty and zero vectors
    and those with null or non-finite components link with nothing. A repeated row is a vector of
    its own, as linked as its copies; a null id is one node. An empty table gives an empty table.
    """
    nodes = written(nodes_of(vectors, vec_id, embedding, label, tables, probes, scale), "vectors")
    classes = written(
        nodes.where("digest is not null").groupBy("label", "digest").agg(
            F.min("id").alias("rep"), F.count("*").alias("size")
        ),
        "classes",
    )
    reps = nodes.join(
        classes.select("label", "digest", F.col("rep").alias("id")), ["label", "digest", "id"], "left_semi"
    ).dropDuplicates(["label", "digest", "id"])  # a repeated row is one node
    asked = reps.select("label", "id", F.explode("cells").alias("cell"))
    held = reps.select(
        "label", F.col("id").alias("b"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.element_at("cells", t * (1 + probes) + 1))).alias("cell"),
    )
    met = asked.withColumnRenamed("id", "a").join(held, ["label", "cell"]).where("a <> b")
    pairs = written(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    links = written(verified(pairs, reps, cosine), "links")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("rep").alias("b"), "size")
    others = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    told = classes.join(others, "rep", "left").join(
        components(links).withColumnRenamed("node", "rep"), "rep", "left"
    ).select("label", "digest", "rep", "root", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"))
    out = nodes.select("id", "label", "digest").join(told, ["label", "digest"], "left")
    component = F.coalesce("root", "rep", "id")
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"), (F.col("id") == component).alias("kept"),
    )
