"""A Merkle manifest of a dataset, and proofs for many leaves at once (Octopus multiproofs).

Every row is a leaf, every source a tree of 16 children per node, and the roots of the sources
form a last tree above them. The nodes are stored once, level by level.

Proofs are made per leaf partition: a block of leaves in a row. A block lists the node
coordinates that its proofs need and that do not follow from its own leaves, each once; this
minimal union is fetched in one join. The block then derives all inner nodes that its leaves
share and writes out the single proofs, so that a proof of many levels costs no lookup of its
own. A block is bounded by BLOCK leaves, and what it fetches by 15 nodes per level and run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from layerlens.llm.common import map_arrow
from layerlens.session import written

ARITY = 16
#: Leaves proven together: three full levels of a tree.
BLOCK = ARITY**3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Names of trees. A source's tree is NAMED and the source, so that null sorts first.
NULL, NAMED, TOP = "n", "s", "r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as `-` if null, else its bytes' number, `:` and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `at`, the place of each row in its `tree` by `order`, and `n`, the tree's size.

    Rows are sorted by ranges of (tree, order), so a tree with most of the rows takes many
    tasks; only one row per range and tree is numbered as a whole. Equal rows are told apart
    by where they are stored.
    """
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = ["tree", *order, "_row"]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = written(
        placed.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    counts = written(
        placed.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows")), "counts"
    )
    total = counts.groupBy("tree").agg(
        F.sum("_rows").alias("n"), F.array_sort(F.collect_list(F.struct("_part", "_first", "_rows"))).alias("_parts")
    )
    before = F.aggregate(
        F.slice("_parts", 1, F.col("_i")), F.lit(0).cast("long"), lambda s, p: s + p["_rows"]
    )
    offsets = total.select("tree", "n", "_parts", F.posexplode("_parts").alias("_i", "_p")).select(
        "tree", "n", F.col("_p._part").alias("_part"), (before - F.col("_p._first")).alias("_shift")
    )
    placed = placed.join(written(offsets, "offsets"), ["tree", "_part"])
    return placed.withColumn("at", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def _grown(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes (tree, level, at, digest) over (tree, at, n, digest), and the roots (tree, digest)."""
    level = leaves.select("tree", "at", F.col("n").alias("left"), "digest")
    nodes, roots, depth = None, None, 0
    while True:
        own = level.select("tree", F.lit(depth).alias("level"), "at", "digest")
        top = level.where("left = 1").select("tree", "digest")
        nodes, roots = (own, top) if nodes is None else (nodes.unionAll(own), roots.unionAll(top))
        if level.where("left > 1").isEmpty():
            return nodes, roots
        runs = level.where("left > 1").groupBy("tree", F.floor(F.col("at") / ARITY).alias("at")).agg(
            F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run")
        )
        joined = F.array_join(F.transform("run", lambda c: F.lower(F.hex(c["digest"]))), "")
        level = written(
            runs.select(
                "tree", "at", F.ceil(F.col("left") / ARITY).alias("left"), F.unhex(F.sha2(joined, 256)).alias("digest")
            ),
            "nodes",
        )
        depth += 1


@dataclass
class Manifest:
    """The stored trees of a dataset.

    leaves: the rows given with `tree`, `at` and `n`; nodes: (tree, level, at, digest) of all
    trees; trees: (tree, top_at, n_trees, subroot); root: hexadecimal, None without rows.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def build(rows: DataFrame, tree: str, order: list[str], digest: str = "leaf") -> Manifest:
    """The manifest of rows with a hexadecimal `digest`, one tree per value of `tree`.

    Leaves of a tree go by `order`, nulls first and equal rows by their digest; trees go by
    name, null first. `rows` should be a stored table, as it is read twice.
    """
    name = F.when(F.col(tree).isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(NAMED), F.col(tree).cast("string")))
    leaves = numbered(rows.withColumn("tree", name), [*order, digest])
    digests = leaves.select("tree", "at", "n", F.unhex(digest).alias("digest"))
    nodes, subroots = _grown(digests)
    subroots = written(subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")), "subroots")
    tops = numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "subroot"), ["name"])
    above, root = _grown(tops.select("tree", "at", "n", F.unhex("subroot").alias("digest")))
    found = root.select(F.lower(F.hex("digest")).alias("root")).collect()
    trees = tops.select(F.col("name").alias("tree"), F.col("at").alias("top_at"), F.col("n").alias("n_trees"), "subroot")
    return Manifest(leaves, nodes.unionAll(above), trees, found[0].root if found else None)


def missing(at: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Per level of a tree of `n` leaves, the nodes that proofs of the leaves `at` need and that
    do not follow from these leaves."""
    own, out, level = np.unique(at), [], 0
    while n > 1:
        above = np.unique(own // ARITY)
        runs = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(runs[runs < n], own, assume_unique=True)))
        own, n, level = above, -(-n // ARITY), level + 1
    return out


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Paths:
    """The inner nodes over some leaves of a tree and what lies beside each path, by level."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.runs: list[dict[int, list[str]]] = []  # per level: parent -> digests of its run
        own, level = leaves, 0
        while n > 1:
            runs = {}
            for parent in {at // ARITY for at in own}:
                first = parent * ARITY
                runs[parent] = [
                    own[at] if at in own else fetched[level, at] for at in range(first, min(first + ARITY, n))
                ]
            self.runs.append(runs)
            own, n, level = {p: _hash("".join(run)) for p, run in runs.items()}, -(-n // ARITY), level + 1
        self.root = next(iter(own.values()))

    def beside(self, at: int) -> list[tuple[str, str]]:
        """Per level, the digests of the run before and after the path of a leaf, joined."""
        out = []
        for runs in self.runs:
            run, i = runs[at // ARITY], at % ARITY
            out.append(("".join(run[:i]), "".join(run[i + 1 :])))
            at //= ARITY
        return out


def prove(manifest: Manifest, wanted: DataFrame, doc_id: str = "doc_id", leaf: str = "leaf",
          presented: str = "presented", block: int = BLOCK, siblings: bool = False) -> DataFrame:
    """Proofs for `wanted`, any rows of `manifest.leaves`, checked against the root.

    Gives (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified). A proof is the
    siblings' digests level by level, left to right, proof_sha256 the digest of their
    hexadecimal text in a row; with `siblings` that text is a column too. folded_root follows
    from the digest in `presented` and the proof. A row whose `presented` is null is checked
    with its own leaf.
    """
    blocks = wanted.groupBy("tree", F.floor(F.col("at") / block).alias("block")).agg(
        F.first("n").alias("n"),
        F.collect_list(F.struct("at", F.col(doc_id).alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(presented).alias("shown"))).alias("rows"),
    )
    blocks = written(blocks.join(manifest.trees, "tree"), "blocks")

    def requests(batch):
        columns = [[] for _ in range(5)]
        names = [batch.column(c).to_pylist() for c in ("tree", "block", "n", "top_at", "n_trees", "ats")]
        for tree, number, n, top_at, n_trees, ats in zip(*names):
            for where, found in ((tree, missing(np.array(ats), n)), (TOP, missing(np.array([top_at]), n_trees))):
                for level, at in found:
                    for column, value in zip(columns, (tree, number, where, level)):
                        column.extend([value] * len(at))
                    columns[4].extend(at.tolist())
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["for_tree", "for_block", "tree", "level", "at"]
        )

    narrow = blocks.select("tree", "block", "n", "top_at", "n_trees", F.col("rows.at").alias("ats"))
    asked = map_arrow(narrow, requests, "for_tree string, for_block long, tree string, level int, at long")
    fetched = asked.join(manifest.nodes, ["tree", "level", "at"]).groupBy(
        F.col("for_tree").alias("tree"), F.col("for_block").alias("block")
    ).agg(F.collect_list(F.struct((F.col("tree") == TOP).alias("top"), "level", "at", "digest")).alias("fetched"))
    joined = blocks.join(fetched, ["tree", "block"], "left")
    root = manifest.root
    kinds = dict.fromkeys(("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), pa.string())
    kinds |= {"doc_id": pa.int64(), "verified": pa.bool_()}
    if siblings:
        kinds["siblings"] = pa.string()

    def expand(batch):
        names = ("n", "top_at", "n_trees", "subroot", "rows", "fetched")
        for n, top_at, n_trees, subroot, rows, nodes in zip(*(batch.column(c).to_pylist() for c in names)):
            beside = {False: {}, True: {}}
            for node in nodes or ():
                beside[node["top"]][node["level"], node["at"]] = node["digest"].hex()
            paths = _Paths({r["at"]: r["leaf"].hex() for r in rows}, beside[False], n)
            upper = _Paths({top_at: paths.root}, beside[True], n_trees)
            over = upper.beside(top_at)
            above = {}  # by the parents of leaves: the path over them
            out = [[] for _ in kinds]
            for r in rows:
                at, own = r["at"], r["leaf"].hex()
                if at // ARITY not in above:
                    path = (paths.beside(at) + over)[bool(paths.runs) :]
                    above[at // ARITY] = path, "".join(map("".join, path))
                path, proof = above[at // ARITY]
                if paths.runs:
                    run, i = paths.runs[0][at // ARITY], at % ARITY
                    path = [("".join(run[:i]), "".join(run[i + 1 :])), *path]
                    proof = "".join(path[0]) + proof
                shown = own if r["shown"] is None else r["shown"].hex()
                folded = upper.root
                if shown != own:
                    folded = shown
                    for left, right in path:
                        folded = _hash(left + folded + right)
                values = (r["id"], own, subroot, root, _hash(proof), folded, folded == root, proof)
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values())], names=list(kinds))

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_arrow(joined, expand, schema + (", siblings string" if siblings else ""))


def manifest_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source",
                presented: Column | None = None) -> Manifest:
    """The manifest of documents, a leaf per row over `fields`, by source and doc_id.

    Null values are digested as `-`, which no value is, so null and empty texts differ. Rows
    that repeat a doc_id are leaves of their own, those equal in all fields in any order. An
    empty table has no root. Other columns of any name take no part.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), leaf(*map(F.col, fields)).alias("leaf"),
        (F.lit(None).cast("string") if presented is None else presented).alias("presented"),
    )
    return build(written(rows, "leaves"), "source", ["doc_id"])
