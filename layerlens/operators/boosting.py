"""Second-order boosted trees for any number of classes, grown by levels or by leaves.

Training rows are cut into bins of approximate quantiles once and stored in blocks. A round fits
one tree per class (one in all for two classes) to the gradients and curvatures of the softmax
loss. What a pass over the blocks computes is a histogram of both per node and feature; tasks
add up their own blocks, an exchange by (tree, features) adds up the tasks', and only the
best split of each node reaches the driver. Of two siblings only the smaller one is counted, the
other is its parent less it; histograms of nodes that may become parents stay where they were
added up, until the tree is done. A pass is one small job.

Growing by leaves always splits the leaf of best gain next, until a tree has `num_leaves`. To
take few passes for that, a pass counts the children of every leaf that could still be split;
the order of splits is then replayed on the driver, as far as gains are known, so that the tree
is the one that strict growth gives.

A table that one task can hold is gathered in one, as a pass over it is less work than its job:
its trees grow there by the same passes, one tree after the other.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, functions as F

from layerlens.operators.perceptron import cached, gathered, in_one_task, released
from layerlens.session import dropped, new_folder

BINS = 64
BLOCK_ROWS = 10_000
#: Digits of a gain that count.
DIGITS = 9
#: Features whose histograms travel together.
FEATURES = 256
#: Rows of a gathered table that are added to a histogram at once.
PIECE_ROWS = 4096
#: Rounds after which the rows' margins are stored, so that a pass applies few trees.
STORE_ROUNDS = 10


@dataclass(frozen=True)
class Growth:
    """How trees grow. `num_leaves` grows by leaves, otherwise `max_depth` by levels."""

    rounds: int
    rate: float
    max_depth: int = 0  # 0: no bound
    num_leaves: int = 0  # 0: by levels
    penalty: float = 1.0  # of the squared leaf values
    min_curvature: float = 1.0
    min_rows: int = 1
    wide: bool = False  # whether curvatures of many classes are doubled or only widened by k / (k - 1)

    @staticmethod
    def by_levels(params: dict) -> Growth:
        return Growth(params["n_estimators"], params["learning_rate"], params.get("max_depth", 6))

    @staticmethod
    def by_leaves(params: dict) -> Growth:
        return Growth(
            params["n_estimators"], params["learning_rate"], params.get("max_depth", 0), params.get("num_leaves", 31),
            penalty=0.0, min_curvature=1e-3, min_rows=params.get("min_child_samples", 20), wide=True,
        )


@dataclass
class Node:
    gradient: float
    curvature: float
    rows: int
    depth: int = 0
    gain: float = -math.inf  # of the best split; none known or none allowed if not above 0
    feature: int = -1
    bin: int = -1
    parts: tuple = ()  # (gradient, curvature, rows) to the left
    children: tuple[int, int] | None = None  # where rows have been counted
    split: bool = False  # whether the tree has this split


@dataclass
class Tree:
    """A finished tree over bins: rows with bin <= `bins[node]` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        return _routed(bins, self.feature, self.bin, self.left, self.right)


def _routed(bins, feature, bin_, left, right) -> np.ndarray:
    """The node each row ends in; feature -1 marks ends."""
    at = np.zeros(len(bins), np.int64)
    while True:
        going = np.flatnonzero(feature[at] >= 0)
        if not len(going):
            return at
        node = at[going]
        goes_left = bins[going, feature[node]] <= bin_[node]
        at[going] = np.where(goes_left, left[node], right[node])


def _arrays(nodes: list[Node], final: bool):
    """(feature, bin, left, right) of a tree: its own splits, or all that have been counted."""
    feature, bin_ = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
    left, right = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for i, n in enumerate(nodes):
        if n.children and (n.split or not final):
            feature[i], bin_[i] = n.feature, n.bin
            left[i], right[i] = n.children
    return feature, bin_, left, right


@dataclass
class BoostedTrees:
    """cuts: per feature the bins' upper edges; rounds: per round one tree per margin."""

    cuts: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.tile(self.base, (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += tree.value[tree.leaves(bins)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.margins(x) if self.base.size > 1 else self.probabilities(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _probabilities(self.margins(x))

    def to_json(self) -> str:
        trees = [[{k: v.tolist() for k, v in vars(t).items()} for t in round_] for round_ in self.rounds]
        return json.dumps({"cuts": [c.tolist() for c in self.cuts], "base": self.base.tolist(), "rounds": trees})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        about = json.loads(text)
        rounds = [
            [Tree(*(np.array(t[k], float if k == "value" else np.int64) for k in ("feature", "bin", "left", "right", "value"))) for t in round_]
            for round_ in about["rounds"]
        ]
        return BoostedTrees([np.array(c, float) for c in about["cuts"]], np.array(about["base"]), rounds)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, d], side="left") for d, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _probabilities(margins: np.ndarray) -> np.ndarray:
    """Per class; one margin tells two classes apart."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _slopes(margins: np.ndarray, target: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the loss for each margin."""
    p = _probabilities(margins)
    if margins.shape[1] == 1:
        p = p[:, 1:]
        return p - target[:, None], p * (1 - p)
    gradient = p.copy()
    gradient[np.arange(len(target)), target] -= 1
    k = margins.shape[1]
    return gradient, (k / (k - 1) if wide else 2) * p * (1 - p)


def quantile_cuts(train: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Per dimension at most bins - 1 of its values, approximate quantiles of all rows."""
    shares = [i / bins for i in range(1, bins)]
    rows = train.select(F.posexplode("features").alias("d", "x")).groupBy("d").agg(
        F.percentile_approx("x", shares, 10_000).alias("cuts")
    )
    return [np.unique(r.cuts) for r in rows.orderBy("d").collect()]


def _blocks(train: DataFrame, cuts: list[np.ndarray], margins: int, base: np.ndarray, folder: str) -> DataFrame:
    """Stored blocks (bins, target, margins), each of some rows."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = np.array(part.column("features").to_pylist(), np.float64)
                target = np.array(part.column("target").to_pylist(), np.int32)
                own = np.tile(base, (len(x), 1)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in (binned(x, cuts), target, own)],
                    names=["bins", "target", "margins"],
                )

    out = train.select("features", "target").mapInArrow(run, "bins binary, target binary, margins binary")
    out.write.parquet(folder)
    return train.sparkSession.read.schema(out.schema).parquet(folder)


def _opened(batch: pa.RecordBatch, dims: int, margins: int):
    for bins, target, own in zip(*(batch.column(c).to_pylist() for c in ("bins", "target", "margins"))):
        target = np.frombuffer(target, np.int32)
        yield np.frombuffer(bins, np.uint8).reshape(-1, dims), target, np.frombuffer(own).reshape(-1, margins)


def _advanced(bins: np.ndarray, margins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = margins.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree.value[tree.leaves(bins)]
    return out


def _best_split(hist: np.ndarray, growth: Growth, first: int):
    """The best split of a node by its histogram [gradient/curvature/rows, feature, bin]:
    (gain, feature, bin, gradient, curvature and rows to the left)."""
    if hist[2, 0].sum() < 2 * max(growth.min_rows, 1):
        return -math.inf, first, 0, 0.0, 0.0, 0.0  # too few rows for any
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    allowed = (
        (left[2] >= growth.min_rows) & (right[2] >= growth.min_rows) & (left[2] > 0) & (right[2] > 0)
        & (left[1] >= growth.min_curvature) & (right[1] >= growth.min_curvature)
    )

    def score(part):
        return part[0] ** 2 / np.maximum(part[1] + growth.penalty, 1e-16)

    # Rounded, so that the order of additions does not choose between equal splits.
    gain = np.where(allowed, np.round(score(left) + score(right) - score(total), DIGITS), -np.inf)
    d, b = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[d, b]), first + int(d), int(b), *(float(left[i, d, b]) for i in range(3))


class _Grower:
    """The trees of one round while they grow, and the histograms of their last nodes."""

    def __init__(self, growth: Growth, trees: int):
        self.growth, self.trees = growth, [[] for _ in range(trees)]

    def _budget(self, nodes: list[Node]) -> int:
        if not self.growth.num_leaves:
            return len(nodes) + 1
        return self.growth.num_leaves - 1 - sum(n.split for n in nodes)

    def replay(self, nodes: list[Node]) -> None:
        """Makes the splits that strict growth would make next, as far as gains are known."""
        while self._budget(nodes) > 0:
            ends = self._ends(nodes)
            if not ends:
                return
            best = max(ends, key=lambda i: (nodes[i].gain, -i))
            if nodes[best].children is None:
                return
            nodes[best].split = True

    def _ends(self, nodes: list[Node]) -> list[int]:
        """Leaves of the tree that can be split."""
        out, rest = [], [0] if nodes else []
        while rest:
            i = rest.pop()
            if nodes[i].split:
                rest.extend(nodes[i].children)
            elif nodes[i].gain > 0 and (not self.growth.max_depth or nodes[i].depth < self.growth.max_depth):
                out.append(i)
        return out

    def wanted(self) -> list[tuple[int, int]]:
        """The (tree, node) whose children are to be counted next: of each tree the ends that
        may still be split, best gain first, no more than it has splits left."""
        out = []
        for t, nodes in enumerate(self.trees):
            self.replay(nodes)
            ends = [i for i in self._ends(nodes) if nodes[i].children is None]
            ends.sort(key=lambda i: (-nodes[i].gain, i))
            out.extend((t, i) for i in ends[: max(self._budget(nodes), 0)])
        return out

    def open(self, t: int, i: int) -> tuple[int, int]:
        """Adds the children of a node; gives the smaller one and its sibling."""
        nodes, n = self.trees[t], self.trees[t][i]
        g, h, rows = n.parts
        nodes.append(Node(g, h, int(rows), n.depth + 1))
        nodes.append(Node(n.gradient - g, n.curvature - h, n.rows - int(rows), n.depth + 1))
        n.children = len(nodes) - 2, len(nodes) - 1
        left, right = n.children
        return (left, right) if nodes[left].rows <= nodes[right].rows else (right, left)

    def finished(self) -> list[Tree]:
        out = []
        for nodes in self.trees:
            value = np.array([-n.gradient / max(n.curvature + self.growth.penalty, 1e-16) for n in nodes])
            out.append(Tree(*_arrays(nodes, final=True), self.growth.rate * value))
        return out


def _opened_rows(rows, dims: int, margins: int):
    for bins, target, own in rows:
        yield np.frombuffer(bins, np.uint8).reshape(-1, dims), np.frombuffer(target, np.int32), np.frombuffer(own).reshape(-1, margins)


def _after_round(blocks: RDD, trees: list[Tree], dims: int, margins: int) -> RDD:
    """The blocks with a round's trees added to their margins."""

    def run(rows):
        for bins, target, own in _opened_rows(rows, dims, margins):
            yield bins.tobytes(), target.tobytes(), _advanced(bins, own, [trees]).tobytes()

    return blocks.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def _histograms(blocks: RDD, grower: _Grower, pairs: dict[tuple[int, int], tuple[int, int]], dims: int, margins: int) -> RDD:
    """((tree, part), (node, hist, None)): each task's sums over its blocks for the nodes of
    `pairs`, which gives each one's parent (-1 for a root) and sibling."""
    by_tree: dict[int, list[int]] = {}
    for t, i in pairs:
        by_tree.setdefault(t, []).append(i)
    routes = {t: _arrays(grower.trees[t], final=False) if grower.trees[t] else None for t in by_tree}
    wide = grower.growth.wide

    def run(rows):
        sums: dict[tuple[int, int], np.ndarray] = {}
        step = np.arange(dims) * BINS
        for bins, target, own in _opened_rows(rows, dims, margins):
            gradient, curvature = _slopes(own, target, wide)
            places = bins + step
            for t, wanted in by_tree.items():
                at = np.zeros(len(bins), np.int64) if routes[t] is None else _routed(bins, *routes[t])
                for i in wanted:
                    here = np.flatnonzero(at == i)
                    hist = _histogram(places[here], gradient[here, t], curvature[here, t])
                    sums[t, i] = sums[t, i] + hist if (t, i) in sums else hist
        for (t, i), hist in sums.items():
            hist = hist.reshape(3, dims, BINS)
            for first in range(0, dims, FEATURES):
                yield (t, first), (i, _packed(hist[:, first : first + FEATURES]), None)

    return blocks.mapPartitions(run)


def _histogram(places: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Summed gradients, curvatures and rows per place (feature, bin) of some rows."""
    dims = places.shape[1]
    key = places.ravel()
    return np.stack([
        *(np.bincount(key, np.repeat(w, dims), dims * BINS) for w in (gradient, curvature)), np.bincount(key, None, dims * BINS),
    ])


def _packed(hist: np.ndarray) -> tuple:
    """A histogram as its shape and the bins that hold rows, which are few in small nodes."""
    flat = hist.reshape(3, -1)
    held = np.flatnonzero(flat[2])
    return hist.shape, held.astype(np.int32), flat[:, held]


def _unpacked(packed: tuple) -> np.ndarray:
    shape, held, values = packed
    flat = np.zeros((3, shape[1] * shape[2]))
    flat[:, held] = values
    return flat.reshape(shape)


def _rest(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The sibling's histogram; bins without rows hold no rest of the subtraction."""
    rest = parent - child
    return np.where(rest[2] > 0, rest, 0.0)


def _place(key: tuple[int, int]) -> int:
    return 31 * key[0] + key[1] // FEATURES


def _merged(rows: RDD, known: RDD | None, pairs: dict[tuple[int, int], tuple[int, int]], growth: Growth, tasks: int) -> RDD:
    """((tree, part), (node, hist, split)) of all nodes that may become parents.

    One exchange, of the new sums: those of a tree and part meet in one task, where the
    histograms known from earlier passes are already. `split` is the best split and the totals
    of a new node, None of one known before.
    """
    dealt = rows.partitionBy(tasks, _place)
    if known is not None:
        dealt = known.union(dealt)
    used = {(t, parent) for (t, _), (parent, _) in pairs.items()}

    def run(rows):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        held: dict[tuple[int, int, int], tuple] = {}
        for (t, first), (i, packed, _) in rows:
            key = t, i, first
            if (t, i) in pairs:
                sums[key] = sums[key] + _unpacked(packed) if key in sums else _unpacked(packed)
            else:
                held[key] = packed
        for (t, i, first), hist in sums.items():
            parent, sibling = pairs[t, i]
            found = [(i, hist)]
            if parent >= 0:
                found.append((sibling, _rest(_unpacked(held[t, parent, first]), hist)))
            for node, own in found:
                yield (t, first), (node, _packed(own), (*_best_split(own, growth, first), *own[:, 0].sum(axis=1).tolist()))
        for (t, i, first), packed in held.items():
            if (t, i) not in used:
                yield (t, first), (i, packed, None)

    return dealt.mapPartitions(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)


SPLIT = Row("tree", "part", "node", "gain", "feature", "bin", "g", "h", "n", "total_g", "total_h", "total_n")


def _splits(merged: RDD) -> list[Row]:
    """The best splits of the new nodes."""
    new = merged.filter(lambda e: e[1][2] is not None).map(lambda e: (*e[0], e[1][0], *e[1][2]))
    return [SPLIT(*values) for values in new.collect()]


def fit(train: DataFrame, classes: int, growth: Growth, from_prior: bool = False) -> BoostedTrees:
    """Fits (features, target) with targets 0 .. classes - 1.

    Margins start at 0, or `from_prior` at the logarithms of the classes' shares.
    """
    spark = train.sparkSession
    cuts = quantile_cuts(train)
    dims, margins = len(cuts), 1 if classes <= 2 else classes
    base = np.zeros(margins)
    if from_prior:
        counts = {r.target: r.n for r in train.groupBy(F.col("target").cast("int").alias("target")).agg(F.count("*").alias("n")).collect()}
        share = np.array([max(counts.get(c, 0), 1e-10) for c in range(max(classes, 2))], float)
        share /= share.sum()
        base = np.log(share[1:] / share[:1]) if margins == 1 else np.log(share)
    root = new_folder(spark, "boosting")
    held = f"{root}/blocks-0"
    stored = _blocks(train, cuts, margins, base, held)
    numbers = stored.agg(F.sum(F.octet_length("bins"))).first()[0]
    if gathered(numbers):
        model = BoostedTrees.from_json(in_one_task(
            stored, lambda batches: BoostedTrees(cuts, base, _rounds(batches, dims, margins, growth)).to_json(),
        ))
        dropped(spark, root)
        return model
    model = BoostedTrees(cuts, base, [])
    since: list[list[Tree]] = []  # rounds that the stored margins lack
    blocks = cached(stored, numbers)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, margins * math.ceil(dims / FEATURES)))
    for round_ in range(growth.rounds):
        grower = _Grower(growth, margins)
        known: RDD | None = None  # histograms of nodes that may become parents
        passes: list[RDD] = []
        pairs = {(t, 0): (-1, -1) for t in range(margins)}
        while pairs:
            known = _merged(_histograms(blocks, grower, pairs, dims, margins), known, pairs, growth, tasks)
            passes.append(known)
            _take(grower, _splits(known))
            released(*passes[:-1])
            pairs = {}
            for t, i in grower.wanted():
                small, other = grower.open(t, i)
                pairs[t, small] = (i, other)
        released(*passes)
        trees = grower.finished()
        model.rounds.append(trees)
        since.append(trees)
        if _learned(trees):
            break
        if round_ + 1 == growth.rounds:
            break
        before = blocks
        if len(since) == STORE_ROUNDS:
            after = f"{root}/blocks-{round_ + 1}"
            stored = _stored(stored, since, dims, margins, after)
            dropped(spark, held)
            held, since, blocks = after, [], cached(stored, numbers)
        else:
            blocks = _after_round(before, trees, dims, margins)
        blocks.count()
        released(before)
    released(blocks)
    dropped(spark, root)
    return model


def _learned(trees: list[Tree]) -> bool:
    """Whether a round has found nothing left to learn."""
    return all(t.feature[0] < 0 and not abs(float(t.value[0])) > 1e-12 for t in trees)


def _rounds(batches, dims: int, margins: int, growth: Growth) -> list[list[Tree]]:
    """All rounds over the blocks of this task."""
    blocks = [block for batch in batches for block in _opened(batch, dims, margins)]
    bins, target, own = (np.concatenate(column) for column in zip(*blocks))
    del blocks
    out: list[list[Tree]] = []
    for _ in range(growth.rounds):
        gradient, curvature = _slopes(own, target, growth.wide)
        trees = [_tree(bins, gradient[:, t].copy(), curvature[:, t].copy(), own[:, t], growth) for t in range(margins)]
        out.append(trees)
        if _learned(trees):
            break
    return out


def _tree(bins: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, margin: np.ndarray, growth: Growth) -> Tree:
    """Grows one tree over the rows at hand and adds it to their margins."""
    grower, step = _Grower(growth, 1), np.arange(bins.shape[1]) * BINS
    rows = {0: np.arange(len(bins))}  # of each node
    known: dict[int, tuple] = {}  # histograms of nodes that may become parents
    pairs = {0: (-1, -1)}
    while pairs:
        splits = []
        for i, (parent, sibling) in pairs.items():
            pieces = (rows[i][first : first + PIECE_ROWS] for first in range(0, len(rows[i]), PIECE_ROWS))
            hist = sum(_histogram(bins[here] + step, gradient[here], curvature[here]) for here in pieces).reshape(3, -1, BINS)
            found = [(i, hist)]
            if parent >= 0:
                found.append((sibling, _rest(_unpacked(known.pop(parent)), hist)))
            for node, sums in found:
                best = _best_split(sums, growth, 0)
                splits.append(SPLIT(0, 0, node, *best, *sums[:, 0].sum(axis=1).tolist()))
                if best[0] > 0:
                    known[node] = _packed(sums)
        _take(grower, splits)
        pairs = {}
        for _, i in grower.wanted():
            n = grower.trees[0][i]
            small, other = grower.open(0, i)
            goes_left = bins[rows[i], n.feature] <= n.bin
            for child, goes in zip(n.children, (goes_left, ~goes_left)):
                rows[child] = rows[i][goes]
            pairs[small] = (i, other)
    (tree,) = grower.finished()
    ends = [0]
    while ends:
        i = ends.pop()
        if tree.feature[i] >= 0:
            ends += [tree.left[i], tree.right[i]]
        else:
            margin[rows[i]] += tree.value[i]
    return tree


def _take(grower: _Grower, rows: list) -> None:
    """Best splits over all parts of the features into their nodes; roots are made here."""
    for r in sorted(rows, key=lambda r: (r.tree, r.node, r.part)):
        nodes = grower.trees[r.tree]
        if not nodes:
            nodes.append(Node(r.total_g, r.total_h, int(r.total_n)))
        n = nodes[r.node]
        if r.gain > n.gain and r.gain > 0:
            n.gain, n.feature, n.bin, n.parts = r.gain, r.feature, r.bin, (r.g, r.h, r.n)


def _stored(blocks: DataFrame, rounds: list[list[Tree]], dims: int, margins: int, folder: str) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(rounds)

    def run(batches):
        for batch in batches:
            for bins, target, own in _opened(batch, dims, margins):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in (bins, target, _advanced(bins, own, shared.value))],
                    names=["bins", "target", "margins"],
                )

    blocks.mapInArrow(run, blocks.schema).write.parquet(folder)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(folder)
