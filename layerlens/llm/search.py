"""Ranked lexical search of many queries at once, by shared partial scores.

Queries share terms, and often sets of terms. A query's terms, repeats included, are symbols
(term, k-th occurrence); a score is the sum of its symbols' values in a document. Symbols that
the same queries hold are joined first, then again and again the pair of nodes that most
queries share, each becoming a node of its own: a query-sharing graph whose inner nodes are
partial accumulators and whose last nodes are the queries. A document's accumulators are
computed once, level by level of the graph, for all queries that use them.

Documents are never shuffled. Each task reads its documents once for the corpus counts and once
for the scores, keeps the best of each query, and hands on that many rows per query. Queries
too many for one graph are dealt to several, each with its own two reads.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from layerlens.llm.common import column_bytes

TOP = 20
#: Terms of the queries in one graph, about; it is sent to every task.
GRAPH_TERMS = 200_000
#: Numbers in a task's table of accumulators.
TABLE_NUMBERS = 8_000_000
#: Groups of tasks whose best rows are merged before the last ranking.
MERGES = 64

# Of the ASCII characters only digits and letters belong to terms; A-Z are lowered.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
# The score's constants.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 12, 25


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return text.translate(_TERM_BYTES).split() if text else []


@dataclass
class Graph:
    """The shared accumulators of some queries.

    Node i < len(symbols) is the symbol of the term symbols[i]. Each level lists nodes of two
    parents, all of lower levels. `ends` has each query's last node, -1 without terms.
    """

    symbols: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    ends: np.ndarray
    size: int


def share(queries: list[list[int]]) -> Graph:
    """The graph of queries given as term numbers, repeats included.

    Pairs are joined while two queries or more share one; then each query adds up what is left.
    """
    sets: list[set] = []
    for query in queries:
        seen: Counter = Counter()
        own = set()
        for term in query:
            own.add((term, seen[term]))
            seen[term] += 1
        sets.append(own)
    holders = defaultdict(list)
    for q, own in enumerate(sets):
        for symbol in own:
            holders[symbol].append(q)
    # Occurrences of a term have equal values, so a node per symbol costs nothing but its row.
    number = {symbol: i for i, symbol in enumerate(sorted(holders))}
    size = len(number)
    nodes: list[tuple[int, int]] = []  # parents of the nodes after the symbols
    depth = [0] * size

    def add(a: int, b: int) -> int:
        nodes.append((a, b))
        depth.append(1 + max(depth[a], depth[b]))
        return size + len(nodes) - 1

    def total(parts: list[int]) -> int:
        """One node for all parts, the shallow ones first."""
        heap = [(depth[p], p) for p in parts]
        heapq.heapify(heap)
        while len(heap) > 1:
            made = add(heapq.heappop(heap)[1], heapq.heappop(heap)[1])
            heapq.heappush(heap, (depth[made], made))
        return heap[0][1]

    # Symbols with the same queries.
    alike = defaultdict(list)
    for symbol, own in holders.items():
        alike[tuple(own)].append(number[symbol])
    left: list[set[int]] = [set() for _ in queries]
    uses: dict[int, set[int]] = {}
    for own, symbols in alike.items():
        node = total(sorted(symbols))
        for q in own:
            left[q].add(node)
        if len(own) > 1:
            uses[node] = set(own)
    # Pairs shared by most queries, counted again when they come up, as counts only fall.
    heap: list[tuple[int, int, int]] = []

    def offer(node: int) -> None:
        met: Counter = Counter()
        for q in uses[node]:
            met.update(n for n in left[q] if n in uses and n != node)
        for other, n in met.items():
            if n > 1 and (other < node or node >= size + offered):
                heapq.heappush(heap, (-n, min(node, other), max(node, other)))

    offered = len(nodes)
    for node in sorted(uses):
        offer(node)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = uses[a] & uses[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), a, b))
            continue
        made = add(a, b)
        for q in both:
            left[q] -= {a, b}
            left[q].add(made)
        uses[a] -= both
        uses[b] -= both
        uses[made] = both
        offer(made)
    ends = np.array([total(sorted(own)) if own else -1 for own in left], np.int64)
    by_depth = defaultdict(list)
    for i, (a, b) in enumerate(nodes):
        by_depth[depth[size + i]].append((size + i, a, b))
    levels = [tuple(np.array(x, np.int64) for x in zip(*by_depth[d])) for d in sorted(by_depth)]
    symbols = np.array([symbol[0] for symbol in sorted(holders)], np.int64)
    return Graph(symbols, levels, ends, size + len(nodes))


def _counted(texts: list[bytes | None], known: dict[bytes, int]):
    """Per document its number of terms, and (document, known term, occurrences) as arrays."""
    lengths = np.zeros(len(texts), np.int64)
    at, ids = [], []
    for i, text in enumerate(texts):
        found = terms(text)
        lengths[i] = len(found)
        own = [k for k in map(known.get, found) if k is not None]
        at.append(np.full(len(own), i))
        ids.append(np.array(own, np.int64))
    if not texts:
        return lengths, *(np.empty(0, np.int64),) * 3
    pairs, n = np.unique(np.concatenate(at) * max(len(known), 1) + np.concatenate(ids), return_counts=True)
    return lengths, pairs // max(len(known), 1), pairs % max(len(known), 1), n


def corpus_counts(docs: DataFrame, text: str, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each known term)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        names, n, length = shared.value, 0, 0
        held = np.zeros(len(names), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                lengths, _, ids, _ = _counted(column_bytes(batch.slice(start, 512), text), names)
                n, length = n + int((lengths > 0).sum()), length + int(lengths.sum())
                held += np.bincount(ids, minlength=len(names))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *at], pa.int64()), pa.array([n, length, *held[at]], pa.int64())], names=["term", "n"]
        )

    found = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist()))
    return counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(known))], np.int64)


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


class _Best:
    """The best rows of each query so far, by falling score and rising id."""

    def __init__(self, queries: int, top: int):
        self.top, self.rows, self.least = top, [[] for _ in range(queries)], np.ones(queries, np.int64)
        self.waiting = np.zeros(queries, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Scores by query and document."""
        for q in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)):
            at = np.flatnonzero(scores[q] >= self.least[q])
            self.rows[q].append((scores[q][at], nulls[at], ids[at]))
            self.waiting[q] += len(at)
            if self.waiting[q] >= 8 * self.top:
                self._prune(q)

    def _prune(self, q: int) -> None:
        score, null, doc = (np.concatenate(c) for c in zip(*self.rows[q]))
        keep = np.lexsort((doc, null, -score))[: self.top]
        self.rows[q], self.waiting[q] = [(score[keep], null[keep], doc[keep])], len(keep)
        if len(keep) == self.top:
            self.least[q] = score[keep[-1]]

    def all(self):
        for q, rows in enumerate(self.rows):
            if rows:
                self._prune(q)
                score, null, doc = self.rows[q][0]
                yield q, score, null, doc


def _best_rows(docs: DataFrame, doc_id: str, text: str, known: dict[bytes, int], graph: Graph,
               weight: np.ndarray, n_docs: int, length: int, top: int) -> DataFrame:
    """(query, doc, score): each task's best documents of each query."""
    shared = docs.sparkSession.sparkContext.broadcast((known, graph, weight))

    def run(batches):
        names, plan, w = shared.value
        best = _Best(len(plan.ends), top)
        step = max(1, min(512, TABLE_NUMBERS // max(plan.size, 1)))
        used = np.flatnonzero(plan.ends >= 0)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lengths, at, ids, tf = _counted(column_bytes(part, text), names)
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths[at] * n_docs) // length
                values = np.zeros((len(names), part.num_rows), np.int64)
                values[ids, at] = w[ids] * ((SCALE * tf) // (1000 * tf + SATURATION * m))
                table = np.empty((plan.size, part.num_rows), np.int64)
                table[: len(plan.symbols)] = values[plan.symbols]
                for made, a, b in plan.levels:
                    table[made] = table[a] + table[b]
                scores = np.zeros((len(plan.ends), part.num_rows), np.int64)
                scores[used] = table[plan.ends[used]]
                column = part.column(doc_id).cast(pa.int64())
                best.offer(scores, column.fill_null(0).to_numpy(zero_copy_only=False), np.array(column.is_null()))
        for q, score, null, doc in best.all():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), q)), pa.array(doc, mask=null.astype(bool)), pa.array(score)],
                names=["query", "doc_id", "score"],
            )

    return docs.select(doc_id, text).mapInArrow(run, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", graph_terms: int = GRAPH_TERMS) -> DataFrame:
    """The `top` best documents of every item: (item_id, rank, doc_id, score).

    Documents score above 0; equal scores go by rising doc_id, null last, and rows that share a
    doc_id each have a place of their own. Each row of `items` is a query of its own, also where
    rows or ids repeat; null and empty texts on either side have no terms and no rows. Empty
    tables give an empty table.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About three bytes of text to a term at least, so no graph has many more than graph_terms.
    graphs = max(1, math.ceil(size / 3 / graph_terms))
    dealt = asked.withColumn("graph", F.pmod(F.xxhash64("item", "text"), F.lit(graphs)))
    out = None
    for g in range(graphs):
        rows = dealt.where(F.col("graph") == g).select("item", "text").orderBy("item", "text").collect()
        known: dict[bytes, int] = {}
        queries = [[known.setdefault(t, len(known)) for t in terms(r.text.encode() if r.text else None)] for r in rows]
        if not known:
            continue
        n_docs, length, held = corpus_counts(docs, text, known)
        if not n_docs:
            continue
        found = _best_rows(docs, doc_id, text, known, share(queries), weights(n_docs, held), n_docs, length, top)
        names = spark.createDataFrame([(g, q, r.item) for q, r in enumerate(rows)], "graph long, query long, item_id long")
        found = found.withColumn("graph", F.lit(g).cast("long")).join(names, ["graph", "query"])
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    out = out.withColumn("_merge", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES)))
    for by in (["graph", "query", "_merge"], ["graph", "query"]):
        place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        out = out.withColumn("rank", place).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")
