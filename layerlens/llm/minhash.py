"""Near-duplicate documents by one-permutation MinHash.

A set is hashed once; bins of the hash range give one minimum each, and empty bins borrow from
a filled bin by a fixed random order of their own (optimal densification), so that short sets
have signatures as good as long ones. Bands of the signature name buckets. A bucket proposes
only edges from its members to one centre, a star, so a bucket of n sets makes n - 1 candidates
and never all pairs. Candidates are confirmed on the full sets.

A star misses a pair whose centre resembles only one of the two. So the sets in buckets that
still mix components are dealt again, into buckets split by two further bands and with other
centres, until a round finds no link, `MAX_ROUNDS` at most. What is still mixed then goes to an
exact join: of sets that share enough, the first few shingles in an order with the rare ones
first have one in common. Only pairs of different components that pass the bounds on length,
place and parity are compared. So a pair is lost only if its two sets share no bucket at all.

Equal sets are one node throughout; the copies join it again at the end.

What is stored of every document is a sketch of bounded size: its bands and the parity of its
members by slots, which bounds how far two sets differ. Only the sets of candidates that pass
that bound are made again from their texts, compared, and deleted. Texts are stored once in
buckets of their ids, so that they stay where they are and whole sets move for true or nearly
true links alone. Where whole documents are filtered, it is they that are stored so, and what is
kept of them is read from there: their texts move once, whatever the number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from layerlens.llm.common import NO_ID, fresh, map_arrow, window_hashes, word_hashes, mixed
from layerlens.llm.components import components
from layerlens.session import Scratch

WORDS = 2
PERCENT = 80
ROWS = 4
BANDS = 24
BINS = ROWS * BANDS
MAX_ROUNDS = 5
TURNS = 4
#: Counters for the order of the shingles, and bits of a set's parity in the exact join.
SLOTS = 1 << 20
BITS = 512
#: Bits of a sketch's parity per member, at least.
SKETCH_BITS = 2
#: Sets of one shingle that are met by one row of the other side, in the exact join.
CHUNK = 2000

_random = np.random.default_rng(5)
#: For every bin, the place of each other bin in its order of borrowing.
_ORDER = np.array([_random.permutation(BINS) for _ in range(BINS)])
_BAND_SALT = _random.integers(1, 2**63, BANDS).astype(np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the runs of `words` words, A-Z in lower case, sorted.

    A text of fewer words is one shingle; one without words has none.
    """
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(found), min(words, len(found))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS minima of a set that is not empty."""
    spread = mixed(hashes)
    bins = ((spread >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64)
    values = mixed(spread + np.uint64(1))
    minima = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(minima, bins, values)
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    if not filled.all():
        at = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        minima[empty] = minima[at[_ORDER[np.ix_(empty, at)].argmin(axis=1)]]
    return minima


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes).reshape(BANDS, ROWS)
    key = _BAND_SALT.copy()
    for r in range(ROWS):
        key = mixed(key ^ rows[:, r])
    return key.view(np.int64)


def sketch_parity(hashes: np.ndarray) -> bytes:
    """The parity of a set by slots, SKETCH_BITS to a member, a power of two and BITS at least.

    Folding it in half gives the parity of half as many slots.
    """
    bits = max(BITS, 1 << (SKETCH_BITS * len(hashes) - 1).bit_length())
    slots = (mixed(hashes) >> np.uint64(24)) & np.uint64(bits - 1)
    odd = np.bincount(slots.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the members that are in one of two sets only, by their parities."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def sketches_of(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, digest, bands, parity) from (id, text): an empty set has no digest."""
    schema = "id long, n long, digest binary, bands array<long>, parity binary"

    def run(batch):
        out = [[], [], [], []]
        for t in batch.column("text").to_pylist():
            members = shingles(t, words)
            some = len(members) > 0
            out[0].append(len(members))
            out[1].append(xxhash.xxh3_128_digest(members.tobytes()) if some else None)
            out[2].append(band_keys(members) if some else None)
            out[3].append(sketch_parity(members) if some else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
             pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())],
            names=["id", "n", "digest", "bands", "parity"],
        )

    return map_arrow(docs, run, schema)


def members_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, members) of the `wanted` (id, digest), made again from (id, text)."""

    def run(batch):
        found = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
        mine = [xxhash.xxh3_128_digest(m) == d for m, d in zip(found, batch.column("digest").to_pylist())]
        rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "members"])
        yield rows.filter(pa.array(mine, pa.bool_()))

    return map_arrow(docs.join(wanted.select("id", "digest"), "id").select("id", "text", "digest"), run, "id long, members binary")


def plausible(edges: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets can share `percent` by their sizes and parities; no link is lost."""
    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("left"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("right"))
    pairs = edges.join(one, "a").join(two, "b")

    def run(batch):
        columns = (batch.column(c).to_pylist() for c in ("na", "nb", "left", "right"))
        keep = [(100 + percent) * differing(x, y) <= (100 - percent) * (m + n) for m, n, x, y in zip(*columns)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, run, "a long, b long")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets share `percent` of their union or more."""
    one = sets.select(F.col("id").alias("a"), F.col("members").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("members").alias("right"))
    # Members first: each is in few edges. A centre's edges can be many, which adaptive
    # execution splits.
    pairs = edges.join(one, "a").join(two, "b").select("a", "b", "left", "right")

    def run(batch):
        keep = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, run, "a long, b long")


def tables(nodes: DataFrame, round_: int) -> DataFrame:
    """(key, id, n): the buckets of a round; a band's keys are like no other's.

    The first round has one bucket per band. The later ones split the buckets of a band by two
    other bands, TURNS times in other ways each round, so that buckets hold few and close sets.
    """
    if round_ == 0:
        keys = F.col("bands")
    else:
        def turned(by):
            def key(x, i):
                return F.xxhash64(x, F.element_at("bands", (i + by) % BANDS + 1), F.element_at("bands", (i + 2 * by + 1) % BANDS + 1))

            return F.transform("bands", key)

        keys = F.concat(*[turned(1 + (round_ - 1) * TURNS + t) for t in range(TURNS)])
    return nodes.select("id", "n", F.explode(keys).alias("key"))


def candidates(rows: DataFrame, roots: DataFrame | None, round_: int, percent: int) -> DataFrame:
    """Edges (a, b) from the members of each bucket to its centre, across components only."""
    rows = _rooted(rows, roots)
    # At first the same sets are centres in most of their buckets, which saves edges; later
    # every bucket draws its own.
    draw = F.xxhash64("id", F.lit(round_), *(["key"] if round_ else []))
    centres = rows.groupBy("key").agg(
        F.min(F.struct(draw, F.col("id"), F.col("n"), F.col("root"))).alias("c"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    ).where("low < high")
    centres = centres.select("key", F.col("c.id").alias("b"), F.col("c.n").alias("m"), F.col("c.root").alias("centre"))
    near = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    stars = rows.join(centres, "key").where((F.col("root") != F.col("centre")) & near)
    return stars.select(F.col("id").alias("a"), "b").distinct()


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    rows = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    return rows.withColumn("root", F.coalesce("root", "id"))


def _mixed(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The nodes in any bucket of the first round that still mixes components."""
    rows = _rooted(tables(nodes, 0), roots)
    many = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    many = many.where("low < high").select("key")
    ids = rows.join(many, "key", "left_semi").select("id").distinct()
    return nodes.join(ids, "id", "left_semi")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many of the sets the shingles of each slot are. Bounded by SLOTS on the driver."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                raw = b"".join(batch.column("members").slice(start, 1024).to_pylist())
                total += np.bincount(_slots(np.frombuffer(raw, np.uint64)), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = sets.select("members").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as longs; two sets differ in as many members as bits, at least."""
    odd = np.bincount((mixed(hashes) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(id, n, root, key, place, short, p0, ...): the first shingles of each set, rare ones first.

    Two sets that share `percent` share one of these; it is `short` in the one of fewer members.
    """
    words = [f"p{i}" for i in range(BITS // 64)]
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    schema = "id long, n long, root long, key long, place long, short boolean, " + ", ".join(f"{w} long" for w in words)

    def run(batch):
        counts = shared.value
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, keys, places, shorts, bits = [], [], [], [], []
            for raw in part.column("members").to_pylist():
                members = np.frombuffer(raw, np.uint64)
                n = len(members)
                most = n - max(-(-percent * n // 100), 1) + 1
                least = n - max(-(-2 * percent * n // (100 + percent)), 1) + 1
                order = np.lexsort((members, counts[_slots(members)]))[:most]
                sizes.append(len(order))
                keys.append(members[order].view(np.int64))
                places.append(np.arange(len(order)))
                shorts.append(places[-1] < least)
                bits.append(parity(members))
            own = [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes)) for c in ("id", "n", "root")]
            rows = [np.concatenate(x) for x in (keys, places, shorts)]
            bits = np.repeat(np.array(bits), sizes, axis=0)
            yield pa.RecordBatch.from_arrays(
                [*own, *map(pa.array, rows), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(words)))],
                names=["id", "n", "root", "key", "place", "short", *words],
            )

    return map_arrow(sets.select("id", "n", "root", "members"), run, schema)


def exact_candidates(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of (id, n, root, members): all pairs across components that can share `percent`.

    A shingle that many sets have is dealt over its turns, CHUNK of its short rows to each.
    """
    stored = rows = scratch.written(prefixes(sets, shingle_counts(sets), percent), "prefixes")
    groups = rows.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count_if("short").alias("shorts")
    ).where("low < high and shorts > 0")
    groups = scratch.written(groups.select("key", F.ceil(F.col("shorts") / CHUNK).alias("turns")), "shared")
    rows = rows.join(groups, "key")
    words = [c for c in rows.columns if c[0] == "p" and c[1:].isdigit()]
    longer = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    shorter = rows.where("short").select(
        "key", F.pmod(F.xxhash64("id", "key"), F.col("turns")).alias("turn"),
        *[F.col(c).alias(f"s_{c}") for c in ("id", "n", "root", "place", *words)],
    )
    both, share = F.col("n") + F.col("s_n"), F.lit(100 + percent)
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"s_{w}"))) for w in words), F.lit(0))
    left = F.least(F.col("n") - F.col("place"), F.col("s_n") - F.col("s_place"))
    pairs = longer.join(shorter, ["key", "turn"]).where(
        (F.col("root") != F.col("s_root")) & (F.col("s_n") <= F.col("n")) & (F.lit(100) * F.col("s_n") >= F.lit(percent) * F.col("n"))
        & (share * left >= F.lit(percent) * both) & (share * differ <= F.lit(100 - percent) * both)
    )
    pairs = pairs.select(F.greatest("id", "s_id").alias("a"), F.least("id", "s_id").alias("b")).distinct()
    out = scratch.written(pairs, "exact")
    scratch.drop(stored, groups)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    words: int = WORDS, percent: int = PERCENT, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    Null, empty and blank texts have no shingle and no links. Rows that share an id are one
    node; a null id is one node of its own (the least). An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    texts = scratch.bucketed(docs.select(_node(F.col(doc_id)).alias("id"), F.col(text).alias("text")), "id", "texts")
    out = _near_duplicates(texts, words, percent, max_rounds, scratch)
    scratch.keep(out)
    return out


def _node(doc_id: Column) -> Column:
    """The id of a document's node."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def _near_duplicates(texts: DataFrame, words: int, percent: int, max_rounds: int, scratch: Scratch) -> DataFrame:
    """As `near_duplicates`, from (id, text) in buckets of their ids; a table of `scratch`."""
    sketches = scratch.written(sketches_of(texts, words), "sketches")
    classes = scratch.written(
        sketches.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes"
    )
    # One row per class: the set of its least document.
    nodes = scratch.written(
        sketches.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(
            ["digest", "id"]
        ),
        "nodes",
    )
    roots = None

    def confirmed_links(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
        edges = scratch.written(edges, "edges")
        near = scratch.written(plausible(edges, nodes, percent), "near")
        scratch.drop(edges)
        made = None
        if members is None:
            ends = near.select(F.col("a").alias("id")).unionAll(near.select("b")).distinct()
            wanted = scratch.written(nodes.select("id", "digest").join(ends, "id", "left_semi"), "wanted")
            members = made = scratch.written(members_of(texts, wanted, words), "members")
            scratch.drop(wanted)
        found = scratch.written(confirmed(near, members, percent), "found")
        scratch.drop(near, made)
        return found

    def joined(found: DataFrame) -> DataFrame:
        links = found
        if roots is not None:
            links = links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        out = components(links, scratch)
        scratch.drop(found, roots)
        return out

    dealt = nodes.select("id", "n", "bands")
    for round_ in range(max_rounds):
        if round_ == 1:
            dealt = scratch.written(_mixed(dealt, roots), "mixed")
        found = confirmed_links(candidates(tables(dealt, round_), roots, round_, percent))
        if found.isEmpty():
            scratch.drop(found)
            break
        roots = joined(found)
    rest = scratch.written(_rooted(_mixed(dealt, roots).select("id", "n"), roots), "rest")
    if not rest.isEmpty():
        wanted = scratch.written(nodes.select("id", "digest").join(rest, "id", "left_semi"), "wanted")
        members = scratch.written(members_of(texts, wanted, words).join(rest, "id"), "rest-members")
        found = confirmed_links(exact_candidates(members, percent, scratch), members)
        if not found.isEmpty():
            roots = joined(found)
    out = sketches.select("id", "n", "digest").join(classes, "digest", "left")
    if roots is not None:
        out = out.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    component = F.coalesce("root", "rep", "id")
    whole = F.nullif(component, F.lit(NO_ID))
    return scratch.written(
        out.select(
            F.nullif("id", F.lit(NO_ID)).alias("id"), F.col("n").alias("n_shingles"),
            whole.alias("component_id"), (F.col("id") == component).alias("kept"),
        ),
        "near-duplicates",
    )


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                     percent: int = PERCENT, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The documents that are the least of their component, with all their columns.

    They are stored once, in buckets of their ids, and stay where they are until the result is read.
    """
    scratch = Scratch(docs.sparkSession)
    (own,) = fresh(docs, "id")
    stored = scratch.bucketed(docs.withColumn(own, _node(F.col(f"`{doc_id}`"))), own, "documents")
    texts = stored.select(F.col(own).alias("id"), F.col(f"`{text}`").alias("text"))
    found = _near_duplicates(texts, words, percent, max_rounds, scratch)
    gone = scratch.written(found.where(~F.col("kept")).select(F.col("id").alias(own)).distinct(), "gone")
    scratch.keep(stored, gone)
    return stored.join(gone, own, "left_anti").select(*[f"`{c}`" for c in docs.columns])
