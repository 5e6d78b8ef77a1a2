"""Mixing sources to target weights by entropy balancing.

Rates r (how often a document is taken) should stay as close to 1 as the targets allow: they
minimise the entropy sum(size * (r log r - r + 1)) under one token constraint per source. The
dual is convex, its solution an exponential tilt r = exp(lambda_source); Newton steps on the
dual multipliers solve it, each step one pass of partial sums. The rates are then rounded to
whole copies: everyone gets floor(r), and the fraction goes to the documents with the smallest
draws of their source and size class. What a class takes too much or too little is carried to
the next smaller class, so that the end error is that of the smallest documents.

The texts are read once, for their sizes. Sums per (source, class, draw bucket) are partial
aggregates, so a hot source is spread like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from layerlens.llm.common import WORD, fresh
from layerlens.session import written

# The contract's repeating weights, share of all sizes, and limit per document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0

BUCKETS = 4096
CLASSES = 64
TOLERANCE = 1e-12
MAX_STEPS = 100


def size_of(text: Column) -> Column:
    """The number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source (one row each): source_size and target.

    Sources in code-point order, null last, weigh `weights` in turn. A target stops at `limit`
    times its source's size; what is left over is shared again by weight among the rest until
    none is above. Sorted by limit per weight, that is one running sum: the sources up to some
    place are at their limit, the others share alike.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()  # one row per source from here on, never per document
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(limit))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("total"),
        F.coalesce(F.sum("most").over(filled.rowsBetween(*before)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(filled.rowsBetween(*onward)).alias("rest"),
    )
    level = (F.col("total") - F.col("full")) / F.col("rest")
    per = per.withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("most")
    per = per.withColumn("first", F.min(F.when(free, F.col("level"))).over(everything))
    # Levels rise until the first free source and fall after it, so all sources before it are
    # at their limit.
    least = F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)
    per = per.withColumn("share", least["level"])
    return per.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("share") * F.col("weight"), "most"), F.col("most")).alias("target"),
    )


def tilts(per_source: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Adds `rate` = exp(multiplier) by Newton's method on the dual.

    The dual of a source is target * x - size * exp(x); gradient and curvature need the tilted
    token sum of the source, size * exp(x). Sources without tokens keep rate 0. Steps end when
    every tilted sum meets its target.
    """
    state = per_source.withColumn("x", F.lit(0.0))
    step = (F.col("target") - F.col("source_size") * F.exp("x")) / (F.col("source_size") * F.exp("x"))
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0)
    for _ in range(MAX_STEPS):
        # A long first step down would overshoot where the exponential is flat.
        state = written(
            state.withColumn("x", F.when(open_, F.col("x") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))).otherwise(F.lit(0.0))),
            "multipliers",
        )
        gap = F.abs(F.col("source_size") * F.exp("x") - F.col("target")) / F.col("target")
        worst = state.where(open_).agg(F.max(gap)).collect()[0][0]
        if worst is None or worst <= TOLERANCE:
            break
    rate = F.when(open_, F.least(F.exp("x"), F.lit(limit))).otherwise(F.lit(0.0))
    return state.withColumn("rate", rate).drop("x")


def draw_bucket(doc_id: Column, seed: int) -> Column:
    """The same bucket in every run, whatever the partitions; rows that share an id share it."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(BUCKETS)).cast("int")


def size_class(size: Column) -> Column:
    """Sizes within a factor of two share a class; greater sizes have greater classes."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(0).cast("int")


def cuts_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source's bucket sums: below which bucket each class takes one copy more.

    At most CLASSES * BUCKETS rows, whatever the number of documents. Classes are taken from
    the largest down; a class aims at its share plus what the classes before it left open.
    """
    rate = float(pdf["rate"].iloc[0])
    fraction = rate - np.floor(rate + 1e-9)
    cuts = np.zeros(CLASSES, np.int64)
    carried = 0.0
    if fraction > 1e-9:
        for c, part in sorted(pdf.groupby("class"), reverse=True):
            part = part.sort_values("bucket")
            reached = np.concatenate([[0], np.cumsum(part["size"].to_numpy(float))])
            wanted = fraction * reached[-1] + carried
            best = int(np.abs(reached - wanted).argmin())
            carried = wanted - reached[best]
            cuts[c] = 0 if best == 0 else int(part["bucket"].iloc[best - 1]) + 1
    out = pdf.iloc[:1][["source", "source_size", "target", "rate"]].copy()
    out["cuts"] = [cuts.tolist()]
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 9,
        keep=None) -> tuple[DataFrame, str]:
    """The kept columns (all if None) and a struct (size, source_size, target, rate, copies).

    Returned with the struct's name. `copies` says how often the mix takes the document: never
    more than `limit`, 0 for documents without words. Draws depend on the id alone, so reruns
    agree and rows that repeat an id are taken alike. Null texts have size 0, a null source is
    a source of its own, an empty table gives an empty table.
    """
    kept = docs.columns if keep is None else list(keep)
    name, own, size = fresh(docs, "mix", "own", "size")
    sizes = written(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")),
        "sizes",
    )
    per_source = tilts(targets(sizes, weights, share, limit), limit)
    sums = sizes.groupBy(
        "source", size_class(F.col("size")).alias("class"), draw_bucket(F.col("doc_id"), seed).alias("bucket")
    ).agg(F.sum("size").alias("size"))
    joined = sums.join(per_source.withColumnRenamed("source", own), F.col("source").eqNullSafe(F.col(own)))
    schema = "source string, source_size long, target double, rate double, cuts array<long>"
    cuts = written(joined.drop(own).groupBy("source").applyInPandas(cuts_of, schema), "cuts")
    # Stored, so that its size is known: one row per source, sent to all tasks only if small.
    cuts = cuts.withColumnRenamed("source", own)
    rows = sizes if keep is not None and set(kept) <= {doc_id, source} else docs
    if rows is sizes:
        rows = sizes.select(*[F.col("doc_id" if c == doc_id else "source").alias(c) for c in kept], F.col("size").alias(size))
        id_column = doc_id if doc_id in kept else None
    else:
        rows = docs.withColumn(size, size_of(F.col(text)))
        id_column = doc_id
    if id_column is None:
        raise ValueError("keep must hold the id")
    more = draw_bucket(F.col(id_column), seed) < F.element_at("cuts", size_class(F.col(size)) + 1)
    base = F.floor(F.col("rate") + 1e-9).cast("int")
    copies = F.when(F.col(size) > 0, base + more.cast("int")).otherwise(0)
    out = rows.join(cuts, F.col(source).eqNullSafe(F.col(own)))
    verdict = F.struct(
        F.col(size).alias("size"), "source_size", "target", "rate", copies.cast("int").alias("copies")
    )
    return out.select(*[f"`{c}`" for c in kept], verdict.alias(name)), name


def copied(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    mixed, name = mix(docs, **options)
    return mixed.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(f"`{name}`.copies")))).drop(name)
