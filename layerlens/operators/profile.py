"""Profile of labelled text tables.

Every function takes `keys`, the columns that tell datasets apart, so one job profiles
any number of datasets. Length statistics come from frequency tables (how many rows have
each length), whose size follows the longest text and not the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from layerlens.functions.ordering import id_bucketizer, with_id_bucket
from layerlens.functions.sizing import small_side
from layerlens.functions.text import (
    STOP_WORDS,
    char_count,
    is_stop_word,
    kept_words,
    word_count,
    words,
)
from layerlens.session import written

BINS = 50
GRID = 200
QUARTERS = (0.25, 0.5, 0.75)
SLOTS = 1 << 16  # for the bigrams of each dataset
FULLEST = 8  # slots counted at first, per bigram asked for


def first_seen(row_id: Column, position: Column) -> Column:
    """The earliest (id, position) of a group, as one number.

    Spark aggregates numbers in a hash table; for a struct it would sort all words first.
    """
    span = F.lit(2**31).cast("decimal(10,0)")
    return F.min(row_id.cast("decimal(19,0)") * span + position)


def missing_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col("text").isNull()).alias("missing_text"),
        F.count_if(F.col("label").isNull()).alias("missing_label"),
    )


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["text", "label"])


def label_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label").cast("string"))


def with_lengths(df: DataFrame) -> DataFrame:
    return df.withColumn("n_words", word_count(F.col("text"))).withColumn(
        "n_chars", char_count(F.col("text"))
    )


def sample_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("num_samples"))


def length_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    aggregates = [
        f(column).alias(f"{f.__name__}_length_{unit}")
        for column, unit in (("n_words", "words"), ("n_chars", "chars"))
        for f in (F.avg, F.max, F.min)
    ]
    return with_lengths(df).groupBy(*keys).agg(*aggregates)


def _quartiles(value: Column, weight: Column) -> Column:
    return F.percentile(value, F.array(*map(F.lit, QUARTERS)), weight)


def length_spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviation, median and linear quartiles of the word counts."""
    counts = length_counts(df, keys, "n_words")
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("value"))
    square = F.sum(F.col("n") * F.col("value") * F.col("value").cast("double"))
    return (
        counts.groupBy(*keys)
        .agg(
            sample_deviation(n, total, square).alias("std_length_words"),
            _quartiles(F.col("value"), F.col("n")).alias("_q"),
        )
        .select(
            *keys,
            "std_length_words",
            F.col("_q")[1].alias("median_length_words"),
            F.col("_q")[0].alias("q25_words"),
            F.col("_q")[1].alias("q50_words"),
            F.col("_q")[2].alias("q75_words"),
        )
    )


def sample_deviation(n: Column, total: Column, square: Column) -> Column:
    """Sample standard deviation from counts and sums; null for a single row."""
    total, n = total.cast("double"), n.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(square - total * total / n, F.lit(0.0)) / (n - 1)))


def label_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def label_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of rows per label."""
    whole = F.sum("n").over(W.partitionBy(*keys))
    return label_counts(df, keys).select(
        *keys, "label", (F.col("n") / whole * 100).alias("percent")
    )


def distinct_counts(
    df: DataFrame, keys: list[str], relative_error: float | None = None
) -> DataFrame:
    """Distinct labels and texts. Texts are compared by digest, so only digests are moved.

    With a `relative_error` the texts are estimated from a sketch and not moved at all.
    """
    digest = F.unhex(F.sha2(F.col("text"), 256))
    if relative_error is None:
        texts = F.countDistinct(digest)
    else:
        texts = F.approx_count_distinct(digest, relative_error)
    return df.groupBy(*keys).agg(
        F.countDistinct("label").alias("num_unique_labels"), texts.alias("num_unique_sentences")
    )


def word_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every distinct word with its count and first appearance."""
    exploded = df.select(*keys, "id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return exploded.groupBy(*keys, "word").agg(
        F.count("*").alias("n"), first_seen(F.col("id"), F.col("pos")).alias("first_seen")
    )


def without_stop_words(df: DataFrame, keys: list[str], stop_words=STOP_WORDS) -> DataFrame:
    """One row per word that is not a stop word."""
    exploded = df.select(*keys, "id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return exploded.filter(~is_stop_word(F.col("word"), stop_words))


def vocabulary(df: DataFrame, keys: list[str], stop_words=STOP_WORDS) -> DataFrame:
    """Distinct words, all words, and the percentage of stop words."""
    plain = df.select(*keys, F.explode(words(F.col("text"))).alias("word"))
    counts = plain.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    stops = F.sum(F.when(is_stop_word(F.col("word"), stop_words), F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg(
        F.count("*").alias("vocab_size"),
        F.sum("n").alias("total_words"),
        (stops / F.sum("n") * 100).alias("stop_words_percent"),
    )


def _top(counts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("first_seen"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_words(
    df: DataFrame, keys: list[str], limit: int = 20, stop_words=STOP_WORDS
) -> DataFrame:
    """Most frequent words that are not stop words, ties by first appearance."""
    counts = word_counts(df, keys).filter(~is_stop_word(F.col("word"), stop_words))
    return _top(counts, keys, limit).select(*keys, "rank", "word", "n")


def bigrams(df: DataFrame, keys: list[str], stop_words=STOP_WORDS) -> DataFrame:
    """Neighbouring kept words, also from the last word of a row to the first of the next.

    Pairs inside a row need no shuffle. For pairs across rows only the outer words of each
    row are moved: rows are compared inside id-range buckets, and a bucket's last row with
    the head of the next filled bucket (one head per key and bucket).
    """
    kept = df.select(*keys, "id", kept_words(F.col("text"), stop_words).alias("kept"))
    pairs = F.greatest(F.size("kept") - 1, F.lit(0))
    inside = kept.select(
        *keys,
        "id",
        F.posexplode(
            F.arrays_zip(
                F.slice("kept", F.lit(1), pairs).alias("first"),
                F.slice("kept", F.lit(2), pairs).alias("second"),
            )
        ).alias("pos", "pair"),
    ).select(*keys, "id", "pos", "pair.first", "pair.second")

    ends = kept.select(
        *keys,
        "id",
        (F.size("kept") - 1).alias("pos"),
        F.get("kept", F.lit(0)).alias("head"),
        F.try_element_at("kept", F.lit(-1)).alias("tail"),
    )
    ends = written(with_id_bucket(ends, "id", id_bucketizer(df, "id", "bucket")), "row-ends")
    ends = ends.filter(F.col("head").isNotNull())
    heads = ends.groupBy(*keys, "bucket").agg(F.min_by("head", "id").alias("head"))
    following = heads.select(
        *keys,
        "bucket",
        F.lead("head").over(W.partitionBy(*keys).orderBy("bucket")).alias("next_head"),
    )
    in_order = W.partitionBy(*keys, "bucket").orderBy("id")
    across = (
        ends.withColumn("next", F.lead("head").over(in_order))
        .join(following, [*keys, "bucket"])
        .select(
            *keys,
            "id",
            "pos",
            F.col("tail").alias("first"),
            F.coalesce("next", "next_head").alias("second"),
        )
        .filter(F.col("second").isNotNull())
    )
    return inside.unionByName(across)


def _in_slots(df: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table whose keys, null or not, and slot are among the given ones."""
    names = [*keys, "slot"]
    slots = small_side(slots.select(*[F.col(c).alias(f"_{c}") for c in names]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return df.join(slots, reduce(Column.__and__, same), "left_semi")


def top_bigrams(
    df: DataFrame, keys: list[str], limit: int = 20, stop_words=STOP_WORDS
) -> DataFrame:
    """Most frequent bigrams, ties by first appearance.

    Most bigrams are rare, so they are not moved to be counted. Each falls into one of SLOTS
    slots, and no bigram is met more often than its slot. Those of the fullest slots are counted,
    then those of any other slot with as many as the last of the top ones has, ties included.
    """
    slot = F.pmod(F.xxhash64("first", "second"), F.lit(SLOTS))
    pairs = bigrams(df, keys, stop_words).withColumn("slot", slot)

    def counted(slots: DataFrame) -> DataFrame:
        found = _in_slots(pairs, slots, keys).groupBy(*keys, "first", "second")
        seen = first_seen(F.col("id"), F.col("pos")).alias("first_seen")
        return written(found.agg(F.count("*").alias("n"), seen), "bigram-counts")

    sizes = written(pairs.groupBy(*keys, "slot").agg(F.count("*").alias("size")), "bigram-slots")
    order = W.partitionBy(*keys).orderBy(F.col("size").desc(), "slot")
    sizes = sizes.withColumn("place", F.row_number().over(order))
    counts = counted(sizes.filter(F.col("place") <= FULLEST * limit))
    last = _top(counts, keys, limit).groupBy(*[F.col(c).alias(f"_{c}") for c in keys])
    last = last.agg(F.min("n").alias("least"), F.count("*").alias("ranked"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    others = sizes.filter(F.col("place") > FULLEST * limit).join(
        last, reduce(Column.__and__, same, F.lit(True)), "left"
    )
    enough = (F.col("ranked") >= limit) & (F.col("size") < F.col("least"))
    others = written(others.filter(~F.coalesce(enough, F.lit(False))).select(*keys, "slot"), "more-slots")
    if not others.isEmpty():
        counts = counts.unionByName(counted(others))
    return _top(counts, keys, limit).select(
        *keys, "rank", F.concat_ws(" ", "first", "second").alias("bigram"), "n"
    )


def length_counts(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """How many rows have each length."""
    value = {"n_words": word_count, "n_chars": char_count}[measure](F.col("text"))
    return df.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, keys: list[str], measure: str, bins: int = BINS) -> DataFrame:
    """Rows per equal-width bin between the shortest and the longest text.

    Bins are closed on the left, the last one on both sides; empty bins are listed too.
    """
    per_key = W.partitionBy(*keys)
    low, high = F.min("value").over(per_key), F.max("value").over(per_key)
    spread = high > low
    counts = (
        length_counts(df, keys, measure)
        .withColumn("low", F.when(spread, low.cast("double")).otherwise(low - 0.5))
        .withColumn("high", F.when(spread, high.cast("double")).otherwise(high + 0.5))
    )
    width = (F.col("high") - F.col("low")) / bins
    guess = F.floor((F.col("value") - F.col("low")) / width).cast("int")
    edge = lambda i: F.col("low") + i * width
    # The division may round across an edge, so the guess is checked against the edges.
    exact = (
        F.when(F.col("value") < edge(guess), guess - 1)
        .when(F.col("value") >= edge(guess + 1), guess + 1)
        .otherwise(guess)
    )
    binned = (
        counts.withColumn("bin", F.least(exact, F.lit(bins - 1)))
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"))
    )
    edges = (
        counts.groupBy(*keys)
        .agg(F.first("low").alias("low"), F.first("high").alias("high"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select(
            *keys, "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right")
        )
    )
    return edges.join(binned, [*keys, "bin"], "left").select(
        *keys, "bin", "left", "right", F.coalesce("n", F.lit(0)).alias("n")
    )


def length_density(df: DataFrame, keys: list[str], measure: str, grid: int = GRID) -> DataFrame:
    """Gaussian kernel density of the lengths on an even grid, Scott's bandwidth.

    `curve` is the density scaled to the histogram's area. Keys whose lengths are all
    equal have no bandwidth and give no rows.
    """
    per_key = W.partitionBy(*keys)
    n = F.sum("n").over(per_key)
    total = F.sum(F.col("n") * F.col("value")).over(per_key)
    square = F.sum(F.col("n") * F.col("value") * F.col("value").cast("double")).over(per_key)
    low, high = F.min("value").over(per_key), F.max("value").over(per_key)
    counts = (
        length_counts(df, keys, measure)
        .withColumn("rows", n)
        .withColumn("deviation", sample_deviation(n, total, square))
        .withColumn("low", low.cast("double"))
        .withColumn("high", high.cast("double"))
        .filter(F.col("deviation") > 0)
        .withColumn("bandwidth", F.col("deviation") * F.pow("rows", F.lit(-0.2)))
    )
    points = counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    x = F.col("low") + F.col("point") * ((F.col("high") - F.col("low")) / (grid - 1))
    points = points.withColumn("x", x)
    gap = (F.col("x") - F.col("value")) / F.col("bandwidth")
    kernel = F.sum(F.col("n") * F.exp(-gap * gap / 2))
    density = kernel / (F.first("rows") * F.first("bandwidth") * F.sqrt(F.lit(2.0) * F.pi()))
    area = F.first("rows") * ((F.first("high") - F.first("low")) / BINS)
    return points.groupBy(*keys, "point").agg(
        F.first("x").alias("x"), density.alias("density"), (density * area).alias("curve")
    )


def box_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 box heights) and outliers per label."""
    by = [*keys, "label"]
    counts = length_counts(df, by, "n_words")
    boxes = counts.groupBy(*by).agg(_quartiles(F.col("value"), F.col("n")).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    boxes = boxes.withColumn("low", F.col("q")[0] - reach).withColumn("high", F.col("q")[2] + reach)
    within = F.col("value").between(F.col("low"), F.col("high"))
    return (
        counts.join(boxes, by)
        .groupBy(*by)
        .agg(
            F.first("q").alias("q"),
            F.min(F.when(within, F.col("value"))).alias("whisker_low"),
            F.max(F.when(within, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(within, 0).otherwise(F.col("n"))).alias("outliers"),
        )
        .select(
            *by,
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q3"),
            # A whisker never ends inside the box.
            F.least("whisker_low", F.col("q")[0]).alias("whisker_low"),
            F.greatest("whisker_high", F.col("q")[2]).alias("whisker_high"),
            "outliers",
        )
    )


def _scalar_figures() -> list[Column]:
    lengths = [
        f(c).alias(f"{f.__name__}_length_{unit}")
        for c, unit in (("n_words", "words"), ("n_chars", "chars"))
        for f in (F.avg, F.max, F.min)
    ]
    return [
        F.count("*").alias("num_samples"),
        F.countDistinct("label").alias("num_unique_labels"),
        F.countDistinct("digest").alias("num_unique_sentences"),
        *lengths,
        F.stddev_samp("n_words").alias("std_length_words"),
        F.percentile("n_words", F.array(*map(F.lit, QUARTERS))).alias("q"),
    ]


def profile_report(df: DataFrame, keys: list[str], stop_words=STOP_WORDS) -> DataFrame:
    """All profile figures as rows of (keys, section, key, value).

    The texts are read twice: for a stored table of their lengths and digests, which the
    scalar and label figures come from, and for a stored table of word counts.
    """
    measures = with_lengths(label_as_text(df)).select(
        *keys,
        "label",
        F.col("text").isNull().alias("no_text"),
        "n_words",
        "n_chars",
        F.unhex(F.sha2(F.col("text"), 256)).alias("digest"),
    )
    measures = written(measures, "measures")
    missing = measures.groupBy(*keys).agg(
        F.count_if("no_text").alias("missing_text"),
        F.count_if(F.col("label").isNull()).alias("missing_label"),
    )
    complete = measures.filter(~F.col("no_text") & F.col("label").isNotNull())
    scalars = complete.groupBy(*keys).agg(*_scalar_figures())
    scalars = scalars.select(
        "*",
        F.col("q")[0].alias("q25_words"),
        F.col("q")[1].alias("median_length_words"),
        F.col("q")[2].alias("q75_words"),
    ).drop("q")
    counts = written(word_counts(complete_rows(df), keys), "words")
    stop = is_stop_word(F.col("word"), stop_words)
    stops = F.sum(F.when(stop, F.col("n")).otherwise(0))
    vocab = counts.groupBy(*keys).agg(
        F.count("*").alias("vocab_size"),
        (stops / F.sum("n") * 100).alias("stop_words_percent"),
    )

    def tall(wide: DataFrame) -> DataFrame:
        values = [c for c in wide.columns if c not in keys]
        as_double = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
        return as_double.unpivot(keys, values, "key", "value").select(
            *keys, F.lit("basic").alias("section"), "key", "value"
        )

    def listed(rows: DataFrame, section: str, key: str, value: str) -> DataFrame:
        value = F.col(value).cast("double").alias("value")
        return rows.select(*keys, F.lit(section).alias("section"), F.col(key).alias("key"), value)

    parts = [
        tall(missing),
        tall(scalars),
        tall(vocab),
        listed(label_counts(complete, keys), "label_count", "label", "n"),
        listed(label_shares(complete, keys), "label_percent", "label", "percent"),
        listed(_top(counts.filter(~stop), keys, 20), "top_word", "word", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)
