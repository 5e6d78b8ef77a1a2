import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from layerlens.functions.text import STOP_WORDS, word_count
from layerlens.operators import profile

TEXTS = [
    (5, "a", "The red fox and the red hen", "x"),
    (9, "a", "", "x"),
    (12, "a", "the and of", "y"),
    (20, "a", "Hen red fox", "y"),
    (21, "a", " fox red fox\x1cowl ", "y"),
    (-3, "a", "red", "x"),
    (2**60, "a", "last hen", "x"),
    (7, "b", "red fox", "x"),
]
COLUMNS = "id long, dataset string, text string, label string"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, COLUMNS).repartition(3)


def _kept(dataset):
    rows = sorted(r for r in TEXTS if r[1] == dataset)
    return [w for r in rows for w in r[2].split() if w.lower() not in STOP_WORDS]


def test_words_split_like_python(spark):
    texts = ["", " ", "a", " a  b\tc\n", "a b c\x1cd\x1f", "x　 y", "a\x85b", "a​b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", word_count(F.col("text")).alias("n")).collect()
    assert {r.text: r.n for r in got} == {t: len(t.split()) for t in texts}


@pytest.mark.parametrize("dataset", ["a", "b"])
def test_bigrams_cross_rows(texts, dataset):
    kept = _kept(dataset)
    want = Counter(zip(kept, kept[1:]))
    rows = profile.bigrams(texts, ["dataset"]).filter(F.col("dataset") == dataset).collect()
    assert Counter((r.first, r.second) for r in rows) == want


def test_top_words_ties_by_first_appearance(texts):
    want = Counter(_kept("a")).most_common(20)
    rows = profile.top_words(texts, ["dataset"]).filter("dataset = 'a'").orderBy("rank").collect()
    assert [(r.word, r.n) for r in rows] == want


def test_top_bigrams_order(texts):
    kept = _kept("a")
    want = [(" ".join(p), n) for p, n in Counter(zip(kept, kept[1:])).most_common(20)]
    rows = profile.top_bigrams(texts, ["dataset"]).filter("dataset = 'a'").orderBy("rank").collect()
    assert [(r.bigram, r.n) for r in rows] == want


def _counted_tables(monkeypatch):
    kept, write = [], profile.written

    def written(df, name):
        out = write(df, name)
        kept.append((name, out))
        return out

    monkeypatch.setattr(profile, "written", written)
    return lambda: [df.count() for name, df in kept if name == "bigram-counts"]


def _bigram_rows(spark):
    # Rare bigrams of numbers, a common one, and two equally common ones, in a null dataset too.
    texts = [f"x{i} y{i} z{i} v{i}" for i in range(400)] + ["red hat"] * 9 + ["blue cup"] * 5 + ["old car"] * 5
    rows = [(i, d, t, "l") for d in ("a", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i + 10_000 * (d is None), d, t, l) for i, d, t, l in rows], COLUMNS)


def test_top_bigrams_count_few_of_the_rare(spark, monkeypatch):
    counted = _counted_tables(monkeypatch)
    rows = profile.top_bigrams(_bigram_rows(spark), ["dataset"], limit=3).collect()
    for dataset in ("a", None):
        found = sorted((r.rank, r.bigram, r.n) for r in rows if r.dataset == dataset)
        if dataset:
            assert found == [(1, "red hat", 9), (2, "hat red", 8), (3, "blue cup", 5)]
        else:
            assert found[0] == (1, "red hat", 9)
    assert sum(counted()) < 400


@pytest.mark.parametrize("slots", [1, 2, 64])
def test_top_bigrams_any_slots(spark, monkeypatch, slots):
    want = sorted(map(tuple, profile.top_bigrams(_bigram_rows(spark), ["dataset"], limit=3).collect()), key=str)
    counted = _counted_tables(monkeypatch)
    monkeypatch.setattr(profile, "SLOTS", slots)
    monkeypatch.setattr(profile, "FULLEST", 0 if slots == 2 else 1)
    rows = profile.top_bigrams(_bigram_rows(spark), ["dataset"], limit=3).collect()
    assert sorted(map(tuple, rows), key=str) == want
    assert len(counted()) == (1 if slots == 1 else 2)


def test_equal_lengths(spark):
    rows = spark.createDataFrame([(i, "d", "one two", "x") for i in range(5)], COLUMNS)
    bins = profile.length_histogram(rows, ["dataset"], "n_words").collect()
    assert len(bins) == 50 and sum(b.n for b in bins) == 5
    assert min(b.left for b in bins) == 1.5 and math.isclose(max(b.right for b in bins), 2.5)
    assert profile.length_density(rows, ["dataset"], "n_words").count() == 0


def test_histogram_counts_every_row_once(spark):
    rows = spark.createDataFrame([(i, "d", "w " * (i % 301), "x") for i in range(1000)], COLUMNS)
    bins = profile.length_histogram(rows, ["dataset"], "n_words").collect()
    assert len(bins) == 50 and sum(b.n for b in bins) == 1000
    for b in bins:
        inside = [i for i in range(1000) if b.left <= i % 301 < b.right or (b.bin == 49 and i % 301 == 300)]
        assert len(inside) == b.n


def test_single_row_has_no_deviation(spark):
    rows = spark.createDataFrame([(1, "d", "one", "x")], COLUMNS)
    row = profile.length_spread(rows, ["dataset"]).first()
    assert row.std_length_words is None and row.median_length_words == 1.0


def test_whisker_stays_outside_box(spark):
    rows = [(i, "d", "w " * n, "x") for i, n in enumerate([1, 1, 1, 1, 100])]
    box = profile.box_statistics(spark.createDataFrame(rows, COLUMNS), ["dataset"]).first()
    assert (box.q1, box.q3, box.whisker_low, box.whisker_high, box.outliers) == (1, 1, 1, 1, 1)


def test_word_figures_cannot_overflow(spark):
    """First appearances of the largest ids still compare exactly."""
    big = 2**63 - 1
    rows = [(big, "d", "bee ant", "x"), (big - 1, "d", "cow", "x"), (-big, "d", "dog", "x")]
    got = profile.top_words(spark.createDataFrame(rows, COLUMNS), ["dataset"]).orderBy("rank")
    assert [r.word for r in got.collect()] == ["dog", "cow", "bee", "ant"]


def test_distinct_texts_exact_and_estimated(spark):
    rows = [(i, "d", f"text {i % 500}", "x") for i in range(1500)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert profile.distinct_counts(df, ["dataset"]).first().num_unique_sentences == 500
    estimate = profile.distinct_counts(df, ["dataset"], 0.02).first().num_unique_sentences
    assert abs(estimate - 500) < 50
