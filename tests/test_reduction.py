import hashlib
import random

import pytest
from pyspark.sql import functions as F

from layerlens.functions import ordering, sizing
from layerlens.functions.ordering import with_draw_position, with_id_position
from layerlens.operators import reduction

COLUMNS = "id long, text string, label int"


def _draw(i, seed=42):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


def _quotas(rows, total):
    labels = list(dict.fromkeys(r[2] for r in sorted(rows)))
    sizes = {x: sum(r[2] == x for r in rows) for x in labels}
    quota = {x: int(total * (sizes[x] / len(rows))) for x in labels}
    rest = total - sum(quota.values())
    while rest:
        for x in labels:
            if rest:
                quota[x] += 1
                rest -= 1
    return quota


def _reduce(rows, total, limit):
    """The loop form of the selection: shortest rows until the mean would pass the limit."""
    kept = []
    for label, quota in _quotas(rows, total).items():
        mine = [(len(str(t).split()) if t is not None else 1, _draw(i), i) for i, t, x in rows if x == label]
        if sum(m[0] for m in mine) / len(mine) <= limit:
            kept += [m[2] for m in sorted(mine, key=lambda m: m[1:])[:quota]]
            continue
        words = 0
        for n, (size, _, i) in enumerate(sorted(mine)):
            words += size
            if n >= quota or words / (n + 1) > limit:
                break
            kept.append(i)
    return set(kept)


def _rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10_000), n):
        # A third of all rows is one label and has one length.
        if rng.random() < 0.33:
            rows.append((i, "w " * 9, 0))
        else:
            label = rng.choice([1, 2, 3])
            text = None if rng.random() < 0.05 else "w " * rng.randint(0, 12 * label)
            rows.append((i, text, label))
    return rows


@pytest.mark.parametrize("seed,total,limit", [(1, 100, 8.0), (2, 333, 5.0), (3, 50, 12.5), (4, 2, 9.0)])
def test_same_rows_as_the_loop(spark, seed, total, limit):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {r.id for r in reduction.sample_union(df, total, limit).select("id").collect()}
    assert got == _reduce(rows, total, limit)


def test_bounded_reduction_positions_and_mean(spark):
    rows = _rows(5)
    df = spark.createDataFrame(rows, COLUMNS)
    out = reduction.bounded_reduction(df, 120, 8.0).collect()
    ids = {r.id for r in out}
    assert ids == _reduce(rows, 120, 8.0)
    assert sorted(r.position for r in out) == list(range(1, len(out) + 1))
    assert [r.id for r in sorted(out, key=lambda r: r.position)] == sorted(ids, key=_draw)
    assert sum(r.n_words for r in out) / len(out) <= 8.0


def test_same_rows_without_small_tables(spark, monkeypatch):
    """Joins fall back to shuffles where a side is not small."""
    monkeypatch.setattr(sizing, "MAX_SMALL_ROWS", 0)
    rows = _rows(1)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.id for r in reduction.bounded_reduction(df, 100, 8.0).select("id").collect()}
    assert got == _reduce(rows, 100, 8.0)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 1)
    rows = _rows(2)
    df = spark.createDataFrame(rows, COLUMNS)
    out = reduction.bounded_reduction(df, 333, 5.0).collect()
    assert {r.id for r in out} == _reduce(rows, 333, 5.0)
    assert [r.id for r in sorted(out, key=lambda r: r.position)] == sorted((r.id for r in out), key=_draw)


def test_quotas_sum_to_total(spark):
    rows = _rows(6)
    df = spark.createDataFrame(rows, COLUMNS)
    for total in (1, 7, 100, 599, 600):
        got = {r.label: r.quota for r in reduction.label_quotas(reduction.measured(df), total).collect()}
        assert got == _quotas(rows, total) and sum(got.values()) == total


def test_total_larger_than_table(spark):
    df = spark.createDataFrame([(1, "a", 0)], COLUMNS)
    with pytest.raises(ValueError):
        reduction.bounded_reduction(df, 2, 10.0)


def test_shortfall_is_reported(spark):
    rows = [(i, "w " * (5 if i < 3 else 50), 0) for i in range(10)]
    df = spark.createDataFrame(rows, COLUMNS)
    after = reduction.reduction_summary(df, 8, 6.0).filter("stage = 'after'").first()
    assert (after.rows, after.shortfall) == (3, 5)


def test_positions_match_sorting(spark):
    ids = random.Random(7).sample(range(-(2**40), 2**40), 500) + [2**62, 2**62 + 1, 2**62 + 2]
    df = spark.createDataFrame([(i, _draw(i)) for i in ids], "id long, draw string").repartition(4)
    by_id = {r.id: r.position for r in with_id_position(df, "id").collect()}
    assert by_id == {i: n for n, i in enumerate(sorted(ids), 1)}
    by_draw = {r.id: r.position for r in with_draw_position(df, "draw", "id").collect()}
    assert by_draw == {i: n for n, i in enumerate(sorted(ids, key=_draw), 1)}


def test_random_quota_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(_rows(8), COLUMNS)
    picks = [
        {r.id for r in reduction.random_quota(df.repartition(n), 60).collect()} for n in (1, 7)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 60


def test_seed_changes_the_sample(spark):
    df = spark.createDataFrame(_rows(8), COLUMNS)
    picks = [{r.id for r in reduction.random_quota(df, 60, s).select(F.col("id")).collect()} for s in (1, 2)]
    assert picks[0] != picks[1]


def test_cut_where_the_mean_meets_a_fractional_limit(spark):
    """Every label is a case of its own, compared with the running mean row by row."""
    draw, limit, rows, want = random.Random(12), 12.2, [], {}
    cases = [[1, 3, 9, 16, 32, 40]] + [[draw.randint(1, 60) for _ in range(10)] for _ in range(60)]
    for label, sizes in enumerate(cases):
        words = kept = 0
        for size in sorted(sizes):
            if (words + size) / (kept + 1) > limit:
                break
            words, kept = words + size, kept + 1
        want[label] = kept
        rows += [(100 * label + i, label, size) for i, size in enumerate(sizes)]
    assert want[0] == 5
    lengths = spark.createDataFrame(rows, "id long, label int, n_words int")
    quotas = spark.createDataFrame([(x, 100) for x in want], "label int, quota long")
    freq = lengths.groupBy("label", "n_words").count()
    plan = {r.label: (r.limit_len, r.rest) for r in reduction._prefix_plan(lengths, quotas, limit).collect()}
    count = {(r.label, r.n_words): r["count"] for r in freq.collect()}
    for label, kept in want.items():
        limit_len, rest = plan.get(label, (0, 0))
        assert sum(n for (x, size), n in count.items() if x == label and size < limit_len) + rest == kept
