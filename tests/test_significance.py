import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from layerlens.functions.pvalues import normal_two_sided, student_two_sided
from layerlens.operators import significance

COLUMNS = "layer int, probe string, id long, y_pred int, y_true int"


@pytest.mark.parametrize("t,freedom,p", [
    (2.228, 10, 0.05), (3.169, 10, 0.01), (12.706, 1, 0.05), (1.984, 100, 0.05), (2.626, 100, 0.01)])
def test_student_textbook_values(spark, t, freedom, p):
    got = spark.range(1).select(student_two_sided(F.lit(t), F.lit(float(freedom)))).first()[0]
    assert got == pytest.approx(p, abs=1e-4)


def test_student_closed_forms(spark):
    ts = [0.0, 0.3, 1.0, 5.0, 40.0, 3000.0]
    df = spark.createDataFrame([(t,) for t in ts], "t double")
    one = [r[0] for r in df.select(student_two_sided(F.col("t"), F.lit(1.0))).collect()]
    assert one == pytest.approx([1 - 2 / math.pi * math.atan(t) for t in ts], rel=1e-6)
    two = [r[0] for r in df.select(student_two_sided(F.col("t"), F.lit(2.0))).collect()]
    assert two == pytest.approx([1 - t / math.sqrt(t * t + 2) for t in ts], rel=1e-5, abs=1e-12)


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.959964, 4.0, 9.0, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(normal_two_sided(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-5)


def _rows(seed, probes="abc", n=80):
    rng = random.Random(seed)
    return [(0, p, i, int(rng.random() < 0.6), 1) for p in probes for i in range(n)]


def _differences(rows, one, two):
    right = {(p, i): int(y == t) for _, p, i, y, t in rows}
    ids = {i for _, p, i, _, _ in rows if p == one} & {i for _, p, i, _, _ in rows if p == two}
    return [right[one, i] - right[two, i] for i in sorted(ids)]


@pytest.mark.parametrize("probes", [None, "abc"])
def test_tests_match_general_formulas(spark, probes):
    rows = _rows(1)
    aligned = spark.createDataFrame(rows, COLUMNS).repartition(4)
    pairs = significance.discordance(aligned, ["layer"], probes)
    got = {(r.probe_1, r.probe_2): r for r in significance.test_table(pairs, ["layer"]).collect()}
    assert set(got) == set(combinations("abc", 2))
    for (one, two), row in got.items():
        d = _differences(rows, one, two)
        n, mean = len(d), sum(d) / len(d)
        sd = math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1))
        assert row.t_stat == pytest.approx(mean / (sd / math.sqrt(n)))
        kept = [x for x in d if x]
        m = len(kept)
        rank = (m + 1) / 2  # all tied
        plus, minus = (rank * sum(x == s for x in kept) for s in (1, -1))
        assert row.wilcoxon_stat == min(plus, minus)
        variance = m * (m + 1) * (2 * m + 1) / 24 - (m**3 - m) / 48
        z = (plus - m * (m + 1) / 4) / math.sqrt(variance)
        assert row.wilcoxon_p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-5)


def test_swapped_names_flip_t_only(spark):
    rows = _rows(2, "ab")
    swapped = [(x, {"a": "b", "b": "a"}[p], i, y, t) for x, p, i, y, t in rows]
    first, second = (
        significance.test_table(
            significance.discordance(spark.createDataFrame(r, COLUMNS), ["layer"]), ["layer"]
        ).first()
        for r in (rows, swapped)
    )
    assert first.t_stat == pytest.approx(-second.t_stat)
    assert first.wilcoxon_stat == second.wilcoxon_stat


def test_equal_and_opposite_probes(spark):
    same = [(0, p, i, 1, 1) for p in "ab" for i in range(5)]
    row = significance.test_table(
        significance.discordance(spark.createDataFrame(same, COLUMNS), ["layer"]), ["layer"]
    ).first()
    assert (row.t_stat, row.t_p_value, row.wilcoxon_stat, row.wilcoxon_p_value) == (0, 1, 0, 1)
    opposite = [(0, p, i, int(p == "a"), 1) for p in "ab" for i in range(5)]
    row = significance.test_table(
        significance.discordance(spark.createDataFrame(opposite, COLUMNS), ["layer"]), ["layer"]
    ).first()
    assert (row.t_stat, row.t_p_value) == (math.inf, 0)


@pytest.mark.parametrize("probes", [None, "ab"])
def test_only_common_rows_count(spark, probes):
    rows = [(0, "a", i, 1, 1) for i in range(10)] + [(0, "b", i, 0, 1) for i in range(5, 20)]
    row = significance.discordance(spark.createDataFrame(rows, COLUMNS), ["layer"], probes).first()
    assert (row.n, row.b, row.c) == (5, 5, 0)
