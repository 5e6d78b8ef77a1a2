import csv
import random

import pytest
from pyspark.sql import functions as F

from layerlens.sources import labelled, quoted


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "797", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def texts(seed, n):
    draw = random.Random(seed)
    words = ["a", 'say "x"', "new\nline", "\n\n", ",", '"', "é", "", "tab\t", 'end"', '5" disk', "long " * 60]
    return [" ".join(draw.choices(words, k=draw.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_give_the_rows_of_one_task(spark, tmp_path, small_ranges, end):
    for part in range(2):
        with open(tmp_path / f"part-{part}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["text", "label"])
            writer.writerows([t, i] for i, t in enumerate(texts(part, 150)))
    got = quoted.read_quoted(spark, str(tmp_path))
    rows = got.orderBy("_at").collect()
    want = [(t or None, str(i)) for part in range(2) for i, t in enumerate(texts(part, 150))]
    assert [(r.text or None, r.label) for r in rows] == want
    assert len({r._at for r in rows}) == len(rows)
    one = spark.read.options(**labelled.CSV_OPTIONS).csv(str(tmp_path))
    assert one.exceptAll(got.drop("_at")).count() == 0 == got.drop("_at").exceptAll(one).count()
    ranges = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    assert ranges > 10


def test_quotes_inside_unquoted_fields_are_text(spark, tmp_path, small_ranges):
    rows = [f'{i},a 5" disk,"x,\n""{i}"\n' for i in range(40)]
    (tmp_path / "d.csv").write_text("id,text,more\n" + "\n".join(rows))
    got = quoted.read_quoted(spark, str(tmp_path / "d.csv")).orderBy("_at").collect()
    assert [(r.id, r.text, r.more) for r in got] == [(str(i), 'a 5" disk', f'x,\n"{i}') for i in range(40)]


def test_one_text_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line, of \"it\"\n" * 300
    with open(tmp_path / "d.csv", "w", newline="") as out:
        csv.writer(out).writerows([["text", "label"], ["a", 1], [long, 2], ["b", 3]])
    got = quoted.read_quoted(spark, str(tmp_path / "d.csv")).orderBy("_at").collect()
    assert [(r.text, r.label) for r in got] == [("a", "1"), (long, "2"), ("b", "3")]


def test_edges(spark, tmp_path, small_ranges):
    (tmp_path / "header.csv").write_text("text,label\n")
    assert quoted.read_quoted(spark, str(tmp_path / "header.csv")).collect() == []
    (tmp_path / "short.csv").write_text('text,label\n\nonly\n\n"",2\n,3\nx,4,5\n')
    got = quoted.read_quoted(spark, str(tmp_path / "short.csv")).orderBy("_at").drop("_at")
    one = spark.read.options(**labelled.CSV_OPTIONS).csv(str(tmp_path / "short.csv"))
    assert got.collect() == one.collect()
    (tmp_path / "open.csv").write_text('text,label\na,1\n"never closed,2\n' + "b,3\n" * 60)
    rows = quoted.read_quoted(spark, str(tmp_path / "open.csv")).orderBy("_at").collect()
    assert rows[0].text == "a" and len(rows) == 2 and rows[1].text.startswith("never closed,2\nb,3")


def test_states_compose_over_ranges(spark):
    draw = random.Random(4)
    kinds = [(False, True), (True, False), (False, False), (True, True)]
    states = [(f"f{i % 2}", i * 10, 1000, *draw.choice(kinds)) for i in range(200)]
    got = quoted.opening_states(spark.createDataFrame(states, quoted.STATES)).collect()
    want, now = {}, {"f0": False, "f1": False}
    for path, start, _, outside, inside in states:
        want[path, start] = now[path]
        now[path] = inside if now[path] else outside
    assert {(r.path, r.start): r.opens_inside for r in got} == want
    assert {r.base for r in got if r.path == "f1"} == {1000}


def test_datasets_with_large_files_keep_line_order(spark, tmp_path, small_ranges):
    for split, seed in (("train", 1), ("test", 2)):
        with open(tmp_path / f"d_{split}.csv", "w", newline="") as out:
            csv.writer(out).writerows([["text", "label"], *[[t + ".", i] for i, t in enumerate(texts(seed, 80))]])
    rows = labelled.read_dataset(spark, str(tmp_path), "d")
    got = [(r.split, r.text, r.label) for r in rows.orderBy("id").collect()]
    assert got == [(s, t + ".", i) for s, seed in (("train", 1), ("test", 2)) for i, t in enumerate(texts(seed, 80))]
    assert rows.select("id").distinct().count() == 160
    assert labelled.head(rows, 3).filter(F.col("split") == "test").agg(F.max("label")).first()[0] == 2
