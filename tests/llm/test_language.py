import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.llm import language, queries
from layerlens.llm.common import table

SF = "/root/testdata/sf0.01"


def test_viterbi_by_all_labellings():
    rng = np.random.default_rng(1)
    for switch in (0.0, 0.7, 3.0):
        lengths = np.array([4, 0, 1, 6, 2])
        scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
        got, at = language.viterbi(scores, lengths, switch), 0
        for n in lengths:
            own = scores[at : at + n].astype(float)

            def worth(labels):
                return sum(own[i, l] for i, l in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))

            best = max(itertools.product(range(3), repeat=int(n)), key=worth)
            assert worth(got[at : at + n].tolist()) == pytest.approx(worth(best), abs=1e-5)
            at += n


def test_grams_of_each_word():
    """Every word gives its runs of 1 to 4 letters with its edges, and itself; alone or among others."""
    words = ["a", "ab", "wörter", "中文"]
    at, slots = language.slots_of(words)
    for i, w in enumerate(words):
        edged = f" {w} "
        runs = sum(max(len(edged) - n + 1, 0) for n in (2, 3, 4)) + len(w)
        assert (at == i).sum() == runs + 1
        alone = language.slots_of([w])[1]
        assert sorted(slots[at == i]) == sorted(alone)


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, SF, "documents")
    return language.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def _one(spark, model, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, name = language.identify(rows, model, **options)
    return [r[name] for r in out.orderBy("doc_id").collect()]


def test_held_out_accuracy(spark):
    found = queries.op12_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("hits"), F.count("*").alias("n")).first()
    assert row.n > 200 and row.hits >= 0.98
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()


def test_spans_of_a_mixed_text(spark, model):
    by_lang = {
        r.lang: r.text for r in table(spark, SF, "documents").groupBy("lang").agg(
            F.max_by("text", F.when(F.length("text").between(300, 600) & (F.crc32(F.col("doc_id").cast("string")) % 4 == 2), -F.col("doc_id"))).alias("text")
        ).collect()
    }
    text = "\n".join(by_lang[l] for l in ("en", "de", "es"))
    (got,) = _one(spark, model, text)
    assert [s.lang for s in got.spans] == ["en", "de", "es"] and got.n_spans == 3
    cut = len(by_lang["en"])
    assert abs(got.spans[0].end - cut) < 40 and abs(got.spans[1].start - cut) < 40
    assert language.WORD.findall(text[got.spans[1].start : got.spans[1].end])


def test_scripts_narrow_the_candidates(spark):
    rows = [(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en"), (3, "γειά σου κόσμε", "el"), (4, "你好世界再见朋友", "zh")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = _one(spark, model, "жбанъ щука", "xylophone", "ψωμί", "龍馬精神 你", "мир " * 6 + "world " * 6)
    assert [g.lang for g in got[:4]] == ["ru", "en", "el", "zh"]
    assert [s.lang for s in got[4].spans] == ["ru", "en"]
    assert language.NAMES[language.script_of("ж")] == "cyrillic"


def test_nulls_repeats_long_and_empty_texts(spark, model):
    got = _one(spark, model, None, "", " 12 34 !? \n", "the the", "the the", "the " * 60_000)
    assert [(g.lang, g.score, g.n_spans) for g in got[:3]] == [("und", 0.0, 0)] * 3
    assert got[3] == got[4] and got[3].lang == got[5].lang == "en"
    assert [g.spans for g in _one(spark, model, "the", spans=False)] == [None]


def test_steps_do_not_change_the_result(spark, model, monkeypatch):
    texts = [r.text for r in table(spark, SF, "documents").limit(30).collect()]
    whole = _one(spark, model, *texts)
    monkeypatch.setattr(language, "STEP_NUMBERS", 500)
    monkeypatch.setattr(language, "MEMO_WORDS", 50)
    assert _one(spark, model, *texts) == whole


def test_nothing_learned_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language.learn(empty)
    assert nothing.languages == [] and _one(spark, nothing, "some words")[0].lang == "und"
    rows = spark.createDataFrame([(1, "a word", "x", None)], "doc_id long, text string, language string, lang string")
    assert language.learn(rows).languages == []
    model = language.learn(rows.withColumn("lang", F.lit("xx")))
    out, name = language.identify(rows, model)
    row = out.first()
    assert row.language == "x" and name != "language" and row[name].lang == "xx"
