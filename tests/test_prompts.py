import pytest
from pyspark.sql import functions as F

from layerlens.operators import prompts
from layerlens.plans import jobs
from layerlens.plans.inputs import make_digest_encoder, make_word_rule


@pytest.mark.parametrize("kind", prompts.PROMPT_TYPES)
@pytest.mark.parametrize("task", prompts.TASKS)
def test_messages(spark, kind, task):
    df = spark.createDataFrame([(1, "a {text} 'b'")], "id long, text string")
    row = prompts.build(df, [kind], task).first()
    assert [m.role for m in row.messages] == ["system", "user", "assistant"]
    contents = [m.content for m in row.messages]
    assert "'a {text} 'b''" in contents[1]
    assert all("{examples}" not in c for c in contents)
    assert "{text}" not in contents[0] + contents[2]
    if kind == "Few-Shot":
        assert contents[1].count(" => ") == {"binary": 2, "emotion": 6}[task]


def test_unknown_names(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    for kind, task in (("CoT2", "binary"), ("CoT", "topic")):
        with pytest.raises(ValueError):
            prompts.build(df, [kind], task)
    with pytest.raises(ValueError):
        prompts.answer_label(F.col("text"), "topic")


def test_answers(spark):
    answers = ["1", "0", "10", " 3 ", "7", "", "-1", "\n5\n", "5 5", "2　", "abc"]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    got = df.select(
        "a",
        prompts.answer_label(F.col("a"), "binary").alias("b"),
        prompts.answer_label(F.col("a"), "emotion").alias("e"),
    ).collect()
    classes = {str(i): i for i in range(6)}
    for r in got:
        assert r.b == int("1" in r.a)
        assert r.e == classes.get(r.a.strip(), -1)


def test_states_of_all_layers_in_one_pass(spark):
    texts = spark.createDataFrame([(i, "tok " * i) for i in range(7)], "id long, text string")
    rows = jobs.extract_states(texts, make_digest_encoder, length=4, batch=3).collect()
    assert len(rows) == 14
    for r in rows:
        assert len(r.states) == 4 and {len(s) for s in r.states} == {4}
    by_layer = {(r.id, r.layer): r.states for r in rows}
    assert by_layer[3, 0][0] == by_layer[1, 0][0] != by_layer[0, 0][0]
    assert by_layer[3, 1][0] == [2 * x for x in by_layer[3, 0][0]]


def test_generation(spark):
    texts = spark.createDataFrame([(1, "wo der fuchs"), (2, "fox")], "id long, text string")
    built = prompts.build(texts, ["Zero-Shot"], "binary")
    got = {r.id: r.answer for r in jobs.generate(built, make_word_rule, batch=1).collect()}
    assert got == {1: "1", 2: "0"}
