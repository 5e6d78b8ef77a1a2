from layerlens.operators import metrics
from layerlens.session import new_folder
from layerlens.streaming import evaluation

KEYS = ["layer", "pooling", "probe"]


def _write(folder, name, rows):
    lines = "".join(f"{i}\t{y}\n" for i, y in rows)
    (folder / name).write_text("id\ty_pred\n" + lines)


def test_new_files_only_and_equal_to_batch(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    truth = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, label int")
    state = new_folder(spark, "stream")

    def deliver():
        evaluation.score_new_files(
            spark, str(runs), truth, f"{state}/counts", f"{state}/checkpoint", files_per_batch=1
        ).awaitTermination()
        return {tuple(r[k] for k in KEYS): r for r in evaluation.scores_so_far(spark, f"{state}/counts").collect()}

    first = [(i, int(i < 10)) for i in range(20)]
    _write(runs, "layer_0_mean_knn.tsv", first)
    _write(runs, "layer_0.tsv", first)
    got = deliver()
    assert set(got) == {(0, "mean", "knn")}
    again = deliver()
    assert again == got

    second = [(i, i % 2) for i in range(15)]
    _write(runs, "layer_1_max_naive_bayes.tsv", second)
    got = deliver()
    assert set(got) == {(0, "mean", "knn"), (1, "max", "naive_bayes")}
    preds = spark.createDataFrame(
        [(0, "mean", "knn", *r) for r in first] + [(1, "max", "naive_bayes", *r) for r in second],
        "layer int, pooling string, probe string, id long, y_pred int",
    )
    batch = metrics.evaluate(preds, truth, ["id"], KEYS, "binary").collect()
    assert {tuple(r[k] for k in KEYS): r for r in batch} == got
    total = evaluation.confusion_so_far(spark, f"{state}/counts").groupBy().sum("n").first()[0]
    assert total == 35
