import pytest
from pyspark.sql import functions as F

from layerlens.functions import sizing
from layerlens.operators.metrics import align_by_position
from layerlens.session import new_folder
from layerlens.sources import experiments, labelled, predictions, results


def test_csv_columns_by_name_quotes_and_missing(spark, tmp_path):
    (tmp_path / "d_train.csv").write_text(
        'label,other,text\n1,x,"He said ""hi"",\nand left"\n0,x,\n1,x,NA\n,x,plain\n'
    )
    (tmp_path / "d_test.csv").write_text("text,label\nfine,0\n")
    rows = labelled.read_dataset(spark, str(tmp_path), "d").collect()
    train = [(r.text, r.label) for r in rows if r.split == "train"]
    assert train == [('He said "hi",\nand left', 1), ("nan", 0), ("nan", 1), ("plain", None)]
    assert [(r.text, r.label) for r in rows if r.split == "test"] == [("fine", 0)]


def test_texts_get_ids_and_whole_labels(spark, tmp_path):
    (tmp_path / "d_train.csv").write_text("text,label\na,1.0\nb,0\nc,\n")
    (tmp_path / "d_test.csv").write_text("text,label\nd,2\n")
    rows = labelled.read_dataset(spark, str(tmp_path), "d")
    got = rows.orderBy("id").collect()
    assert [(r.text, r.label) for r in got] == [("a", 1), ("b", 0), ("c", None), ("d", 2)]
    assert len({r.id for r in got}) == 4 and labelled.head(rows, 1).count() == 2
    (tmp_path / "d_test.csv").write_text("text,label\nd,positive\n")
    with pytest.raises(Exception, match="positive"):
        labelled.read_split(spark, str(tmp_path / "d_test.csv")).collect()


def test_a_run_written_again_replaces_itself(spark):
    folder = new_folder(spark, "again")
    rows = spark.createDataFrame([(0, "mean", "knn", 1, 1), (1, "mean", "knn", 1, 0)], "layer int, pooling string, probe string, id long, y_pred int")
    name = predictions.run_file(F.col("layer"), F.col("pooling"), F.col("probe"))
    for part in (rows, rows.filter("layer = 1")):
        predictions.write_run_files(part, folder, name)
    assert predictions.read_runs(spark, folder).exceptAll(rows).count() == 0
    assert predictions.read_runs(spark, folder).count() == 2


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "d_train.csv").write_text("text,class\na,1\n")
    with pytest.raises(ValueError):
        labelled.read_split(spark, str(tmp_path / "d_train.csv"))
    with pytest.raises(ValueError):
        labelled.normalise_columns(spark.createDataFrame([(1, "x")], "label int, body string"))


def test_multilingual_reads_every_language(spark, tmp_path):
    for n, language in enumerate(labelled.LANGUAGES):
        folder = tmp_path / "multilingual" / language
        folder.mkdir(parents=True)
        for split in ("train", "test"):
            name = f"{labelled.MULTILINGUAL_NAME}_{split}.csv"
            (folder / name).write_text(f"text,label\n{language} {split},{n % 2}\n")
    rows = labelled.read_dataset(spark, str(tmp_path), "multilingual").collect()
    assert len(rows) == 16 and {r.lang for r in rows} == set(labelled.LANGUAGES)
    one = labelled.read_dataset(spark, str(tmp_path), "french").collect()
    assert {r.text for r in one} == {"french train", "french test"}


def test_splits_round_trip_as_csv(spark):
    df = spark.createDataFrame(
        [(1, 'a "quoted" text', 0, "train"), (2, "b, c", 1, "test")],
        "id long, text string, label int, split string",
    )
    folder = new_folder(spark, "splits")
    labelled.write_splits(df, folder, "csv")
    back = labelled.read_split(spark, f"{folder}/split=train").collect()
    assert [(r.text, r.label) for r in back] == [('a "quoted" text', 0)]


def test_run_names(spark):
    names = ["layer_3_mean_knn", "layer_0_concat-mean-max-min_naive_bayes_2", "layer_3_mean", "x_y_z_w", ""]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = df.select(predictions.parse_run(F.col("s")).alias("k")).collect()
    assert [r.k and tuple(r.k) for r in got] == [
        (3, "mean", "knn"),
        (0, "concat-mean-max-min", "naive_bayes_2"),
        None,
        (None, "z", "w"),
        None,
    ]
    paths = ["/a/layer_1_max_mlp.tsv", "/a/run=layer_1_max_mlp.tsv/part-0.csv", "/a/b.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(predictions.file_stem(F.col("p"))).collect()]
    assert got == ["layer_1_max_mlp", "layer_1_max_mlp", ""]


def test_files_without_predictions_are_skipped(spark, tmp_path):
    (tmp_path / "layer_0_mean_knn.tsv").write_text("id\ty_pred\n5\t1.0\n6\t0\n")
    (tmp_path / "layer_1_mean_knn.tsv").write_text("id\tprobability\n5\t1\n")
    (tmp_path / "layer_2.tsv").write_text("id\ty_pred\n5\t1\n")
    rows = predictions.read_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(0, "mean", "knn", 5, 1), (0, "mean", "knn", 6, 0)]


def test_prediction_column_by_name(spark, tmp_path):
    (tmp_path / "layer_0_mean_knn.tsv").write_text("text\ty_true\ty_pred\tid\na b\t0\t1\t5\n\nc\t1\t0\t6\n")
    (tmp_path / "layer_1_mean_knn.tsv").write_text("\ty_true\ty_pred\n7\t0\t1\n")
    (tmp_path / "layer_2_mean_knn.tsv").write_text("y_pred\ty_true\n1\t0\n")
    rows = predictions.read_runs(spark, str(tmp_path)).collect()
    assert {r.layer: (r.id, r.y_pred) for r in rows if r.id != 6} == {0: (5, 1), 1: (7, 1), 2: (None, 1)}
    assert sorted((r.id, r.y_pred) for r in rows if r.layer == 0) == [(5, 1), (6, 0)]


def test_predictions_that_do_not_parse(spark, tmp_path):
    (tmp_path / "layer_0_mean_knn.tsv").write_text("id\ty_pred\n5\t1\n6\tyes\n7\t0.5\n8\t\n")
    with pytest.raises(ValueError, match="3 predictions"):
        predictions.read_runs(spark, str(tmp_path))
    (tmp_path / "layer_0_mean_knn.tsv").rename(tmp_path / "zero.tsv")
    with pytest.raises(ValueError, match="3 predictions"):
        predictions.read_prompt_runs(spark, str(tmp_path))


def test_many_files_fall_back_to_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_SMALL_ROWS", 0)
    test_files_without_predictions_are_skipped(spark, tmp_path)


def test_positions_over_split_files(spark, tmp_path):
    """Positions hold when a file is read by many tasks, up to the shorter length."""
    for layer, n in ((0, 3000), (1, 40)):
        text = "y_pred\n" + "".join(f"{(i * 7 + layer) % 5}\n" for i in range(n))
        (tmp_path / f"layer_{layer}_mean_knn.tsv").write_text(text)
    (tmp_path / "layer_2_mean_knn.tsv").write_text("answer\n1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        preds = predictions.read_positional_runs(spark, str(tmp_path))
        rows = preds.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.layer for r in rows} == {0, 1} and len(rows) == 3040
    assert all(r.y_pred == ((r.position - 1) * 7 + r.layer) % 5 for r in rows)
    truth = spark.createDataFrame([(10 * i, i) for i in range(100)], "id long, label int")
    aligned = align_by_position(preds, truth).collect()
    assert len(aligned) == 140 and all(r.y_true == r.position - 1 for r in aligned)


def test_appended_results_with_differing_columns(spark):
    folder = new_folder(spark, "results")
    one = spark.createDataFrame([("knn", 3)], "probe string, n_neighbors int")
    two = spark.createDataFrame([("svm", 0.5)], "probe string, C double")
    results.append_results(one, folder)
    results.append_results(two, folder)
    back = results.read_results(spark, folder)
    assert set(back.columns) == {"probe", "n_neighbors", "C"}
    got = sorted((r.probe, r.n_neighbors, r.C) for r in back.collect())
    assert got == [("knn", 3, None), ("svm", None, 0.5)]
    assert results.union_results([one, two]).count() == 2


def test_params_become_columns(spark):
    df = spark.createDataFrame([("a", {"C": "1"}), ("b", {})], "probe string, params map<string,string>")
    got = {r.probe: r.C for r in results.spread_params(df, ["C"]).collect()}
    assert got == {"a": "1", "b": None}


def test_grid_from_a_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    config = tmp_path / "e.yaml"
    config.write_text(
        "options:\n  token_level_exploration: False\nexperiment:\n"
        "  - model_name: ['m']\n    dataset_name: ['multilingual']\n    probe_types: ['knn', 'mlp']\n"
    )
    grid = experiments.work_grid(experiments.from_yaml(spark, str(config), n_layers=3))
    assert grid.count() == 8 * 3 * 2 and {r.pooling for r in grid.collect()} == {"mean"}


def test_resume_from_documents(spark):
    done = spark.createDataFrame(
        [("d", "m", 0, "mean", "knn"), ("d", "m", 1, "max", "mlp"), ("d", "m", 1, "max", "knn")],
        "dataset string, model string, layer int, pooling string, probe string",
    )
    documents = experiments.checkpoint_documents(done)
    assert documents.count() == 1 and '"last_layer":2' in documents.first().checkpoint
    assert experiments.completed_cells(documents).exceptAll(done).count() == 0
    assert experiments.remaining(done, experiments.completed_cells(documents)).count() == 0


def test_head(spark):
    df = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(50)], "id long, split string")
    rows = labelled.head(df, 5).collect()
    assert sorted(r.id for r in rows if r.split == "test") == [0, 3, 6, 9, 12]
    assert sorted(r.id for r in rows if r.split == "train") == [1, 2, 4, 5, 7]
