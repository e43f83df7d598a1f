"""Preparations, experiments, saved runs and their comparison."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarelane.config import DataConfig, Experiment, read_experiments
from rarelane.operators import compare
from rarelane.plans.experiment import curve_tables, evaluate_scores, run_experiment, run_grid
from rarelane.plans.prepare import add_row_id, prepare
from rarelane.sources import runs as store
from rarelane.sources.tables import read_csv, read_table


@pytest.fixture(scope="module")
def raw(spark):
    """3,000 + 492 rows: two V features, one category, Amount, Time."""
    rng = np.random.default_rng(0)
    n, p = 3000, 492
    y = np.r_[np.zeros(n, int), np.ones(p, int)]
    rows = [
        (int(i), float(rng.normal() + 1.5 * y[i]), float(rng.normal()), "ab"[int(rng.integers(2))],
         float(abs(rng.normal()) * 50), float(rng.integers(0, 500)), int(y[i]))
        for i in range(n + p)
    ]
    return spark.createDataFrame(
        rows, "id bigint, V1 double, V2 double, shop string, Amount double, Time double, Class int"
    ).repartition(6).persist()


BASE = {"additional_feature_names": ["Amount", "Time"], "enforce_equal_samples": True,
        "max_non_fraud_samples": 1000}


def counts(prepared):
    return {(r["fold"], r["Class"]): r["n"] for r in prepared.counts().collect()}


def test_baseline_counts(raw):
    made = prepare(raw, DataConfig.from_dict(BASE))
    assert counts(made) == {
        ("train", 0): 700, ("train", 1): 700, ("test", 0): 300, ("test", 1): 148
    }
    assert made.features == (
        "V1", "V2", "V_shop", "Comp_Sum", "Comp_Min", "Comp_Max", "Comp_Avg", "Comp_Std",
        "Comp_Pos", "Comp_Neg", "Comp_Var", "Amount", "Time",
    )
    assert made.data.count() == made.data.select("row_id").distinct().count()


def test_lighter_oversampling_counts(raw):
    cfg = DataConfig.from_dict({**BASE, "max_non_fraud_samples": 2500, "oversample_ratio": 0.5})
    got = counts(prepare(raw, cfg))
    assert got[("train", 0)] == 1750 and got[("train", 1)] == 875


def test_natural_test_fold_is_untouched(raw):
    cfg = DataConfig.from_dict({
        **BASE, "preserve_natural_test_distribution": True, "should_over_sample": False,
        "feature_scaling": "minmax",
    })
    made = prepare(raw, cfg)
    got = counts(made)
    assert got[("test", 0)] + got[("test", 1)] == 1048
    assert got[("train", 0)] == 1000
    ends = made.train.agg(F.min("V1"), F.max("V1"), F.min("Amount"), F.max("Amount")).first()
    assert tuple(ends) == (0.0, 1.0, 0.0, 1.0)
    train, test = made.train.select("row_id"), made.test.select("row_id")
    assert train.join(test, "row_id").count() == 0


def test_cap_without_other_settings_balances_first(raw):
    cfg = DataConfig.from_dict({"max_total_samples": 100, "should_over_sample": False,
                                "additional_feature_names": ["Amount", "Time"]})
    got = counts(prepare(raw, cfg))
    assert got[("train", 0)] + got[("test", 0)] == 50


def test_chronological_order(raw):
    cfg = DataConfig.from_dict({**BASE, "split_method": "chronological", "should_over_sample": False})
    made = prepare(raw, cfg)
    assert made.train.agg(F.max("Time")).first()[0] <= made.test.agg(F.min("Time")).first()[0]


def test_no_engineered_features_and_log(raw):
    cfg = DataConfig.from_dict({
        **BASE, "enable_engineered_features": False, "engineered_feature_names": [],
        "log_transform_amount": True, "drop_duplicates": True, "should_over_sample": False,
    })
    made = prepare(raw, cfg)
    assert made.features == ("V1", "V2", "V_shop", "Amount", "Time")
    assert made.data.agg(F.max("Amount")).first()[0] < 7


def test_seeds_change_their_stage_only(raw):
    def keys(**seeds):
        cfg = DataConfig.from_dict({**BASE, "should_over_sample": False, **seeds})
        return {r["row_id"]: r["fold"] for r in prepare(raw, cfg).data.collect()}

    one, split, sample = keys(), keys(split_random_state=7), keys(sample_random_state=7)
    assert set(one) == set(split) and one != split
    assert set(one) != set(sample)


def test_null_input_raises_when_balanced(raw):
    holes = raw.withColumn("V1", F.when(F.col("Class") == 0, F.col("V1")))
    with pytest.raises(ValueError, match="V1"):
        prepare(holes, DataConfig.from_dict(BASE))


def test_bad_labels_raise(raw):
    three = raw.withColumn("Class", F.col("Class") + F.when(F.col("id") == 5, 2).otherwise(0))
    with pytest.raises(ValueError, match="0 or 1"):
        prepare(three, DataConfig(additional_feature_names=("Amount", "Time")))


def test_row_ids_without_index(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, None)], "x int, c string")
    made = add_row_id(df, "id")
    assert made.count() == made.select("row_id").distinct().count() == 6
    assert sorted(r["row_id"] for r in made.collect()) == sorted(
        r["row_id"] for r in add_row_id(df.repartition(3), "id").collect()
    )


def test_csv_experiment_end_to_end(spark, raw, tmp_path):
    raw.drop("id").toPandas().to_csv(tmp_path / "t.csv", index=False)
    experiment = Experiment.from_dict("one", {
        "algorithm": "lda", "classifier": {"shrinkage": 0.9, "no_such": 1},
        "data": {**BASE, "train_file": str(tmp_path / "t.csv"),
                 "model_file": str(tmp_path / "model")},
    })
    run = run_experiment(spark, experiment).first()
    assert run["model_name"] == "Linear Discriminant Analysis (Oversampled)"
    assert run["auc"] > 0.75 and run["timing"]["fit"] > 0
    assert np.sum(run["test_metrics"]["confusion_matrix"]) == 448
    assert run["fpr"][0] == run["tpr"][0] == 0.0 and run["fpr"][-1] == run["tpr"][-1] == 1.0
    assert run["pr_recall"][0] == 1.0 and run["pr_precision"][-1] == 1.0
    assert (tmp_path / "model" / "facts").exists()


def grid(*names, **data):
    kinds = {
        "lda": ("lda", {"shrinkage": 0.9}),
        "nb": ("naive_bayes", {}),
        "vote": ("classical_qboost", {"weak_cls_type": "nb"}),
    }
    return [
        Experiment.from_dict(f"grid/{n}", {
            "algorithm": kinds[n][0], "classifier": kinds[n][1], "data": {**BASE, **data},
        })
        for n in names
    ]


def test_grid_skips_finished_runs(spark, raw, tmp_path):
    path = str(tmp_path / "store")
    first = run_grid(spark, grid("lda"), path, raw)
    assert [r["experiment"] for r in first.collect()] == ["grid/lda"]
    both = run_grid(spark, grid("lda", "vote"), path, raw)
    assert sorted(r["experiment"] for r in both.collect()) == ["grid/lda", "grid/vote"]
    assert store.read_run_store(spark, path).count() == 2
    vote = both.where("experiment = 'grid/vote'").first()
    assert vote["timing"]["fit"] is None and set(vote["timing"]["adapter"]) == {
        "solve", "get_hamiltonian"
    }
    table = compare.comparison_table(both)
    assert table.columns == [*compare.BASE_COLUMNS, "timing_solve", "timing_get_hamiltonian"]
    total = vote["timing"]["data_prep"] + vote["timing"]["predict"] + sum(
        vote["timing"]["adapter"].values()
    )
    assert table.where("timing_fit is null").first()["timing_total_seconds"] == pytest.approx(total)


def test_dry_run_fits_nothing(spark, raw, tmp_path):
    shown = run_grid(spark, grid("lda"), str(tmp_path / "s"), raw, dry_run=True)
    assert {(r["fold"], r["Class"]): r["n"] for r in shown.collect()}[("train", 1)] == 700
    assert not (tmp_path / "s").exists()


def test_curves_as_tables_agree_with_document(spark, raw):
    made = prepare(raw, DataConfig.from_dict(BASE))
    scored = made.data.withColumn("probability", F.round(F.col("Comp_Max"), 1) / 10).withColumn(
        "prediction", F.when(F.col("probability") > 0.15, 1).otherwise(-1)
    )
    document = evaluate_scores(scored, "Class")
    roc, pr = curve_tables(scored, "Class")
    assert roc.count() == len(document["fpr"]) and pr.count() == len(document["pr_recall"])
    area = np.trapezoid(document["tpr"], document["fpr"])
    assert area == pytest.approx(document["auc"])
    assert -np.trapezoid(document["pr_precision"], document["pr_recall"]) == pytest.approx(
        document["auc_pr"]
    )


def test_rows_without_an_index_are_not_joined(spark):
    rows = [(None, "a")] * 40 + [(1, "a"), (1, "b"), (2, "c"), (None, "d")]
    out = add_row_id(spark.createDataFrame(rows, "id bigint, v string"), "id")
    assert "<=>" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas()
    assert len(got) == 44 and got["row_id"].nunique() == 44
    assert set(got[got["v"] == "c"]["row_id"]) == {"2"} and got["row_id"].notna().all()


def test_files_of_curves_do_not_grow_with_experiments(spark, tmp_path):
    def points(names, value):
        rows = [(n, value, value, float(i)) for n in names for i in range(3)]
        return (
            spark.createDataFrame(rows, "experiment string, fpr double, tpr double, threshold double").coalesce(2),
            spark.createDataFrame(rows, "experiment string, precision double, recall double, threshold double").coalesce(2),
        )

    names = [f"grid/{i}" for i in range(60)] + [None]
    store.write_curves(*points(names, 0.25), str(tmp_path))
    assert len(list(tmp_path.rglob("*.parquet"))) == 4
    store.write_curves(*points(["grid/3", "new"], 0.5), str(tmp_path))
    for name, x in (("roc", "tpr"), ("pr", "recall")):
        got = store.read_curves(spark, str(tmp_path), name).groupBy("experiment").agg(F.count("*").alias("n"), F.max(x).alias("x"), F.min(x).alias("y")).collect()
        assert {(r["experiment"], r["n"], r["x"], r["y"]) for r in got} == {
            (n, 3, v, v) for n in [*names, "new"] for v in [0.5 if n in ("grid/3", "new") else 0.25]
        }


def document(name, **changes):
    metrics = {"split": "test", "precision": 1.0, "recall": 0.5, "f1": 0.6, "accuracy": 0.9,
               "confusion_matrix": [[3, 0], [1, 1]]}
    doc = {
        "model_name": name, "training_time_seconds": 3.0,
        "timing": {"data_prep": 1.0, "fit": 0.5, "predict": 0.25},
        "fpr": [0.0, 1.0], "tpr": [0.0, 1.0], "auc": 0.5, "log_loss": 0.7,
        "pr_precision": [0.5, 1.0], "pr_recall": [1.0, 0.0], "auc_pr": 0.4,
        "train_metrics": {**metrics, "split": "train"}, "test_metrics": metrics,
    }
    doc.update(changes)
    return {k: v for k, v in doc.items() if v is not None}


@pytest.fixture()
def documents(spark, tmp_path):
    docs = {
        "a/1.json": document("one", timing={
            "data_prep": 1.0, "fit": None, "predict": 0.25, "adapter": {"solve": 2.0, "run_it": 4.0}}),
        "a/2.json": document("twin", pr_precision=None, pr_recall=None, auc_pr=None, auc=0.9),
        "b/3.json": document("twin", timing=None, auc=0.9),
        "b/4.json": document("odd", timing={
            "data_prep": 1.0, "fit": 2.0, "predict": 0.5, "adapter": "none"}, log_loss=0.1),
    }
    for path, doc in docs.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(json.dumps(doc, indent=2))
    (tmp_path / "note.txt").write_text("not a run")
    return store.read_runs(spark, str(tmp_path))


def test_old_documents_are_completed(documents):
    runs = {r["experiment"].rsplit("/", 1)[1]: r for r in documents.collect()}
    assert len(runs) == 4
    assert runs["2.json"]["pr_recall"] == [] and runs["2.json"]["auc_pr"] == 0.0
    assert runs["3.json"]["timing"]["fit"] == 3.0 and runs["3.json"]["timing"]["data_prep"] == 0.0
    assert runs["4.json"]["timing"]["adapter"] == {}
    assert runs["4.json"]["timing"]["fit"] == 2.0


def test_comparison_of_documents(documents, tmp_path):
    table = compare.comparison_table(documents).collect()
    assert [r["model_name"] for r in table] == ["one", "twin", "twin", "odd"]
    assert [r["timing_total_seconds"] for r in table] == [7.25, 1.75, 3.0, 3.5]
    assert table[0]["timing_solve"] == 2.0 and table[1]["timing_solve"] is None
    store.write_comparison_csv(documents, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0] == ",".join([*compare.BASE_COLUMNS, "timing_solve", "timing_run_it"])


def test_rankings(documents):
    roc = compare.roc_table(documents).orderBy("rank", "point").collect()
    assert [r["model_name"] for r in roc if r["point"] == 0] == ["twin", "twin", "one", "odd"]
    pr = compare.pr_table(documents)
    assert pr.select("experiment").distinct().count() == 3
    losses = compare.metric_ranking(documents).where("metric = 'log_loss'").orderBy("rank").collect()
    assert losses[-1]["model_name"] == "odd"
    stack = compare.timing_stack(documents).orderBy("experiment", "place").collect()
    first = [(r["stage"], r["seconds"], r["bottom"]) for r in stack if r["experiment"].endswith("1.json")]
    assert first == [
        ("Data Prep", 1.0, 0.0), ("Predict", 0.25, 1.0), ("Solve", 2.0, 1.25), ("Run_It", 4.0, 3.25)
    ]


def test_result_paths(spark):
    df = spark.createDataFrame([("tests/a/tests/x.yaml",), ("b/tests.d/y.yml",)], "p string")
    got = [r[0] for r in df.select(compare.result_path(F.col("p"))).collect()]
    assert got == ["results/a/results/x.json", "b/tests.d/y.json"]


def test_reading_experiment_files(tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "one.yaml").write_text(
        "algorithm: knn\nclassifier: {}\ndata:\n  class_name: y\n  additional_feature_names: [a]\n"
    )
    found = read_experiments(str(tmp_path))
    assert [(e.name, e.algorithm, e.data.class_name) for e in found] == [("k/one", "knn", "y")]


def test_row_ids_are_never_shared(spark):
    rows = [(i, f"v{i % 3}") for i in range(20)]
    df = spark.createDataFrame(rows + rows + [(None, "v"), (None, "v"), (99, "w")], "id long, c string")
    made = add_row_id(df, "id")
    assert made.count() == made.select("row_id").distinct().count() == 43
    assert [r.row_id for r in made.where("id = 99").collect()] == ["99"]


def test_csv_like_a_data_frame_library(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,a,b,c,d\n1,"say ""hi"", all",1d, NULL,1.5\n2,NA,2f,x, 2\n3,"two\nlines",3,NULL,inf\n')
    rows = read_csv(spark, str(path), line_breaks=True).orderBy("id").collect()
    assert [r.a for r in rows] == ['say "hi", all', None, "two\nlines"]
    assert [r.b for r in rows] == ["1d", "2f", "3"] and [r.c for r in rows] == [" NULL", "x", None]
    assert [r.d for r in rows] == [1.5, 2.0, float("inf")]


def test_a_folder_of_parquet_needs_no_ending(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "plain"))
    assert read_table(spark, str(tmp_path / "plain")).count() == 5


def test_scores_without_a_number_raise(spark):
    from rarelane.operators.evaluate import running_counts

    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 0.5), (0, bad)], "y int, s double")
        with pytest.raises(Exception, match="NULL or NaN"):
            running_counts(df, "y", "s").collect()


def test_a_rerun_takes_the_place_of_its_run(spark, raw, tmp_path):
    e = Experiment.from_dict("lda/one", {"algorithm": "lda", "classifier": {}, "data": BASE})
    path = str(tmp_path / "runs")
    first = run_grid(spark, [e], path, table=raw).collect()
    again = run_grid(spark, [e], path, table=raw, rerun=True).collect()
    assert len(first) == len(again) == 1


def test_a_grid_saves_its_curves_as_tables(spark, raw, tmp_path):
    path = str(tmp_path / "store")
    for rerun in (False, True):
        runs = run_grid(spark, grid("lda", "nb"), path, raw, rerun=rerun)
    assert runs.count() == 2 and runs.where("size(fpr) > 0").count() == 0
    for name, x in (("roc", "fpr"), ("pr", "recall")):
        points = store.read_curves(spark, path, name)
        ends = {r.experiment: (r.a, r.b, r.n) for r in points.groupBy("experiment").agg(
            F.min(x).alias("a"), F.max(x).alias("b"), F.count("*").alias("n")).collect()}
        assert set(ends) == {"grid/lda", "grid/nb"}
        assert all(a == 0.0 and b == 1.0 and n > 10 for a, b, n in ends.values())


def test_runs_are_written_by_several_tasks_a_core(spark, tmp_path):
    from rarelane.sources import runs as store

    few = spark.createDataFrame([(f"e{i}", "m", 1.0) for i in range(40)], "experiment string, model_name string, auc double").coalesce(1)
    spread = store.spread_runs(few)
    assert spread.rdd.getNumPartitions() == store.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert sorted(r["experiment"] for r in spread.collect()) == sorted(f"e{i}" for i in range(40))
