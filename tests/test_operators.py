"""Edge rules of the operators on small hand-made tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from rarelane.config import DataConfig, Experiment
from rarelane.functions.draws import unit_draw
from rarelane.functions.labels import check_signed_labels, encode_label, to_binary, to_signed
from rarelane.functions.rowwise import add_row_aggregates
from rarelane.operators import clean, encode, evaluate, sample, scale
from rarelane.sources.tables import concat_tables, read_csv


def column(df, name, order=None):
    rows = (df.orderBy(order) if order else df).select(name).collect()
    return [r[0] for r in rows]


# ---- labels ---------------------------------------------------------------


def test_label_words(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, " no"), (3, "T"), (4, " f ")], "i int, y string")
    assert column(encode_label(df, "y"), "y", "i") == [1, 0, 1, 0]


def test_label_unknown_word_keeps_text(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "maybe")], "i int, y string")
    assert column(encode_label(df, "y"), "y", "i") == ["yes", "maybe"]


def test_label_null_raises(spark):
    df = spark.createDataFrame([(1, "yes"), (2, None)], "i int, y string")
    with pytest.raises(ValueError, match="NULL"):
        encode_label(df, "y")


def test_label_boolean_and_numeric(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "i int, y boolean")
    assert column(encode_label(df, "y"), "y", "i") == [1, 0]
    df = spark.createDataFrame([(1, 5)], "i int, y int")
    assert column(encode_label(df, "y"), "y") == [5]


def test_signed_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "y int")
    signed = df.select(to_signed(F.col("y")).alias("s"))
    assert column(signed, "s") == [-1, 1, None]
    assert column(signed.select(to_binary(F.col("s")).alias("b")), "b") == [0, 1, 0]
    with pytest.raises(ValueError, match="-1 or"):
        check_signed_labels(signed, "s")
    check_signed_labels(signed.where("s is not null"), "s")


# ---- cleaning -------------------------------------------------------------


@pytest.mark.parametrize("split, end", [("300", "\n"), ("2000", "\r\n"), ("1m", "\n")])
def test_csv_records_in_any_split(spark, tmp_path, split, end):
    """Line breaks in quotes, doubled quotes, fields longer than a split, two files."""
    r = random.Random(len(split))
    want = []
    for file in range(2):
        lines = ["id,text,\"a \"\"b\"\"\nname\",n"]
        for i in range(40):
            text = r.choice(["plain", "two\nlines", '""', "x" * 50, "\n\n\n", "a,b", "ends\n", "q\"q\n\"", "\n".join(["long"] * 60)]) if r.random() < 0.5 else f"t{i}"
            want.append((1000 * file + i, text, f"n{i}", i / 2))
            quoted = '"' + text.replace('"', '""') + '"'
            lines.append(f"{1000 * file + i},{quoted},n{i},{i / 2}")
        (tmp_path / f"{file}.csv").write_bytes((end.join(lines) + end * file).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = read_csv(spark, str(tmp_path), line_breaks=True)
        assert df.columns == ["id", "text", 'a "b"\nname', "n"]
        got = sorted(tuple(x) for x in df.collect())
        typed = read_csv(spark, str(tmp_path), T.StructType([
            T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()),
            T.StructField('a "b"\nname', T.StringType()), T.StructField("n", T.DoubleType())]), line_breaks=True)
        assert sorted(x[0] for x in typed.collect()) == [w[0] for w in want]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(x) for x in got] == [w for w in want]


def test_csv_records_of_odd_files(spark, tmp_path):
    for name, text in (("empty", ""), ("header", "a,b\n"), ("blank", "a,b\n\n1,2\n\n"), ("open", 'a,b\n1,"never\nclosed')):
        (tmp_path / f"{name}.csv").write_text(text)
    read = lambda name: read_csv(spark, str(tmp_path / f"{name}.csv"), line_breaks=True)
    assert read("header").columns == ["a", "b"] and read("header").count() == 0
    assert [tuple(r) for r in read("blank").collect()] == [(1, 2)]
    assert read("open").first()["b"].startswith("never")
    (tmp_path / "two").mkdir()
    for i, text in enumerate(("a,b\n1,2\n", "a,c\n1,2\n")):
        (tmp_path / "two" / f"{i}.csv").write_text(text)
    with pytest.raises(ValueError, match="headers"):
        read_csv(spark, str(tmp_path / "two"), line_breaks=True)


def test_csv_whole_numbers_of_nineteen_digits(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n9223372036854775807,9223372036854775808\n-5,1\n")
    df = read_csv(spark, str(tmp_path / "x.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double"]
    assert sorted(r["a"] for r in df.collect()) == [-5, 9223372036854775807]


def test_csv_missing_texts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d\n1,NA,x,Yes\n2,3.5,,no\n3,nan,NULL,Yes\n")
    df = read_csv(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string"}
    assert column(df, "b", "a") == [None, 3.5, None]
    assert column(df, "c", "a") == ["x", None, None]


def test_concat_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, c string")
    b = spark.createDataFrame([(2,)], "i int")
    assert column(concat_tables([a, b]), "c", "i") == ["x", None]


def test_prefix_and_roles(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 1)], "id int, Comp_Sum double, VIP double, y int")
    named = clean.prefix_features(df, "y", ["id", "VIP"])
    assert named.columns == ["id", "V_Comp_Sum", "VIP", "y"]
    assert clean.v_columns(named, "y", ["id", "VIP"]) == ["V_Comp_Sum"]
    with pytest.raises(ValueError, match="V_a"):
        clean.prefix_features(spark.createDataFrame([(1, 2)], "a int, V_a int"), "y")


def test_row_aggregates_null_zero_equal(spark):
    rows = [(1, 1.0, -2.0, 0.0), (2, 2.0, 2.0, 2.0), (3, None, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "i int, V1 double, V2 double, V3 double")
    made = add_row_aggregates(df, ["V1", "V2", "V3"]).orderBy("i").collect()
    first = np.array([1.0, -2.0, 0.0])
    assert made[0]["Comp_Sum"] == -1.0 and made[0]["Comp_Min"] == -2.0
    assert made[0]["Comp_Std"] == pytest.approx(first.std())
    assert (made[0]["Comp_Pos"], made[0]["Comp_Neg"]) == (1, 1)
    assert made[1]["Comp_Var"] == 0.0 and made[1]["Comp_Std"] == 0.0
    for c in ("Sum", "Min", "Max", "Avg", "Std", "Var"):
        assert made[2][f"Comp_{c}"] is None
    assert (made[2]["Comp_Pos"], made[2]["Comp_Neg"]) == (1, 1)


def test_row_aggregates_skipped_when_present(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "V1 double, Comp_Sum double")
    assert add_row_aggregates(df, ["V1"]).columns == ["V1", "Comp_Sum"]


def test_log_amount(spark):
    df = spark.createDataFrame([(1, -3.0), (2, 0.0), (3, None), (4, 1.0)], "i int, Amount double")
    got = column(clean.log_amount(df, "Amount"), "Amount", "i")
    assert got[:3] == [0.0, 0.0, None] and got[3] == pytest.approx(math.log(2))
    assert clean.log_amount(df, "Other").columns == ["i", "Amount"]


def test_nan_becomes_null_and_rows_drop(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, x double")
    assert column(clean.nan_to_null(df), "x", "i") == [None, 1.0]
    assert clean.drop_null_rows(df).count() == 1


# ---- target encoding ------------------------------------------------------


def test_encoding_reads_the_rows_once(spark):
    """Counts of categories are taken once, not again for the shares and for the ranges."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.range(1000).selectExpr("cast(id % 2 as int) AS y", "cast(id % 7 as string) AS c", "cast(id % 5 as string) AS d")
    table = encode.fit_target_encoding(df.mapInPandas(counted, df.schema), ["c", "d"], "y", unseen=True)
    assert table.count() == 14 and read.value == 1000


def test_encoding_one_category_and_null(spark):
    rows = [(1, "a", 1), (2, "a", 0), (3, None, 1)]
    df = spark.createDataFrame(rows, "i int, c string, y int")
    mapping = encode.fit_target_encoding(df, ["c"], "y")
    got = column(encode.apply_target_encoding(df, mapping, ["c"]), "c", "i")
    smoothed = (1 + 10 * 2 / 3) / 12
    assert got[0] == pytest.approx(smoothed) and got[2] is None


@pytest.mark.parametrize("limit", [0, 1000])
def test_encoding_large_map_same_result(spark, limit):
    """A category with a third of the rows, rare ones, NULL and unseen values."""
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("c"), "id"))
        .alias("c"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    mapping = encode.fit_target_encoding(rows, ["c"], "y")
    extra = rows.unionByName(spark.createDataFrame([(9999, "new", 0)], rows.schema))
    coded = encode.apply_target_encoding(extra, mapping, ["c"], broadcast_bytes=limit)
    want = {r["category"]: r["encoded"] for r in mapping.collect()}
    pairs = extra.withColumnRenamed("c", "raw").join(coded.select("id", "c"), "id").collect()
    assert len(pairs) == 3001
    assert all(r["c"] == want.get(r["raw"]) for r in pairs)


# ---- sampling and splitting -----------------------------------------------


def numbered(spark, counts):
    n = sum(counts)
    df = spark.range(n).withColumnRenamed("id", "k")
    return df.withColumn("y", (F.col("k") >= counts[0]).cast("int"))


def test_goldens_of_balanced_sample_and_split(spark):
    """1,000 + 492 rows, 30 % test: 700 + 344 train and 300 + 148 test rows."""
    df = numbered(spark, (5000, 492))
    picked = sample.balance_classes(df, "y", ["k"], 42, max_negatives=1000)
    folds = sample.split_random(picked, "y", ["k"], 42, 0.3)
    counts = {(r["fold"], r["y"]): r["count"] for r in folds.groupBy("fold", "y").count().collect()}
    assert counts == {("train", 0): 700, ("train", 1): 344, ("test", 0): 300, ("test", 1): 148}


def test_split_tie_by_label(spark):
    folds = sample.split_random(numbered(spark, (3, 4)), "y", ["k"], 1, 0.3)
    counts = {(r["fold"], r["y"]): r["count"] for r in folds.groupBy("fold", "y").count().collect()}
    # 3 test rows; train 4 = 1.71 + 2.29 -> 2 + 2
    assert counts == {("train", 0): 2, ("train", 1): 2, ("test", 0): 1, ("test", 1): 2}


def test_targets():
    assert sample.resolve_class_targets(10, 100) == (10, 10)
    assert sample.resolve_class_targets(10, 100, max_positives=4, ratio=2.5) == (4, 10)
    assert sample.resolve_class_targets(5, 100, ratio=0.5) == (5, 2)
    assert sample.resolve_class_targets(10, 8, max_negatives=50) == (10, 8)


def test_largest_remainder():
    assert sample.largest_remainder({0: 3, 1: 3}, 3) == {0: 2, 1: 1}
    assert sum(sample.largest_remainder({0: 9999, 1: 7}, 501).values()) == 501


def test_sample_repeats_and_ignores_partitioning(spark):
    df = numbered(spark, (500, 300))
    one = sample.balance_classes(df, "y", ["k"], 5, 100, 50)
    two = sample.balance_classes(df.repartition(17), "y", ["k"], 5, 100, 50)
    other = sample.balance_classes(df, "y", ["k"], 6, 100, 50)
    keys = [sorted(column(d, "k")) for d in (one, two, other)]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 150


def test_deep_cut_equals_full_ranking(spark, monkeypatch):
    """Refining digit by digit gives the rows a full sort would give."""
    monkeypatch.setattr(sample, "SMALL_GROUP", 1)
    monkeypatch.setattr(sample, "PREFIX_DIGITS", 1)
    df = numbered(spark, (3000, 2000))
    order = sample.hash_order(df, "y", "sample", 3, ["k"])
    got = sample.mark_taken(order, {0: 1234, 1: 77}, "take").where("take")
    ranked = order.df.toPandas().sort_values("__h")
    want = set(ranked[ranked.y == 0].k[:1234]) | set(ranked[ranked.y == 1].k[:77])
    assert set(column(got, "k")) == want


def test_cut_through_equal_rows(spark):
    df = spark.range(1000).select(F.lit(0).alias("y"), F.lit("same").alias("c"))
    order = sample.hash_order(df, "y", "sample", 1, ["y", "c"])
    assert sample.mark_taken(order, {0: 333}, "t").groupBy("t").count().orderBy("t").collect()[1][
        "count"] == 333
    other = spark.range(1000).select(F.lit(0).alias("y"), "id")
    order = sample.hash_order(other, "y", "sample", 1, ["y"])
    with pytest.raises(ValueError, match="identify"):
        sample.mark_taken(order, {0: 333}, "t")


def test_unfold_large_count(spark):
    df = spark.createDataFrame([("a", 250_001), ("b", 0), ("c", 2)], "c string, n bigint")
    got = sample.unfold(df, "n", "i").groupBy("c").agg(F.count("*"), F.countDistinct("i")).collect()
    assert sorted(map(tuple, got)) == [("a", 250_001, 250_001), ("c", 2, 2)]


def test_chronological_nulls_last_and_ties(spark):
    rows = [(i, None if i < 5 else float(i // 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, t double")
    folds = sample.split_chronological(df, "t", ["k"], 1, 0.35).collect()
    train = [r for r in folds if r["fold"] == "train"]
    assert len(train) == 65 and all(r["t"] is not None for r in train)
    latest = max(r["t"] for r in train)
    assert all(r["t"] is None or r["t"] >= latest for r in folds if r["fold"] == "test")


def test_cap_only_when_larger(spark):
    df = numbered(spark, (60, 40))
    assert sample.cap_total(df, "y", ["k"], 1, 100).count() == 100
    capped = sample.cap_total(df, "y", ["k"], 1, 50).groupBy("y").count().collect()
    assert sorted((r["y"], r["count"]) for r in capped) == [(0, 30), (1, 20)]


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    for kind in ("minmax", "standard"):
        scaler = scale.fit_scaler(df, ["a", "b"], kind)
        assert column(scaler.transform(df), "b") == [0.0, 0.0]


def test_draws_are_uniform(spark):
    draws = np.array(column(spark.range(4000).select(unit_draw("x", 1, F.col("id")).alias("u")), "u"))
    assert 0 <= draws.min() and draws.max() < 1 and abs(draws.mean() - 0.5) < 0.02


# ---- evaluation -----------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_constant_scores(spark):
    """300 + 148 rows with one score: ROC area 0.5, PR area (1 + 148/448) / 2."""
    df = scored(spark, [(0, 0.5)] * 300 + [(1, 0.5)] * 148)
    area = evaluate.areas(evaluate.running_counts(df, "y", "p")).first()
    assert area["auc"] == 0.5
    assert area["auc_pr"] == pytest.approx(0.6651785714)


def test_perfect_scores_and_points(spark):
    df = scored(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    running = evaluate.running_counts(df, "y", "p")
    assert tuple(evaluate.areas(running).first()) == (1.0, 1.0)
    roc = [(r["fpr"], r["tpr"]) for r in evaluate.roc_points(running).orderBy(
        F.desc("threshold")).collect()]
    # 0.9 is the first point, 0.8 a bend; 0.2 lies inside two equal steps and is left out.
    assert roc == [(0, 0), (0, 0.5), (0, 1), (1, 1)]
    pr = evaluate.pr_points(running)
    assert pr.count() == 5


def test_single_class_raises(spark):
    with pytest.raises(ValueError, match="one class"):
        evaluate.require_two_classes(scored(spark, [(1, 0.3), (1, 0.4)]), "y")


def test_log_loss_clips(spark):
    df = scored(spark, [(1, 0.0), (0, 1.0)])
    assert evaluate.log_loss(df, "y", "p").first()[0] == pytest.approx(-math.log(2.22e-16), rel=1e-3)


def test_area_is_invariant_under_monotone_maps(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), F.rand(1).alias("p")
    ).persist()
    one = evaluate.areas(evaluate.running_counts(df, "y", "p")).first()
    mapped = df.withColumn("p", F.exp(F.col("p") * 3) - 7)
    two = evaluate.areas(evaluate.running_counts(mapped, "y", "p", range_rows=100)).first()
    assert one["auc"] == pytest.approx(two["auc"], abs=1e-12)
    assert one["auc_pr"] == pytest.approx(two["auc_pr"], abs=1e-12)


def test_rates_without_predictions(spark):
    df = spark.createDataFrame([(1, -1), (0, -1)], "y int, p int")
    r = evaluate.add_rates(evaluate.confusion(df, "y", "p")).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 0.5)


# ---- settings -------------------------------------------------------------


def test_config_rules():
    cfg = DataConfig.from_dict({"max_total_samples": 5, "no_such_key": 1, "non_fraud_sample_size": 7})
    assert cfg.balances_classes and cfg.negatives_wanted == 7 and cfg.minority_ratio == 1.0
    assert not DataConfig(max_non_fraud_samples=5).balances_classes
    assert DataConfig(split_random_state=3).seed("split") == 3
    assert DataConfig(split_random_state=3).seed("sample") == 42
    for bad in ({"class_balance_ratio": 0}, {"oversample_method": "x"}, {"feature_scaling": "x"}):
        with pytest.raises(ValueError):
            DataConfig.from_dict(bad)
    with pytest.raises(ValueError, match="algorithm"):
        Experiment.from_dict("x", {"data": {"a": 1}, "classifier": {}})


@pytest.mark.parametrize("range_rows", [10, 1000])
def test_running_counts_of_several_runs(spark, range_rows):
    """Each run's counts are those of the run by itself; every score stands once."""
    r = random.Random(3)
    rows = [(run, None if run == "c" and i % 2 else "x", r.randint(0, 1), r.randint(0, 60) / 60) for run in "abc" for i in range(200)]
    df = spark.createDataFrame(rows, "run string, part string, y int, p double").repartition(7)
    got = evaluate.running_counts(df, "y", "p", ["run", "part"], range_rows=range_rows).toPandas()
    seen = 0
    for run, part in {(a, b) for a, b, _, _ in rows}:
        own = [(y, p) for a, b, y, p in rows if (a, b) == (run, part)]
        mine = got[(got["run"] == run) & (got["part"].isna() if part is None else got["part"] == part)].sort_values("score")
        seen += len(mine)
        assert mine["score"].tolist() == sorted({p for _, p in own})
        assert mine["tp"].tolist() == [sum(y for y, p in own if p >= s) for s in mine["score"]]
        assert mine["fp"].tolist() == [sum(1 - y for y, p in own if p >= s) for s in mine["score"]]
        assert mine["next_pos"].isna().sum() == 1 and (mine["all_pos"] == sum(y for y, _ in own)).all()
    assert seen == len(got)
