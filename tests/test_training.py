"""Training, storing and scoring on a separable panel."""

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import models, sequences
from panelrisk.plans import training
from panelrisk.session import scratch


@pytest.fixture(scope="module")
def table(spark):
    """Twelve entities, 180 weeks from 2020; the label follows a slow wave of the feature."""
    n = spark.range(12 * 180).select(
        F.concat(F.lit("e"), (F.col("id") / 180).cast("int")).alias("country_std"),
        (F.col("id") % 180).cast("int").alias("t"))
    wave = F.sin((F.col("t") + F.ascii(F.substring("country_std", 2, 1))) / 9.0)
    df = n.select("country_std", (2020 + F.col("t") / 52).cast("int").alias("year"),
                  (F.col("t") % 52 + 1).cast("int").alias("week_num"), wave.alias("f"),
                  (F.sin((F.col("t") - 13 + F.ascii(F.substring("country_std", 2, 1))) / 9.0)
                   > 0.2).cast("int").alias("Y"))
    df = df.withColumn("week_id", F.format_string("%d-%02d", "year", "week_num"))
    return sequences.assign_split(training.window_table(df, ["f"]), val=2021, test=2022)


@pytest.fixture(scope="module")
def trained(spark, table):
    folder = scratch(spark, "model")
    scored, report = training.train(table, ["f"], folder, iterations=10)
    return folder, scored, report.first()


def test_split_fallback_without_test_rows(table):
    s = sequences.resolve_splits(table.filter("split <> 'test'"))
    assert s.filter("is_test").count() == s.filter("is_val").count() > 0
    t = sequences.resolve_splits(table.filter("split = 'train'"))
    n = t.count()
    assert t.filter("is_train").count() == int(n * 0.8)
    assert t.filter("is_val and is_train").count() == 0


def test_auc_floor(trained):
    assert trained[2].final_test.auc > 0.9 and trained[2].final_model in ("trees", "sequence", "ensemble")


def test_saved_scores_equal_trained_scores(spark, trained, table):
    folder, scored, _ = trained
    again, overall, each = training.evaluate_saved(spark, folder, table, "val")
    a = {(r.country_std, r.week_end): r.p_conflict for r in
         scored.filter("split = 'val'").collect()}
    b = {(r.country_std, r.week_end): r.p_conflict for r in again.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert overall.first().n == len(b) and each.count() == 12


def test_patience_looks_past_a_bump():
    assert models.stopped_at([5, 4, 3, 3.5, 2, 2.5, 2.6, 2.7], patience=3) == 5
    assert models.stopped_at([5, 4, 4.1, 4.2, 4.3, 1], patience=3) == 2
    assert models.stopped_at([3, 2, 1]) == 3


def test_trees_are_many_and_no_worse_than_all(spark, table):
    rows = models.class_weights(sequences.resolve_splits(table).filter("is_train or is_val"),
                                counted="is_train")
    few = models.fit_trees(rows, training.flat_names(["f"]), validation="is_val", iterations=25)
    assert few.stages[-1].getNumTrees > 8
    one = rows.filter("not is_val or Y = 1")
    assert models.fit_trees(one, training.flat_names(["f"]), validation="is_val",
                            iterations=6).stages[-1].getNumTrees == 6


def test_weights_count_training_rows_only(spark):
    df = spark.createDataFrame([(1, True), (0, True), (0, True), (0, False)], "Y int, t boolean")
    assert {r.weight for r in models.class_weights(df, counted="t").filter("Y = 1").collect()} == {2.0}


def test_precision_floor(spark, trained, table):
    rows, _, _ = training.evaluate_saved(spark, trained[0], table, "val", floor=0.5)
    assert rows.count() > 0


def test_error_paths(spark, trained, table):
    with pytest.raises(ValueError, match="target weeks there are"):
        models.predict_saved(spark, trained[0], table, "val", start="2099-01-01")
    with pytest.raises(ValueError, match="features"):
        models.predict_saved(spark, trained[0], table.drop("f__mean"))
    with pytest.raises(ValueError, match="unlabelled"):
        training.train(table.withColumn("Y", F.lit(-1)), ["f"])


def test_target_range(table):
    rows = models.in_target_range(table, "all", "2021-01-01", "2021-06-30").select(
        F.min("target_week_end"), F.max("target_week_end")).first()
    assert "2021-01-01" <= rows[0] <= rows[1] <= "2021-06-30"


def test_standardised_steps(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 2.0]],)], "X array<array<float>>")
    s = models.standardiser(df, "X", 2).first()
    assert s["mean"] == [2.0, 2.0] and abs(s["sigma"][0] - 1.0) < 1e-6
    z = models.standardise(df, s["mean"], s["sigma"]).first()["Z"]
    assert [round(v, 4) for v in z] == [-1.0, 0.0, 1.0, 0.0]


@pytest.fixture(scope="module")
def context(spark, table):
    """States at the windows' ends, as if nothing changed in 13 weeks; tiers but for one entity."""
    return table.select("country_std", F.col("week_end").alias("week_id"), (1 - F.col("Y")).alias("Y"),
                        F.when(F.col("country_std") != "e3", F.when(
                            F.col("country_std") < "e2", "A").otherwise("B")).alias("group"))


def test_nested_report(spark, table, context, trained):
    scored, report = training.train(table, ["f"], iterations=5, context=context)
    r, rows = report.first(), scored.filter("is_test").collect()
    assert (r.split_counts.test, r.n_features, r.features) == (len(rows), 1, ["f"])
    assert r.n_countries == 12 and r.model_artifacts is None
    d = r.diagnostics
    assert d.persistence_acc == 0.0 and d.persistence_auc == 0.0  # the state is always the contrary
    assert d.onset_n == sum(x.Y for x in rows) and d.decay_n == len(rows) - d.onset_n
    hit = sum(x.Y == 1 and x.pred == 1 for x in rows)
    assert d.onset_recall == pytest.approx(hit / d.onset_n)
    assert d.lift_auc == pytest.approx(d.model_auc_valid)
    assert {(g.group, g.n) for g in d.by_group} == {
        (t, sum(x.group == t for x in rows)) for t in "AB"}
    best = r.test[r.final_model]
    assert best == r.final_test and best.threshold == r.threshold
    without = trained[2].diagnostics
    assert (without.onset_n, without.persistence_auc, without.by_group) == (0, None, [])


def test_stored_vocabulary(spark, trained, table):
    rows, _, _ = training.evaluate_saved(
        spark, trained[0], table.unionByName(table.filter("country_std = 'e1'").withColumn(
            "country_std", F.lit("new"))), "val")
    ids = {r.country_std: r.country_id for r in rows.collect()}
    meta = models.load(spark, trained[0])[2]
    assert ids.pop("new") is None
    assert ids == {c: i for i, c in enumerate(meta["countries"])} and len(ids) == 12


def test_folds_train_on_earlier_blocks(spark, table, context):
    rows, each = training.cross_validate(table, ["f"], iterations=4, context=context)
    got = {r.fold: r for r in each.collect()}
    n = table.count()
    assert set(got) == {1, 2, 3} and {r.n for r in got.values()} == {n // 4}
    assert all(r.auc > 0.8 and 0 < r.f1 <= 1 and 0 <= r.brier < 0.3 for r in got.values())
    firsts = {r.fold: r.first for r in rows.groupBy("fold").agg(
        F.min("week_end").alias("first")).collect()}
    assert firsts[1] < firsts[2] < firsts[3]
    one = rows.filter("fold = 2 AND group = 'A'").first()
    assert one.p_ensemble == pytest.approx(0.6 * one.p_trees + 0.4 * one.p_sequence)


def test_folds_with_one_class(spark, table):
    early = table.withColumn("Y", F.when(F.col("week_end") < "2021-20", 0).otherwise(F.col("Y")))
    with pytest.raises(ValueError, match="both classes"):
        training.cross_validate(table.withColumn("Y", F.lit(0).cast("long")), ["f"])
    _, each = training.cross_validate(early, ["f"], iterations=3)
    assert 1 <= each.count() < 3


def test_no_fold_can_be_trained(spark, table, context):
    alike = table.withColumn("Y", F.lit(0).cast("long"))
    some, _ = training.cross_validate(table, ["f"], iterations=2, context=context)
    rows, each = training.cross_validate(alike, ["f"], context=context, strict=False)
    assert rows.count() == each.count() == 0
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in some.schema]


def test_fold_query_where_all_weeks_are_active(spark, tmp_path):
    """Two nations with an order over the bound of activity in each of 80 weeks: no onsets."""
    from panelrisk.workload import QUERIES

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("region", [(0, "R")], "r_regionkey int, r_name string")
    write("nation", [(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(0, 0, 1.0), (1, 1, 2.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    spark.range(160).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 2).alias("o_custkey"),
        F.date_add(F.lit("1997-01-06"), (F.floor(F.col("id") / 2) * 7).cast("int"))
        .cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.lit(700_000.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus")) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    windows = QUERIES["sliding_windows"](spark, str(tmp_path))
    assert {r.Y for r in windows.collect()} == {0} and windows.count() >= 8
    got = QUERIES["fold_training"](spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["fold", "n", "scored", "measured"]


def test_balanced_classes(spark):
    for one, zero in ((3, 10), (10, 3), (4, 8), (5, 5), (0, 4)):
        df = spark.createDataFrame([(f"e{i % 4}", f"w{i}", int(i < one)) for i in range(one + zero)],
                                   "country_std string, week_end string, Y int")
        got = models.balanced(df).groupBy("week_end", "Y").count().collect()
        sizes = {y: sum(r["count"] for r in got if r.Y == y) for y in (0, 1)}
        assert sizes == ({1: max(one, zero), 0: max(one, zero)} if one and zero
                         else {1: one, 0: zero})
        assert len(got) == one + zero
        for y in (0, 1):
            each = [r["count"] for r in got if r.Y == y]
            assert not each or max(each) - min(each) <= 1


def test_perceptron_beats_the_linear_learner_on_a_curved_edge(spark):
    from panelrisk.operators import metrics

    x, y = (F.sin(F.col("id") * k) * 2 for k in (1.7, 0.37))
    df = spark.range(600).select(
        F.lit("e").alias("country_std"), F.concat(F.lit("w"), "id").alias("week_end"),
        F.array(x, y).alias("Z"), (x * y > 0).cast("int").alias("Y"),
        (F.col("id") % 3 == 0).alias("held"))
    own = df.filter("not held")
    nets = {"linear": models.fit_linear(models.class_weights(own)), "net": models.fit_perceptron(own)}
    auc = {k: metrics.auc_ap(metrics.ranking_curve(models.score(
        m, df.filter("held"), "p", steps="Z"), "Y", "p")).first().auc for k, m in nets.items()}
    assert auc["linear"] < 0.65 and auc["net"] > 0.9


def test_perceptron_in_the_ensemble_is_stored(spark, table):
    folder = scratch(spark, "net")
    scored, report = training.train(table, ["f"], folder, iterations=3, sequence="perceptron")
    again, _, _ = training.evaluate_saved(spark, folder, table, "val")
    a = {(r.country_std, r.week_end): r.p_sequence for r in
         scored.filter("split = 'val'").collect()}
    b = {(r.country_std, r.week_end): r.p_sequence for r in again.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert report.first().test.sequence.auc > 0.9
