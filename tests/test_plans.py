"""What the plans must look like, and results under a hot key."""

import bisect

from conftest import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelrisk.operators import entities, metrics, neighbors, normalize, panel
from panelrisk.plans import panels


def test_no_python_on_the_batch_path(spark, sf):
    for name in ("weekly_panel", "annual_index", "ranking_metrics", "sliding_windows",
                 "alias_names", "box_summary"):
        p = plan_of(entry.queries()[name](spark, sf))
        assert "Python" not in p and "ArrowEval" not in p, name


def test_lookup_tables_are_broadcast(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("raw"))
    p = plan_of(entities.canonicalise(df, "raw"))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_scan_is_pruned_and_pushed(spark, sf):
    p = plan_of(entry.queries()["entity_series"](spark, sf))
    assert "l_comment" not in p and "l_orderkey" not in p
    assert "EqualTo(n_name,NATION_3)" in p


def test_no_cartesian_product(spark, sf):
    for name in ("dense_grid", "annual_index", "mad_outliers", "overall_evaluation",
                 "histogram_data_range", "class_weights"):
        p = plan_of(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_period_filter_stays_above_the_windows(spark):
    u = spark.createDataFrame([("a", y, "A", d) for y, d in
                               ((2012, 10), (2013, 20), (2014, 10))],
                              "country_std string, year int, group string, total_deaths int")
    rows = {r.year: r.ESC for r in panels.annual_index({"ucdp": u}, period=(2013, 2024)).collect()}
    # 2013 sees 2012 although 2012 is outside the period
    assert set(rows) == {2013, 2014} and rows[2013] > 0


def test_hot_entity_gives_the_same_z(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 50))
        .alias("country_std"), F.col("id").alias("k"), ((F.col("id") * 31) % 97).alias("x"))
    a = normalize.zscores(rows, ["x"], grain="rows").agg(F.sum("x_z"), F.count("x_z")).first()
    b = normalize.zscores(rows, ["x"], grain="panel").agg(F.sum("x_z"), F.count("x_z")).first()
    assert a[1] == b[1] == 9000 and abs(a[0] - b[0]) < 1e-6


def test_hot_score_and_hot_key_in_ranking(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"),
        F.when(F.col("id") % 3 == 1, 0.5).otherwise((F.col("id") % 1000) / 1000.0).alias("p"),
        (F.col("id") % 7 < 3).cast("int").alias("y"))
    got = {r.g: r.auc for r in
           metrics.auc_ap(metrics.ranking_curve(df, "y", "p", ["g"], slices=5), ["g"]).collect()}
    data = [(r.g, r.p, r.y) for r in df.collect()]
    for g in got:
        pos = sorted(p for k, p, y in data if k == g and y)
        neg = [p for k, p, y in data if k == g and not y]
        wins = sum(len(pos) - (bisect.bisect_left(pos, n) + bisect.bisect_right(pos, n)) / 2
                   for n in neg)
        assert abs(got[g] - wins / len(pos) / len(neg)) < 1e-9


def test_shares_do_not_use_row_windows(spark):
    df = spark.createDataFrame([("a", "A", "w", 2.0)],
                               "country_std string, group string, week_id string, "
                               "Z_CII_90d double")
    assert "Window" not in plan_of(neighbors.tier_share(df))


def test_grid_calendar_is_one_value(spark):
    df = spark.createDataFrame([("a", "A", "2020-01", 2020, 1)],
                               "country_std string, group string, week_id string, year int, "
                               "week_num int")
    assert "NestedLoop" not in plan_of(panel.dense_grid(df))
