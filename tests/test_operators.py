"""Operators on small frames with the awkward cases: NULL, NaN, ties, flat series, gaps."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelrisk.functions import columns as cols
from panelrisk.functions import scalars as fn
from panelrisk.operators import (composite, entities, metrics, neighbors, normalize, panel,
                                 quality, rolling, rollups, sequences)
from panelrisk.plans import panels


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (float("nan"), 1.0), (9.0, -3.0)],
                               "a double, b double")
    rows = df.select(fn.clip("a", -2.0, 2.0).alias("c"), fn.safe_div("a", "b").alias("d"),
                     fn.zero("a").alias("z")).collect()
    assert rows[0].c == 1.0 and rows[1].c is None and rows[3].c == 2.0
    assert rows[0].d is None and rows[3].d == -3.0
    assert [r.z for r in rows] == [1.0, 0.0, 0.0, 9.0]


def test_number_parsing(spark):
    df = spark.createDataFrame([("3",), ("-4",), ("x",), (None,), ("NaN",)], "t string")
    rows = df.select(fn.number("t").alias("n"), fn.non_negative("t").alias("p")).collect()
    assert [r.n for r in rows] == [3.0, -4.0, None, None, None]
    assert [r.p for r in rows] == [3.0, 0.0, 0.0, 0.0, 0.0]


def test_iso_year_rollover(spark):
    df = spark.createDataFrame([("2020-12-31",), ("2021-01-01",), ("2021-01-04",), ("2021-7",),
                                ("2020-W53",), ("2021-02",), ("bad",)], "event_date string")
    ids = [r.week_id for r in cols.with_week(df).collect()]
    assert ids == ["2020-53", "2020-53", "2021-01", "2021-07", "2020-53", "2021-02", None]


def test_target_week(spark):
    df = spark.createDataFrame([("2020-53",), ("2021-01-04",)], "w string")
    assert [r[0] for r in df.select(fn.target_week("w")).collect()] == ["2021-03-29",
                                                                       "2021-04-05"]


def test_column_resolvers(spark):
    df = spark.createDataFrame([(1, "x")], "YR int, Country string")
    assert cols.standardise_names(df).columns == ["year", "country"]
    assert cols.entity_column(df) == "Country"
    assert cols.entity_column(spark.createDataFrame([(1,)], "SQLDATE int")) is None
    with pytest.raises(ValueError):
        cols.entity_column(df, "nope")
    assert cols.time_axis(spark.createDataFrame([("a",)], "week_end string")) == ("week_end", 13)
    with pytest.raises(KeyError):
        cols.time_axis(df)


def test_null_tier_joins_other(spark):
    df = spark.createDataFrame([(2000, "a", None, 1, 5, "2000-01-01"),
                                (2000, "a", "OTHER", 3, 2, "2000-01-09"),
                                (2000, "a", "OTHER", 2, None, "2000-03-09")],
                               "year int, country_std string, group string, "
                               "type_of_violence int, best int, date_start string")
    rows = panels.annual_panel(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.event_count, r.total_deaths, r.deaths_state, r.deaths_nonstate, r.deaths_onesided,
            r.active_months) == (3, 7, 5, 0, 2, 2)


def test_active_months_week_53_is_december(spark):
    df = spark.createDataFrame([("2020-53",), ("2020-W52",), ("2020-01-02",)], "week string")
    m = [r[0] for r in df.select(rollups.month_expression(df)).collect()]
    assert m == [12, 12, 1]


def test_zscore_guards(spark):
    df = spark.createDataFrame([("one", 1, 5.0), ("flat", 1, 2.0), ("flat", 2, 2.0),
                                ("ok", 1, 1.0), ("ok", 2, 3.0), ("ok", 3, None),
                                ("nan", 1, float("nan")), ("nan", 2, 1.0), ("nan", 3, 3.0)],
                               "country_std string, t int, x double")
    for grain in ("panel", "rows"):
        z = {(r.country_std, r.t): r.x_z for r in
             normalize.zscores(df, ["x"], grain=grain).collect()}
        assert z == {("one", 1): 0.0, ("flat", 1): 0.0, ("flat", 2): 0.0, ("ok", 1): -1.0,
                     ("ok", 2): 1.0, ("ok", 3): 0.0, ("nan", 1): 0.0, ("nan", 2): -1.0,
                     ("nan", 3): 1.0}


def test_zscore_bound(spark):
    df = spark.createDataFrame([("a", float(i == 0) * 1e6) for i in range(200)],
                               "country_std string, x double")
    z = [r.x_z for r in normalize.zscores(df, ["x"]).collect()]
    assert max(z) == 8.0
    h = normalize.health_check(normalize.zscores(df, ["x"]), ["x_z"]).first()
    assert h.z_max == 8.0


def test_fills_stay_inside_the_entity(spark):
    df = spark.createDataFrame([("a", 1, 7.0), ("a", 2, None), ("b", 1, None), ("b", 2, None),
                                ("c", 1, None), ("c", 2, 4.0)],
                               "country_std string, t int, x double")
    both = {(r.country_std, r.t): r.x for r in
            panel.fill_both_ways(df, ["x"], order=["t"]).collect()}
    assert both[("b", 1)] is None and both[("b", 2)] is None
    assert both[("c", 1)] == 4.0 and both[("a", 2)] == 7.0
    ahead = {(r.country_std, r.t): r.x for r in
             panel.fill_forward(df, ["x"], 1.0, order=["t"]).collect()}
    assert ahead[("c", 1)] == 1.0 and ahead[("a", 2)] == 7.0


def test_dense_grid_cardinality_and_tier(spark):
    df = spark.createDataFrame([("a", None, "2020-01", 2020, 1, 3), ("a", "B", "2020-05", 2020, 5, 1),
                                ("b", None, "2020-02", 2020, 2, 9)],
                               "country_std string, group string, week_id string, year int, "
                               "week_num int, n int")
    g = panel.dense_grid(df)
    rows = {(r.country_std, r.week_id): (r.group, r.n) for r in g.collect()}
    assert len(rows) == 6
    assert rows[("a", "2020-02")] == ("B", None) and rows[("b", "2020-02")] == ("OTHER", 9)


def test_baseline_z_needs_history(spark):
    df = spark.createDataFrame([("a", i, float(10 if i == 13 else 0)) for i in range(15)],
                               "country_std string, t int, x double")
    z = [r.z for r in rolling.baseline_z(df, "x", order=["t"]).orderBy("t").collect()]
    assert z[:13] == [0.0] * 13 and z[13] == 10.0


def test_leader_sequence_with_null(spark):
    df = spark.createDataFrame([("a", 2000, i, v) for i, v in enumerate(["a", None, "a", "b"])],
                               "country_std string, year int, month int, leader string")
    out = [r.leader_change for r in rolling.state_changes(df).orderBy("month").collect()]
    assert out == [0, 1, 0, 1]


def test_onset(spark):
    df = spark.createDataFrame([("a", y, w) for y, w in
                                zip(range(2000, 2005), [-1.0, 0.0, None, -0.5, -0.4])],
                               "country_std string, year int, WRI double")
    rows = {r.year: (r.is_active_conflict, r.Y) for r in rolling.onset_labels(df, 1).collect()}
    assert rows == {2000: (0, 1), 2001: (1, 0), 2002: (0, 0), 2003: (0, 1)}


def test_spillover_and_region_share(spark):
    df = spark.createDataFrame([("Syria", "w", 4.0), ("Iraq", "w", 9.0), ("Mali", "w", 1.0)],
                               "country_std string, week_id string, CII double")
    s = {r.country_std: r.spillover for r in neighbors.spillover(df).collect()}
    assert math.isclose(s["Syria"], 9.0 / (math.sqrt(605) + 1)) and s["Mali"] == 0.0
    z = spark.createDataFrame([("Syria", 1, 2.0), ("Iraq", 1, 0.0), ("Yemen", 1, 1.6),
                               ("Mali", 1, 3.0), ("Narnia", 1, 9.0)],
                              "country_std string, year int, Z_CII_90d double")
    r = {x.country_std: x.regcluster for x in neighbors.region_share(z).collect()}
    assert r == {"Syria": 0.5, "Iraq": 1.0, "Yemen": 0.5, "Mali": 0.0, "Narnia": 0.0}


def test_names_and_codes(spark):
    df = spark.createDataFrame([(" SYRIA",), ("dprk",), ("Nowhere",), (None,)], "raw string")
    rows = [(r.country_std, r.group) for r in
            entities.assign_tier(entities.canonicalise(df, "raw")).collect()]
    assert sorted(rows, key=str) == sorted(
        [("Syria", "A"), ("North Korea", "OTHER"), ("Nowhere", "OTHER"), (None, "OTHER")],
        key=str)
    custom = spark.createDataFrame([("FOO", "Foo Land")], "alias string, canonical string")
    one = spark.createDataFrame([("foo",)], "raw string")
    assert entities.canonicalise(one, "raw", aliases=custom).first().country_std == "Foo Land"


def test_repair_report_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, None), ("Swaziland", "B"), ("Swaziland", "B")],
                               "country_std string, group string")
    fixed = entities.repair(df, before="b")
    rep = entities.repair_report(fixed, "b", top=20).collect()
    assert [(r.before, r.after, r.rows) for r in rep] == [("Swaziland", "Eswatini", 2)]
    assert {r.group for r in fixed.collect()} == {"B", "OTHER"}


@pytest.mark.parametrize("weeks,expected", [(25, 0), (26, 1), (29, 1), (30, 2)])
def test_window_count(spark, weeks, expected):
    df = spark.range(weeks).select(F.lit("a").alias("country_std"), F.lit(2020).alias("year"),
                                   F.col("id").cast("int").alias("week_num"),
                                   F.format_string("2020-%02d", F.col("id")).alias("week_id"),
                                   F.col("id").cast("double").alias("f"), F.lit(1).alias("Y"))
    w = sequences.windows(df, ["f"])
    assert w.count() == expected
    stats = sequences.window_stats(df, ["f"])
    assert stats.count() == expected
    for r in w.collect():
        assert len(r.X) == 13 and all(len(s) == 1 for s in r.X)
    if expected:
        first = stats.orderBy("week_end").first()
        assert (first.f__last, first.f__mean, first.f__trend) == (12.0, 6.0, 12.0)
    assert sequences.windows(df.drop("Y"), ["f"]).filter("Y = -1").count() == (weeks - 13) // 4 + 1


def test_look_back_padding(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "country_std string, year int, f double")
    rows = {r.year: r.X for r in sequences.look_back(df, ["f"], 3).collect()}
    assert rows == {1: [[0.0], [0.0], [5.0]], 2: [[0.0], [5.0], [0.0]]}


def test_metrics_with_ties_and_single_class(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.9), ("x", 1, 0.5), ("x", 0, 0.1),
                                ("one", 1, 0.3), ("one", 1, 0.7)], "g string, y int, p double")
    c = metrics.ranking_curve(df, "y", "p", ["g"])
    m = {r.g: r for r in metrics.auc_ap(c, ["g"]).collect()}
    assert m["x"].auc == (0.5 + 1 + 1 + 0) / 4 and m["one"].auc is None
    assert math.isclose(m["x"].ap, 0.5 * 0.5 + 0.5 * 2 / 3)
    t = {r.g: r.threshold for r in metrics.best_f1_threshold(c, ["g"]).collect()}
    assert t == {"x": 0.5, "one": 0.5}
    b = {r.g: r for r in metrics.best_at_precision(c, 0.99, ["g"]).collect()}
    assert b["x"].threshold is None and b["x"].n_candidates == 0


def test_all_negative_predictions(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, p double")
    r = metrics.at_threshold(df, "y", "p", 0.9).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (0, 0, 1, 1, 0.0, 0.0, 0.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,), (None,)], "x double")
    h = {r.bin: r.rows for r in quality.histogram(df, "x", 2).collect()}
    assert h == {0: 1, 1: 2}
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = quality.histogram(same, "x", 4).orderBy("bin").collect()
    assert [r.rows for r in rows] == [2, 0, 0, 0] and rows[0].center == 3.125


def test_mad_zero_is_undetectable(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (50.0,)], "x double")
    r = quality.mad_outliers(df, "x").first()
    assert r.scaled_mad == 0.0 and r.outliers is None and r.low is None


def test_index_adapts_to_sources(spark):
    u = spark.createDataFrame([("a", 2013, "A", 5, 1.0), ("a", 2014, "A", 10, -1.0)],
                              "country_std string, year int, group string, total_deaths int, "
                              "total_deaths_z double")
    r = panels.annual_index({"ucdp": u}, period=(2013, 2024)).orderBy("year").first()
    assert r.CII == 0.5 and r.Econ == 0.0 and r.Spill == 0.0
    w = spark.createDataFrame([("a", 2013, 2.0, -1.0)],
                              "country_std string, year int, GDP_Growth_z double, "
                              "Inflation_z double")
    assert panels.annual_index({"ucdp": u, "wb": w}, period=(2013, 2024)).orderBy("year").first().Econ == -1.6
    f = w.select("country_std", "year", F.lit(4.0).alias("FoodShock_z"))
    assert panels.annual_index({"ucdp": u, "wb": w, "fao": f}, period=(2013, 2024)).orderBy("year").first().Econ \
        == pytest.approx(-0.8 - 0.25 + 1.0)
    with pytest.raises(ValueError):
        panels.annual_index({}, period=(2013, 2024))


def test_static_attribute_does_not_fan_out(spark):
    spine = spark.createDataFrame([("a", 1), ("a", 2)], "country_std string, year int")
    attr = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0)],
                                 "country_std string, year int, v double")
    assert panel.join_static(spine, attr, ["v"]).count() == 2


def test_shock_grades(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (0, 0, 0)],
                               "leader_change_flag int, election_flag int, "
                               "irregular_change_flag int")
    assert [r.PolitShock for r in composite.shock_grade(df).collect()] == [0.3, 0.7, 0.0]
    assert [r.PolitShock for r in composite.shock_grade(df, True).collect()] == [1.0, 0.7, 0.0]


def test_displacement_text(spark):
    df = spark.createDataFrame([("a", "2001", None, "5", "-3"), ("a", "2001", "B", "x", "2"),
                                ("a", "n.d.", "B", "1", "1")],
                               "country_std string, year string, group string, refugees string, "
                               "idps string")
    rows = rollups.consolidate_annual(df).collect()
    assert [(r.year, r.group, r.refugee_outflow, r.idp_count) for r in rows] == [
        (2001, "B", 5.0, 2.0)]


def test_week_monday(spark):
    df = spark.createDataFrame([("2021-01",), ("2020-53",)], "w string")
    assert [r[0] for r in df.select(fn.week_monday("w")).collect()] == [dt.date(2021, 1, 4),
                                                                       dt.date(2020, 12, 28)]


def test_calendar_refuses_moments(spark):
    df = spark.sql("SELECT 'a' AS country_std, 'A' AS `group`, current_timestamp() AS ts")
    with pytest.raises(ValueError, match="ts"):
        panel.dense_grid(df, period=["ts"], order=["ts"])


def test_first_code_system_counts(spark):
    own = spark.createDataFrame([("SYR", "Elsewhere", "C"), (" q1", "Norway", None),
                                 ("q2", "Nowhere", None), (None, "x", "A")],
                                "code string, canonical string, tier string")
    got = {r.code: (r.canonical, r.tier) for r in entities.code_systems(spark, own).collect()}
    assert got["SYR"] == ("Syria", "A") and got["WSB"] == ("West Bank", "OTHER")
    assert got["q1"] == ("Norway", "C") and got["q2"] == ("Nowhere", "OTHER") and None not in got
