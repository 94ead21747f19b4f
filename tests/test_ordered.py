"""Distributed order statistics against brute force, with several slices and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import ordered, quality, sequences
from panelrisk.operators.ordered import (exact_quantiles, global_index, join_checked, keep_first,
                                         running_totals)


def test_running_totals_over_slices(spark):
    rng = random.Random(1)
    # a third of the rows in one group
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", i * 0.5, rng.randint(0, 9))
            for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o double, v long").repartition(5)
    got = {(r.g, r.o): (r.v_before, r.v_total) for r in
           running_totals(df, [F.desc("o")], ["v"], ["g"], slices=6).collect()}
    assert len(got) == len(rows)
    for g, o, v in rows:
        before = sum(x for a, b, x in rows if a == g and b > o)
        total = sum(x for a, b, x in rows if a == g)
        assert got[g, o] == (before, total)


def test_running_totals_without_group_and_null_key(spark):
    df = spark.range(100).select(F.col("id").alias("o"), F.lit(2).alias("v"),
                                 F.when(F.col("id") % 2 == 0, "a").alias("g"))
    flat = running_totals(df, ["o"], ["v"], slices=5)
    assert all(r.v_before == 2 * r.o and r.v_total == 200 for r in flat.collect())
    by = running_totals(df, ["o"], ["v"], ["g"], slices=5)
    assert all(r.v_before == 2 * (r.o // 2) and r.v_total == 100 for r in by.collect())


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_global_index(spark, slices):
    df = spark.createDataFrame([(f"{(i * 7919) % 1000:04d}",) for i in range(1000)], "k string")
    rows = global_index(df.repartition(4), ["k"], slices=slices).collect()
    assert sorted(r.row_index for r in rows) == list(range(1000))
    assert all(int(r.k) == r.row_index and r.row_index_total == 1000 for r in rows)


@pytest.mark.parametrize("slices", [1, 7])
def test_exact_quantiles(spark, slices):
    rng = np.random.default_rng(2)
    hot = [("a", float(x)) for x in rng.normal(size=301)] + [("a", 0.0)] * 200
    cold = [("b", float(x)) for x in rng.integers(0, 5, 60)] + [("c", 1.5)] + [("d", None)]
    df = spark.createDataFrame(hot + cold, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["x"], probs, ["g"], slices).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        values = [x for k, x in hot + cold if k == g]
        want = np.percentile(values, [100 * p for p in probs])
        have = [got[g][c] for c in ("q0", "q0_1", "q0_25", "q0_5", "q0_75", "q1")]
        assert got[g].n == len(values)
        assert np.allclose(have, want)


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None)],
                               "k string, t int, v string")
    rows = {r.k: (r.t, r.v) for r in keep_first(df, ["k"], ["t"]).collect()}
    assert rows == {"a": (1, "y"), "b": (5, None)}


def test_join_checked_same_result_on_both_ways(spark):
    df = spark.range(50).withColumn("k", F.col("id") % 5)
    side = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = join_checked(df, side, ["k"])
    large = join_checked(df, side, ["k"], limit=2)
    assert sorted(small.collect()) == sorted(large.collect())
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert {r.v for r in small.collect()} == {0, 10, 20, 30, None}


def test_owned_pins_are_deleted(spark):
    from pathlib import Path

    from panelrisk.session import owned_pins, pin

    with owned_pins(spark) as paths:
        assert pin(spark.range(5)).count() == 5
        folder = Path(paths[0].removeprefix("file:"))
        assert folder.exists()
    assert not folder.exists()


@pytest.mark.parametrize("kind", ["normal", "few", "heavy"])
def test_quantiles_of_sketched_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(ordered, "ACCURACY", 100)
    monkeypatch.setattr(ordered, "SMALL_GROUP", 400)
    rng = np.random.default_rng(7)
    x = {"normal": rng.normal(size=6000), "few": rng.integers(0, 9, 6000).astype(float),
         "heavy": np.where(rng.random(6000) < 0.6, 5.0, rng.exponential(size=6000) * 9)}[kind]
    hot = np.arange(6000) % 3 > 0
    df = spark.createDataFrame([("hot" if h else "cold", float(v)) for h, v in zip(hot, x)]
                               + [("small", float(v)) for v in x[:50]], "g string, x double") \
        .repartition(7)
    probs = [0.0, 0.004, 0.25, 0.5, 0.75, 0.999, 1.0]
    for r in exact_quantiles(df, ["x"], probs, ["g"], 5).collect():
        own = x[hot] if r.g == "hot" else x[~hot] if r.g == "cold" else x[:50]
        assert r.n == len(own)
        assert np.allclose(list(r)[3:], np.percentile(own, [100 * p for p in probs]))


def test_only_values_inside_brackets_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ACCURACY", 200)
    monkeypatch.setattr(ordered, "SMALL_GROUP", 800)
    seen = []
    sliced = ordered._sliced
    monkeypatch.setattr(ordered, "_sliced", lambda df, *a: seen.append(sliced(df, *a)) or seen[-1])
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    got = exact_quantiles(df, ["x"], [0.25, 0.5]).first()
    assert (got.q0_25, got.q0_5) == (4999.75, 9999.5)
    # two brackets of at most eight parts in 200 each, and three gaps
    assert seen[0].count() <= 2 * 8 * 100 + 3
    assert seen[0].agg(F.sum("cnt")).first()[0] == 20_000


def test_cut_keys_move_keys_only(spark):
    rows = [(i * 37 % 101, f"k{i % 3}", "x" * 50) for i in range(101)] + [(None, "k", "y")]
    df = spark.createDataFrame(rows, "a int, b string, wide string").repartition(5)
    cut = ordered.cut_keys(df, ["a", "b"], lambda i, total: i % 10 == 0)
    assert cut.columns == ["a", "b"]
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(map(str, cut.collect())) == sorted(
        f"Row(a={r[0]}, b='{r[1]}')" for r in in_order[::10])
    got = quality.systematic_sample(df, ["a", "b"], 10)
    assert sorted(map(str, got.collect())) == sorted(
        f"Row(a={a}, b='{b}', wide='{w}')" for a, b, w in in_order[::10])
    for parts in (1, 4, 7):
        step = len(rows) // parts
        want = sorted((str(r[0]), min(parts, i // step)) for i, r in enumerate(in_order))
        blocks = sequences.time_blocks(df, ["a", "b"], parts).collect()
        assert sorted((str(r.a), r.block) for r in blocks) == want
    assert [r.block for r in sequences.time_blocks(df.limit(2), ["a"], 3).collect()] == [3, 3]


def test_distinct_counts_and_sketches(spark):
    rows = [(i % 7, None if i % 2 else float("nan") if i % 3 else 0.0, "same", None)
            for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d string")
    got = {r.variable: r.distinct_values for r in quality.column_profile(df).collect()}
    assert got == {"a": 7, "b": 2, "c": 1, "d": 0}
    parts = [quality.distinct_sketches(df.filter(f"a % 2 = {k}"), df.columns) for k in (0, 1)]
    merged = {r.variable: r.distinct_values for r in quality.distinct_estimates(*parts).collect()}
    assert merged == got
    assert {r.variable: r.distinct_values
            for r in quality.column_profile(df, approximate=True).collect()} == got
