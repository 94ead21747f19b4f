"""Streams fed in several files equal their batch twins."""

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import panel
from panelrisk.session import scratch
from panelrisk.streaming import streams
from panelrisk.streaming.versioned import Versioned
from panelrisk.workload.base import table, user_days


@pytest.fixture(scope="module")
def by_day(spark, sf):
    """events as one file per three days, in order of modification."""
    out = scratch(spark, "by-day")
    e = table(spark, sf, "events").withColumn("part", F.floor(F.dayofmonth("ts") / 3))
    for r in e.select("part").distinct().orderBy("part").collect():
        e.filter(F.col("part") == r.part).drop("part").coalesce(1).write.mode("append") \
            .parquet(out)
    return out


def _stream(spark, sf, folder):
    s = streams.file_stream(spark, folder, table(spark, sf, "events").schema,
                            files_per_batch=1)
    return streams.event_time(s, delay="4 days").withColumn("volume", F.floor("value"))


def test_daily_rollup_over_batches(spark, sf, by_day):
    out = scratch(spark, "out")
    streams.run_updates(streams.media_daily_stream(_stream(spark, sf, by_day)), out,
                        ["day", "user_id", "event_type"])
    got = streams.latest(spark, out, ["day", "user_id", "event_type"])
    want = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "user_id",
                                              "event_type").agg(F.count("*").alias("n"))
    pairs = lambda df: sorted((str(r.day)[:10], r.user_id, r.event_type, r.n)
                              for r in df.collect())
    assert pairs(got) == pairs(want)


def test_restart_continues_counts(spark, sf, by_day):
    out, state = scratch(spark, "out"), scratch(spark, "state")
    for _ in range(2):
        s = streams.file_stream(spark, by_day, table(spark, sf, "events").schema,
                                files_per_batch=2)
        streams.run_updates(streams.running_counts(s, ["event_type"]), out, ["event_type"], state)
    got = {r.event_type: r.rows for r in streams.latest(spark, out, ["event_type"]).collect()}
    want = {r.event_type: r["count"] for r in
            table(spark, sf, "events").groupBy("event_type").count().collect()}
    assert got == want


def test_carry_forward_over_batches(spark, sf):
    days, out = scratch(spark, "days"), scratch(spark, "out")
    d = user_days(spark, sf).select("country_std", "day", "signal").cache()
    for low, high in ((1, 10), (11, 20), (21, 31)):
        d.filter(F.dayofmonth("day").between(low, high)).coalesce(1).write.mode("append") \
            .parquet(days)
    s = streams.file_stream(spark, days, spark.read.parquet(days).schema, files_per_batch=1)
    keys = ["country_std", "day"]
    streams.run_updates(streams.carry_forward(s, "country_std", "day", "signal", delay="12 days"),
                        out, keys, timers=True)
    want = panel.fill_forward(d, ["signal"], 1.0, order=["day"])
    got = streams.latest(spark, out, keys).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_sliding_mean_twin(spark, sf, by_day):
    out = scratch(spark, "out")
    streams.run_updates(streams.sliding_mean(_stream(spark, sf, by_day)), out,
                        ["start", "user_id"])
    got = streams.latest(spark, out, ["start", "user_id"]).agg(F.sum("n")).first()[0]
    assert got == 14 * table(spark, sf, "events").count()


def _days(spark, folder, batches):
    """One file per batch of (key, day of 2024, value)."""
    for rows in batches:
        spark.createDataFrame(rows, "k string, d int, v double").select(
            "k", F.expr("date_add(DATE'2024-01-01', d)").alias("day"), "v").coalesce(1) \
            .write.mode("append").parquet(folder)


def _filled(spark, folder, **options):
    out = scratch(spark, "out")
    s = streams.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    query = streams.run_updates(streams.carry_forward(s, "k", "day", "v", **options), out,
                                ["k", "day"], timers=True)
    rows = streams.latest(spark, out, ["k", "day"]).collect()
    return {(r.k, r.day.timetuple().tm_yday - 1): r.v for r in rows}, query


def test_late_rows_repair_what_lies_behind_them(spark):
    folder = scratch(spark, "late")
    _days(spark, folder, [
        [("a", 0, 5.0), ("a", 2, None), ("a", 3, None), ("b", 3, None)],
        [("a", 1, 7.0), ("a", 4, None)],     # late, but inside the window: days 2 to 4 follow it
        [("a", 30, None), ("b", 31, 2.0)],
        [("b", 60, None)],
        [("a", 3, 9.0), ("a", 61, None)]])   # its window has closed: nothing else changes
    got, _ = _filled(spark, folder, delay="3 days")
    assert got["a", 0] == 5.0 and got["a", 1] == 7.0
    assert [got["a", d] for d in (2, 4, 30, 61)] == [7.0] * 4
    assert (got["b", 3], got["b", 31], got["b", 60]) == (1.0, 2.0, 2.0)


def test_state_is_bounded_by_the_window_and_forgets(spark):
    folder = scratch(spark, "long")
    _days(spark, folder, [[("a", d, float(d)) for d in range(lo, lo + 30)]
                          for lo in (0, 30, 60, 90)] + [[("z", 130, None)], [("a", 200, None)]])
    got, query = _filled(spark, folder, delay="2 days")
    assert got["a", 119] == 119.0 and got["a", 200] == 119.0
    rows = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(rows) < 130 and rows[-1] < 20  # the window of a batch, then almost nothing
    got, _ = _filled(spark, folder, delay="2 days", forget="20 days")
    assert got["a", 119] == 119.0 and got["a", 200] == 1.0


def _table(spark):
    return Versioned(spark, scratch(spark, "versions"), ["k"])


def test_versions_fold_into_few_runs(spark):
    table, want = _table(spark), {}
    assert table.read() is None
    for batch in range(12):
        rows = [(k, batch * 10 + k) for k in range(batch % 3, 9, 2)]
        table.update(spark.createDataFrame(rows, "k int, v int"), batch)
        want.update(rows)
    assert dict(map(tuple, table.read().select("k", "v").collect())) == want
    state = table.manifest()
    assert sum(n for _, n in state["runs"]) <= 2 * len(want) and len(state["runs"]) <= 3
    held = spark.read.option("recursiveFileLookup", True).parquet(f"{table.folder}/runs")
    assert held.count() <= 4 * len(want)  # of twelve batches only what two manifests name


def test_repeated_and_broken_batches(spark, monkeypatch):
    table = _table(spark)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int")
    table.update(frame([(1, 1), (2, 1)]), 0)
    table.update(frame([(1, 2)]), 1)
    table.update(frame([(1, 2)]), 1)  # the query restarts before it has noted the batch
    with monkeypatch.context() as m:
        m.setattr(Versioned, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.update(frame([(2, 3)]), 2)
    assert sorted(map(tuple, table.read().select("k", "v").collect())) == [(1, 2), (2, 1)]
    table.update(frame([(2, 3)]), 2)
    table.update(frame([]), 3)
    assert sorted(map(tuple, table.read().select("k", "v").collect())) == [(1, 2), (2, 3)]
    assert table.manifest()["batch"] == 3
