"""Files in and out."""

import random

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry

from panelrisk.sources import files, quoted
from panelrisk.sources.registry import Sources
from panelrisk.workload import scan_queries


def test_damaged_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b,c\n1,2.5,x\n2\n3,4.0,"y,z",extra\nq,1.0,w\n5,,\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()),
                           T.StructField("b", T.DoubleType()),
                           T.StructField("c", T.StringType())])
    df = files.scan_csv(spark, str(p), schema)
    good = [tuple(r) for r in files.accepted(df).collect()]
    assert good == [(1, 2.5, "x"), (2, None, None), (5, None, None)]
    counts = {r.outcome: r.rows for r in files.rejected_counts(df).collect()}
    assert counts == {"accepted": 3, "too many cells": 1, "bad a": 1}


def test_ingest_routes_unites_and_validates(spark, tmp_path):
    for name, text in (("V-Dem_1.csv", "year,country_std,v2x_libdem\n2000,a,0.5\n"),
                       ("vdem_2.csv", "year,country_std,v2x_corr\n2001,b,0.1\n"),
                       ("plain.csv", "k\n1\n")):
        (tmp_path / name).write_text(text)
    got = files.ingest(spark, sorted(str(f) for f in tmp_path.glob("*.csv")),
                       str(tmp_path / "out"))
    assert set(got) == {"vdem", "plain"}
    df = spark.read.parquet(got["vdem"])
    r = files.validate(df, "vdem").first()
    assert (r.rows, r.columns, r.entities, r.period_min, r.period_max) == (2, 4, 2, "2000",
                                                                           "2001")
    assert r.missing == "group,v2elintim"
    assert files.conversion_stats(spark, str(tmp_path), got["vdem"]).first().rows == 2


def test_cells_are_bound_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("country_std,x,year\nb,2.5,2001\n")
    (tmp_path / "in" / "b.csv").write_text('year,other\n2002,"multi\nline"\n2003,z\n')
    schema = T.StructType.fromDDL("year int, country_std string, x double")
    df = files.scan_csv(spark, str(tmp_path / "in"), schema)
    assert sorted(map(tuple, files.accepted(df).collect())) == [(2001, "b", 2.5), (2003, None, None)]
    assert df.filter("_reject = 'open quote'").count() == 2


def test_one_odd_cell_does_not_stop_an_ingest(spark, tmp_path):
    (tmp_path / "thing_1.csv").write_text("k,v\n1,1\n")
    (tmp_path / "thing_1b.csv").write_text("v,k\nn/a,2\n")
    got = files.ingest(spark, [str(tmp_path / "thing_1.csv")], str(tmp_path / "o1"))
    assert spark.read.parquet(got["thing_1"]).dtypes == [("k", "int"), ("v", "int")]
    (tmp_path / "vdem_a.csv").write_text("year,x\n2000,1\n")
    (tmp_path / "vdem_b.csv").write_text("x,year\nn/a,2001\n")
    got = files.ingest(spark, [str(tmp_path / f"vdem_{c}.csv") for c in "ab"], str(tmp_path / "o2"))
    assert sorted(map(tuple, spark.read.parquet(got["vdem"]).select("year", "x").collect())) \
        == [(2000, "1"), (2001, "n/a")]


def test_registry(spark, sf):
    s = Sources(spark, sf, ["orders", "nope"], required=["orders"])
    assert list(s.present()) == ["orders"] and s["nope"] is None
    assert s.has("orders", "o_orderkey") and not s.has("orders", "x")
    with pytest.raises(FileNotFoundError):
        Sources(spark, sf, ["nope"], required=["nope"])


def test_union_of_nothing():
    with pytest.raises(ValueError):
        files.union_extracts([None])


def test_headers_go_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\nk,v\n1,x\x01y\n\n2, z\\\n")
    (tmp_path / "in" / "b.csv").write_text('\ufeff"k", v \n3,"u,w"\n')
    (tmp_path / "in" / "c.csv").write_text("")
    df = files.scan_csv(spark, str(tmp_path / "in"), T.StructType.fromDDL("k string, v string"))
    assert sorted(map(tuple, files.accepted(df).collect())) == [
        ("1", "x\x01y"), ("2", " z\\"), ("3", "u,w"), ("k", "v")]
    numbers = files.scan_csv(spark, str(tmp_path / "in"), T.StructType.fromDDL("k int, v string"))
    assert {r.outcome: r.rows for r in files.rejected_counts(numbers).collect()} \
        == {"accepted": 3, "bad k": 1}


def test_extracts_are_folders_of_many_files(spark, sf, tmp_path):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    customer.repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        for p in scan_queries._two_extracts(spark, str(tmp_path)):
            lines = [spark.read.text(f).count() for f in files.list_csv_files(spark, [p])[p]]
            assert len(lines) == 3 and min(lines) > 1
        for name in ("csv_by_header", "csv_by_header_multi_line"):
            got, want = (sorted(map(str, entry.queries()[name](spark, folder).collect()))
                         for folder in (str(tmp_path), sf))
            assert got == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unclosed_quote_is_rejected(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x\n2,y\n3,z\n')
    (tmp_path / "y.csv").write_text('a,b\n4,"u\nv"\n5,w')
    df = files.scan_csv(spark, str(tmp_path), T.StructType.fromDDL("a int, b string"), multi_line=True)
    assert sorted(map(tuple, files.accepted(df).collect())) == [(4, "u\nv"), (5, "w")]
    assert {r.outcome: r.rows for r in files.rejected_counts(df).collect()} \
        == {"accepted": 2, "open quote": 1}


@pytest.fixture
def small_splits(spark):
    def split(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield split
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def fuzzed_csv(seed):
    rnd = random.Random(seed)

    def cell():
        kind = rnd.random()
        if kind < 0.6:
            return rnd.choice(["", "a", "é b", 'a"b', 'x""y', "12"])
        return '"' + "".join(rnd.choices(["a", ",", "\n", '""', "\r\n", "é", "\n\n"],
                                         k=rnd.randint(0, 12))) + '"'

    rows = [",".join(["r", *(cell() for _ in range(rnd.randint(0, 3)))]) for _ in range(50)]
    return "h1,h2,h3,h4\n" + "\n".join(rows) + rnd.choice(["", "\n"])


@pytest.mark.parametrize("seed, size", [(1, 13), (2, 40), (3, 90)])
def test_split_quotes_equal_the_whole_file(spark, tmp_path, small_splits, seed, size):
    path = tmp_path / "x.csv"
    path.write_text(fuzzed_csv(seed), newline="")
    schema = T.StructType.fromDDL("h1 string, h2 string, h3 string, h4 string")
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .option("lineSep", "\n").schema(schema).csv(str(path)).collect()
    small_splits(size)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
    got = files.accepted(files.scan_csv(spark, str(path), schema, multi_line=True))
    assert sorted(map(str, got.collect())) == sorted(map(str, whole))


def test_cell_over_many_splits_and_unclosed_tail(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,"{long}\n')
    (tmp_path / "b.csv").write_text('k,v\n3,x\n')
    small_splits(64)
    df = files.scan_csv(spark, str(tmp_path), T.StructType.fromDDL("k int, v string"),
                        multi_line=True)
    assert sorted(map(tuple, files.accepted(df).collect())) == [(1, long), (3, "x")]
    assert df.filter("_reject = 'open quote'").count() == 1


def test_quotes_inside_cells():
    for line, outside, inside in (('a,b', False, True), ('a,"b', True, False), ('"a"", b', True, False),
                                  ('5" pipe,x', False, False), ('x",y', False, False),
                                  ('x","y', True, True), ('""', False, True), ('"', True, False),
                                  ('a"",b', False, True), ('x"y,"z', True, True)):
        assert quoted.inside_after(line, False) == outside, line
        assert quoted.inside_after(line, True) == inside, line


def jobs_of(spark, action):
    group = str(random.random())
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_catalogue_takes_three_jobs_for_any_number_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / "in" / f"part {i}%.csv").write_text(
            f"k,v{i % 2}\n{i},{'2001-01-0' + str(i % 9 + 1)}\n" if i % 3 else "v0,k\nno,7.5\n")
    jobs, df = jobs_of(spark, lambda: files.scan_csv(spark, str(tmp_path / "in")))
    assert jobs <= 3
    assert dict(df.dtypes) == {"_reject": "string", "k": "double", "v0": "string", "v1": "date"}
    assert files.accepted(df).count() == 40
    schema = T.StructType.fromDDL("k double")
    assert jobs_of(spark, lambda: files.scan_csv(spark, str(tmp_path / "in"), schema))[0] <= 2


def test_types_by_all_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "i,l,d,b,t,s,e\n1,3000000000,1e3,true,2001-01-01 10:00:00,2001-05,\n 2 ,,NaN,FALSE,"
        "2001-01-02,x,\n")
    df = files.scan_csv(spark, str(tmp_path / "x.csv"))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "boolean", "timestamp",
                                         "string", "string", "string"]
