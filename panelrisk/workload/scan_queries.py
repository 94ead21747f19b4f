"""Scans, sinks, parsing and filters."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions import columns as cols
from panelrisk.functions import scalars as fn
from panelrisk.operators import entities, quality
from panelrisk.operators.ordered import keep_first
from panelrisk.session import scratch
from panelrisk.sources import files
from panelrisk.sources.registry import Sources
from panelrisk.workload.base import (ANNUAL, COUNTS, EVENTS, SHIPMENTS, annual_sources,
                                     nation_events, query, r, rounded, shipments, table,
                                     weekly_counts, with_cte)


def _csv_lines(spark, sf, folder):
    """customer as CSV with damaged lines: short, too long, and a text balance."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 10
    cells = [F.col(n).cast("string") for n in ("c_custkey", "c_nationkey", "c_acctbal")]
    line = (F.when(k == 3, F.concat_ws(",", *cells[:2]))
            .when(k == 4, F.concat_ws(",", *cells, F.col("c_mktsegment"), F.lit("x")))
            .when(k == 5, F.concat_ws(",", *cells[:2], F.lit("abc"), F.col("c_mktsegment")))
            .otherwise(F.concat_ws(",", *cells, F.col("c_mktsegment"))))
    c.select(line.alias("value")).write.text(folder)


CUSTOMER_CSV = T.StructType([T.StructField("c_custkey", T.LongType()),
                             T.StructField("c_nationkey", T.IntegerType()),
                             T.StructField("c_acctbal", T.DoubleType()),
                             T.StructField("c_mktsegment", T.StringType())])


def _scan_damaged(spark, sf):
    folder = scratch(spark, "csv")
    _csv_lines(spark, sf, folder)
    return files.scan_csv(spark, folder, CUSTOMER_CSV, header=False)


@query("tolerant_csv_scan", """SELECT c_custkey, c_nationkey,
 CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS c_acctbal,
 CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment
 FROM customer WHERE c_custkey % 10 NOT IN (4, 5)""")
def tolerant_csv_scan(spark, sf):
    return files.accepted(_scan_damaged(spark, sf))


@query("csv_rejects", """SELECT CASE c_custkey % 10 WHEN 4 THEN 'too many cells'
 WHEN 5 THEN 'bad c_acctbal' ELSE 'accepted' END AS outcome, COUNT(*) AS rows
 FROM customer GROUP BY 1""")
def csv_rejects(spark, sf):
    return files.rejected_counts(_scan_damaged(spark, sf))


@query("parquet_scan", "SELECT c_custkey, c_acctbal FROM customer")
def parquet_scan(spark, sf):
    return files.read_parquet(spark, f"{sf}/customer.parquet", ["c_custkey", "c_acctbal"])


@query("parquet_sink", with_cte(COUNTS) + "SELECT * FROM counts")
def parquet_sink(spark, sf):
    out = scratch(spark, "sink")
    files.write_parquet(weekly_counts(spark, sf), out)
    return files.read_parquet(spark, out)


@query("csv_sink", with_cte(COUNTS) + """SELECT country_std, week_id, total_events
 FROM counts""")
def csv_sink(spark, sf):
    out = scratch(spark, "sink")
    files.write_csv(weekly_counts(spark, sf).select("country_std", "week_id", "total_events"),
                    out)
    schema = T.StructType([T.StructField("country_std", T.StringType()),
                           T.StructField("week_id", T.StringType()),
                           T.StructField("total_events", T.LongType())])
    return files.accepted(files.scan_csv(spark, out, schema))


@query("routed_ingest", with_cte(ANNUAL) + """SELECT 'wb' AS data_set, COUNT(*) AS rows FROM annual
 UNION ALL SELECT 'vdem', COUNT(*) FROM annual
 UNION ALL SELECT 'other_table', COUNT(*) FROM annual""")
def routed_ingest(spark, sf):
    base, a = scratch(spark, "ingest"), annual_sources(spark, sf)
    extracts = {"World_Bank_extract": ["country_std", "year", "GDP_Growth", "Inflation"],
                "V-Dem_core": ["country_std", "year", "v2x_libdem"],
                "other_table": ["country_std", "year", "rows"]}
    for name, keep in extracts.items():
        files.write_csv(a.select(*keep), f"{base}/{name}.csv")
    found = files.ingest(spark, [f"{base}/{n}.csv" for n in extracts], f"{base}/out")
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(n).alias("data_set"), "rows") for n, p in found.items()]
    return files.union_extracts(parts)


def _two_extracts(spark, sf):
    """customer as two folders, each of one file a partition: other column order, a column
    missing, a text cell in a number column, and a quoted line break."""
    base, c = scratch(spark, "extracts"), table(spark, sf, "customer")
    cells = {n: F.col(n).cast("string") for n in ("c_custkey", "c_nationkey", "c_acctbal")}
    segment = F.when(F.col("c_custkey") % 10 == 6, F.concat(F.lit('"'), F.col("c_mktsegment"),
                                                            F.lit('\nend"'))) \
        .otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_custkey") % 10 == 5, F.lit("n/a")).otherwise(cells["c_acctbal"])
    even, odd = c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1")
    for name, df, head, line in (
            ("even", even, "c_mktsegment,c_custkey,c_nationkey",
             F.concat_ws(",", segment, cells["c_custkey"], cells["c_nationkey"])),
            ("odd", odd, "c_custkey,c_acctbal,c_mktsegment,c_nationkey",
             F.concat_ws(",", cells["c_custkey"], balance, segment, cells["c_nationkey"]))):
        # the first row of each partition, and so of each file, has the header before it
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        df.select(F.when(at == 0, F.concat(F.lit(head + "\n"), line)).otherwise(line)
                  .alias("value")).write.text(f"{base}/{name}")
    return [f"{base}/even", f"{base}/odd"]


def _read_extracts(spark, sf, multi_line):
    return files.union_extracts([files.scan_csv(spark, p, CUSTOMER_CSV, multi_line=multi_line)
                                 for p in _two_extracts(spark, sf)])


EXTRACT_ROWS = """SELECT c_custkey, c_nationkey,
 CASE WHEN c_custkey % 2 = 1 THEN c_acctbal::DOUBLE END AS c_acctbal,
 CASE WHEN c_custkey % 10 = 6 THEN c_mktsegment || chr(10) || 'end' ELSE c_mktsegment END
 AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 5"""


@query("csv_by_header", EXTRACT_ROWS + " AND c_custkey % 10 <> 6")
def csv_by_header(spark, sf):
    return files.accepted(_read_extracts(spark, sf, False))


@query("csv_by_header_multi_line", EXTRACT_ROWS)
def csv_by_header_multi_line(spark, sf):
    return files.accepted(_read_extracts(spark, sf, True))


@query("csv_reject_causes", """SELECT cause AS outcome, COUNT(*) AS rows FROM (SELECT
 unnest(CASE WHEN c_custkey % 10 = 6 THEN ['open quote', 'open quote']
 WHEN c_custkey % 10 = 5 THEN ['bad c_acctbal'] ELSE ['accepted'] END) AS cause
 FROM customer) GROUP BY 1""")
def csv_reject_causes(spark, sf):
    return files.rejected_counts(_read_extracts(spark, sf, False))


@query("file_routing", """SELECT doc_id, CASE lang WHEN 'en' THEN 'qog' WHEN 'fr' THEN 'vdem'
 WHEN 'de' THEN 'gdelt' ELSE source || '_extract' END AS data_set FROM documents""")
def file_routing(spark, sf):
    """Each document's source and language make a file name that is then routed."""
    lang = F.col("lang")
    word = (F.when(lang == "en", "_QoG.csv").when(lang == "fr", "_V-Dem.csv")
            .when(lang == "de", "_GDELT.csv").otherwise("_extract.csv"))
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    return d.select("doc_id", files.data_set_column(F.concat("source", word)).alias("data_set"))


@query("ingest_validation", with_cte(ANNUAL) + """SELECT COUNT(*) AS rows, 13 AS columns,
 COUNT(DISTINCT country_std) AS entities, CAST(MIN(year) AS VARCHAR) AS period_min,
 CAST(MAX(year) AS VARCHAR) AS period_max, 'al_ethnic2000' AS missing FROM annual""")
def ingest_validation(spark, sf):
    return files.validate(annual_sources(spark, sf), "qog")


@query("conversion_stats")
def conversion_stats(spark, sf):
    base = scratch(spark, "convert")
    files.write_csv(weekly_counts(spark, sf), f"{base}/weekly.csv")
    done = files.ingest(spark, [f"{base}/weekly.csv"], base)
    return files.conversion_stats(spark, f"{base}/weekly.csv", done["weekly"])


@query("conversion_facts", with_cte(COUNTS) + """SELECT COUNT(*) AS rows, TRUE AS written,
 TRUE AS read FROM counts""")
def conversion_facts(spark, sf):
    stats = conversion_stats(spark, sf)
    return stats.select("rows", (F.col("bytes_out") > 0).alias("written"),
                        (F.col("bytes_in") > 0).alias("read"))


@query("extract_union", """SELECT l_orderkey, l_linenumber,
 CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS l_quantity,
 CASE WHEN l_returnflag <> 'A' THEN l_discount END AS l_discount
 FROM lineitem""")
def extract_union(spark, sf):
    line = table(spark, sf, "lineitem")
    def part(flag, *keep):
        return line.filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber",
                                                                 *keep)
    return files.union_extracts([part("R", "l_quantity", "l_discount"), None,
                                 part("A", "l_quantity"), part("N", "l_discount")])


@query("source_registry", """SELECT 'orders' AS source, COUNT(*) AS rows FROM orders
 UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
 UNION ALL SELECT 'not_there', CAST(NULL AS BIGINT)""")
def source_registry(spark, sf):
    s = Sources(spark, sf, ["orders", "lineitem", "not_there"], required=["orders"])
    rows = [(spark.range(1) if df is None else df).agg(
        (F.lit(None).cast("long") if df is None else F.count(F.lit(1))).alias("rows"))
        .select(F.lit(k).alias("source"), "rows") for k, df in s.frames.items()]
    return files.union_extracts(rows)


@query("report_sink", with_cte(ANNUAL) + """SELECT 'annual' AS name, COUNT(*) AS rows,
 CAST(MIN(year) AS BIGINT) AS first, CAST(MAX(year) AS BIGINT) AS last FROM annual""")
def report_sink(spark, sf):
    out = scratch(spark, "report")
    files.write_report(annual_sources(spark, sf).agg(
        F.lit("annual").alias("name"), F.struct(
            F.count(F.lit(1)).alias("rows"), F.min("year").alias("first"),
            F.max("year").alias("last")).alias("summary")), out)
    return spark.read.json(out).select("name", "summary.rows", "summary.first", "summary.last")


@query("standard_names", """SELECT o_orderkey AS key,
 CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def standard_names(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" Key "),
                                          F.year("o_orderdate").alias("YR"))
    return cols.standardise_names(o)


@query("profile_slimming", with_cte(EVENTS) + """SELECT CAST(year(event_date) AS INTEGER) AS year,
 country_std, "group", CAST(1 AS INTEGER) AS type_of_violence, fatalities AS best,
 CAST(event_date AS VARCHAR) AS date_start FROM nation_events""")
def profile_slimming(spark, sf):
    e = nation_events(spark, sf).select(
        "country_std", "group", "lat", "lon", "event_key", F.year("event_date").alias("year"),
        F.lit(1).alias("type_of_violence"), F.col("fatalities").alias("best"),
        F.col("event_date").cast("string").alias("date_start"))
    assert cols.detect_profile(e) == "UCDP"
    return cols.keep_profile(e)


@query("candidate_column", "SELECT c_custkey, c_mktsegment AS picked FROM customer")
def candidate_column(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("NATION"))
    return c.select("c_custkey", F.col(cols.entity_column(c)).alias("picked"))


@query("renamed_columns", """SELECT l_orderkey, l_linenumber, l_quantity AS refugee_outflow
 FROM lineitem""")
def renamed_columns(spark, sf):
    raw = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                              F.col("l_quantity").alias("refugees"))
    return cols.rename_present(raw, {"refugees": "refugee_outflow", "idps": "idp_count"})


@query("optional_column", """SELECT c_custkey, c_acctbal AS a, CAST(0.0 AS DOUBLE) AS b
 FROM customer""")
def optional_column(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", cols.col_or_default(c, "c_acctbal").alias("a"),
                    cols.col_or_default(c, "nope").alias("b"))


@query("dropped_columns", "SELECT p_partkey, p_size FROM part")
def dropped_columns(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_brand", "p_type", "p_retailprice",
                                         "e_pt_coup")


@query("period_filter", """SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year
 FROM orders WHERE o_orderkey % 7 <> 3 AND year(o_orderdate) BETWEEN 1996 AND 1999""")
def period_filter(spark, sf):
    return cols.in_period(_texty_years(spark, sf), "year", 1996, 1999)


def _texty_years(spark, sf):
    y = F.year("o_orderdate").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 7 == 3, F.lit("n.d.")).otherwise(y).alias("year"))


@query("period_report", """SELECT
 COUNT(*) FILTER (o_orderkey % 7 <> 3 AND year(o_orderdate) >= 1997) AS kept,
 COUNT(*) FILTER (o_orderkey % 7 <> 3 AND year(o_orderdate) < 1997) AS outside,
 COUNT(*) FILTER (o_orderkey % 7 = 3) AS unreadable FROM orders""")
def period_report(spark, sf):
    return quality.period_report(_texty_years(spark, sf), "year", 1997)


@query("numeric_coercion", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0
 ELSE greatest(c_acctbal, 0.0) END AS amount FROM customer""")
def numeric_coercion(spark, sf):
    c = table(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("-")).otherwise(
        F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", fn.non_negative(text).alias("amount"))


@query("numeric_features", """SELECT s_suppkey, s_acctbal FROM supplier""")
def numeric_features(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(*cols.numeric_features(s, ["s_nationkey"]))


@query("null_key_drop", "SELECT event_id, user_id FROM events WHERE user_id % 6 <> 0")
def null_key_drop(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id")
    gappy = e.withColumn("user_id", F.when(F.col("user_id") % 6 != 0, F.col("user_id")))
    return gappy.dropna(subset=["user_id"])


@query("year_derivation", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS from_date,
 CAST(isoyear(o_orderdate) AS INTEGER) AS from_week, CAST(year(o_orderdate) AS INTEGER)
 AS from_number FROM orders""")
def year_derivation(spark, sf):
    d = F.to_date("o_orderdate")
    o = table(spark, sf, "orders")
    week = fn.week_label(fn.iso_year(d), fn.iso_week(d))
    return o.select("o_orderkey", F.year(d).alias("from_date"),
                    fn.year_of_text(week).alias("from_week"),
                    fn.year_of_text(F.date_format(d, "yyyyMMdd").cast("int"))
                    .alias("from_number"))


@query("week_parsing", """SELECT o_orderkey, CAST(isoyear(o_orderdate) AS INTEGER) AS year,
 CAST(week(o_orderdate) AS INTEGER) AS week_num, CAST(isoyear(o_orderdate) AS VARCHAR) || '-' ||
 lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week_id FROM orders""")
def week_parsing(spark, sf):
    """Three spellings in one column: dates, YYYY-WW and YYYY-Www."""
    d = F.to_date("o_orderdate")
    label = fn.week_label(fn.iso_year(d), fn.iso_week(d))
    text = (F.when(F.col("o_orderkey") % 3 == 0, d.cast("string"))
            .when(F.col("o_orderkey") % 3 == 1, label)
            .otherwise(F.regexp_replace(label, "-", "-W")))
    o = table(spark, sf, "orders").select("o_orderkey", text.alias("WEEK"))
    return cols.with_week(o).drop("WEEK")


@query("entity_extract", with_cte(EVENTS) + """SELECT event_date, event_type, fatalities,
 event_key FROM nation_events WHERE country_std = 'NATION_7'
 ORDER BY event_date, event_key LIMIT 100""")
def entity_extract(spark, sf):
    return entities.entity_events(nation_events(spark, sf), "NATION_7", columns=[
        "event_date", "event_type", "fatalities", "event_key"],
        order=["event_date", "event_key"], top=100)


@query("entity_extract_count", with_cte(EVENTS) + """SELECT COUNT(*) AS rows FROM nation_events
 WHERE country_std = 'NATION_7'""")
def entity_extract_count(spark, sf):
    return entities.entity_events(nation_events(spark, sf), "NATION_7").agg(
        F.count(F.lit(1)).alias("rows"))


@query("entity_series", with_cte(ANNUAL) + f"""SELECT year, {r('v2x_libdem', 'v2x_libdem')}
 FROM annual WHERE country_std = 'NATION_3'""")
def entity_series(spark, sf):
    return rounded(entities.entity_events(annual_sources(spark, sf), "NATION_3",
                                          columns=["year", "v2x_libdem"]).orderBy("year"))


@query("valid_coordinates", """SELECT c_custkey FROM customer
 WHERE c_custkey % 9 <> 0 AND c_nationkey <> 0""")
def valid_coordinates(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 9).cast("double").alias("lat"),
        F.col("c_nationkey").cast("double").alias("lon"))
    return quality.valid_coordinates(c, "lat", "lon").select("c_custkey")


@query("log_counts", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL
 ELSE ROUND(ln(1 + l_quantity), 6) END AS articles FROM lineitem""")
def log_counts(spark, sf):
    from panelrisk.operators.rollups import log_counts as op
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(
        F.col("l_linenumber") == 2, F.lit("?")).otherwise(F.col("l_quantity").cast("string"))
        .alias("articles"))
    return rounded(op(line, "articles"))


@query("log_count_errors", """SELECT 'articles' AS variable,
 COUNT(*) FILTER (l_linenumber = 2) AS rows FROM lineitem""")
def log_count_errors(spark, sf):
    line = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 2, F.lit("?"))
                                               .otherwise(F.col("l_quantity").cast("string"))
                                               .alias("articles"))
    return quality.unreadable(line, ["articles"])


@query("target_weeks", """SELECT o_orderkey, strftime(CAST(date_trunc('week', o_orderdate) AS DATE)
 + 91, '%Y-%m-%d') AS target_week_end FROM orders""")
def target_weeks(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", fn.target_week(
        fn.week_label(fn.iso_year(d), fn.iso_week(d))).alias("target_week_end"))


@query("guarded_arithmetic", f"""SELECT l_orderkey, l_linenumber,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE greatest(5.0, least(30.0, l_quantity)) END::DOUBLE
 AS clipped, {r('CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END', 'ratio')},
 {r('(l_discount - l_tax) / (abs(l_tax) + 1e-8)', 'gap')} FROM lineitem""")
def guarded_arithmetic(spark, sf):
    line = table(spark, sf, "lineitem")
    x = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    return rounded(line.select("l_orderkey", "l_linenumber",
                               fn.clip(x, 5.0, 30.0).alias("clipped"),
                               fn.safe_div("l_discount", "l_tax").alias("ratio"),
                               fn.relative_gap("l_discount", "l_tax").alias("gap")))


@query("distinct_calendar", with_cte(EVENTS) + """SELECT DISTINCT
 CAST(isoyear(event_date) AS INTEGER) AS year, CAST(week(event_date) AS INTEGER) AS week_num
 FROM nation_events""")
def distinct_calendar(spark, sf):
    return cols.with_week(nation_events(spark, sf), "event_date").select("year", "week_num") \
        .distinct()


@query("missing_columns", with_cte(SHIPMENTS) + """SELECT COUNT(*) AS rows,
 'SQLDATE,AvgTone' AS missing FROM shipments""")
def missing_columns(spark, sf):
    s = shipments(spark, sf)
    absent = files.missing_columns(s, ["SQLDATE", "l_tax", "AvgTone"])
    return s.agg(F.count(F.lit(1)).alias("rows"), F.lit(",".join(absent)).alias("missing"))


@query("first_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
 WHERE i = 1""")
def first_per_key(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
