"""Data quality, exploratory statistics and sampling."""

from pyspark.sql import functions as F

from panelrisk.operators import normalize, quality
from panelrisk.workload.base import (EVENTS, SHIPMENTS, USERS, WEEKLY, nation_events, query, r,
                                     rounded, shipments, table, user_events, weekly,
                                     with_cte, zs_sql)

GAPPY = """gappy AS (SELECT l_orderkey, l_linenumber, l_returnflag,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS a,
 CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS b, l_tax AS c FROM lineitem)"""


def _gappy(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_returnflag",
                       F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("a"),
                       F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).alias("b"),
                       F.col("l_tax").alias("c"))


@query("missing_matrix", with_cte(GAPPY) + """, m AS (SELECT l_returnflag,
 COUNT(*) - COUNT(a) AS a, COUNT(*) - COUNT(b) AS b, COUNT(*) - COUNT(c) AS c FROM gappy
 GROUP BY 1) SELECT l_returnflag, 'a' AS variable, a AS missing FROM m UNION ALL
 SELECT l_returnflag, 'b', b FROM m UNION ALL SELECT l_returnflag, 'c', c FROM m""")
def missing_matrix(spark, sf):
    return quality.missing_matrix(_gappy(spark, sf), ["a", "b", "c"], "l_returnflag")


@query("missing_ranking", with_cte(GAPPY) + """SELECT variable, missing, ROUND(missing * 100.0 / n,
 2)::DOUBLE AS percent FROM (SELECT 'a' AS variable, COUNT(*) - COUNT(a) AS missing,
 COUNT(*) AS n FROM gappy UNION ALL SELECT 'b', COUNT(*) - COUNT(b), COUNT(*) FROM gappy)""")
def missing_ranking(spark, sf):
    return quality.missing_ranking(_gappy(spark, sf), top=20)


@query("constant_imputation", with_cte(GAPPY) + """SELECT l_orderkey, l_linenumber,
 COALESCE(a, 0.0)::DOUBLE AS a, CAST(a IS NULL AS INTEGER) AS filled FROM gappy""")
def constant_imputation(spark, sf):
    return quality.impute(_gappy(spark, sf), "a", 0.0, "filled") \
        .select("l_orderkey", "l_linenumber", "a", "filled")


@query("column_profile", with_cte(GAPPY) + """SELECT 'a' AS variable, 'double' AS type,
 ROUND(COUNT(a) * 100.0 / COUNT(*), 2)::DOUBLE AS filled_percent, COUNT(DISTINCT a)
 AS distinct_values FROM gappy UNION ALL SELECT 'b', 'double',
 ROUND(COUNT(b) * 100.0 / COUNT(*), 2)::DOUBLE, COUNT(DISTINCT b) FROM gappy UNION ALL
 SELECT 'l_returnflag', 'string', 100.0, COUNT(DISTINCT l_returnflag) FROM gappy""")
def column_profile(spark, sf):
    return quality.column_profile(_gappy(spark, sf), ["a", "b", "l_returnflag"])


@query("iqr_outliers", f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a,
 quantile_cont(o_totalprice, 0.75) AS b FROM orders), f AS (SELECT a - 0.25 * (b - a) AS low,
 b + 0.25 * (b - a) AS high FROM q) SELECT 'o_totalprice' AS variable, {r('low', 'low')},
 {r('high', 'high')}, COUNT(*) FILTER (o_totalprice < low OR o_totalprice > high)
 AS outliers, {r('AVG(CASE WHEN o_totalprice < low OR o_totalprice > high THEN 1.0 ELSE 0.0 END) * 100',
                 'percent')} FROM orders CROSS JOIN f GROUP BY low, high""")
def iqr_outliers(spark, sf):
    return rounded(quality.iqr_outliers(table(spark, sf, "orders"), ["o_totalprice"], 0.25))


@query("iqr_outliers_by_key", f"""WITH f AS (SELECT event_type,
 quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
 AS low, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) -
 quantile_cont(value, 0.25)) AS high FROM events GROUP BY 1)
 SELECT event_type, 'value' AS variable, {r('low', 'low')}, {r('high', 'high')},
 COUNT(*) FILTER (value < low OR value > high) AS outliers,
 {r('AVG(CASE WHEN value < low OR value > high THEN 1.0 ELSE 0.0 END) * 100', 'percent')}
 FROM events JOIN f USING (event_type) GROUP BY event_type, low, high""")
def iqr_outliers_by_key(spark, sf):
    return rounded(quality.iqr_outliers(table(spark, sf, "events"), ["value"], 1.5,
                                        ["event_type"]))


MAD = """m AS (SELECT median(value) AS med FROM events), d AS (SELECT event_id, value,
 abs(value - med) AS away, med FROM events CROSS JOIN m), s AS (SELECT median(away) * 1.4826
 AS mad FROM d)"""


@query("mad_outliers", with_cte(MAD) + f"""SELECT COUNT(*) AS n, {r('MAX(med)', 'median')},
 {r('MAX(mad)', 'scaled_mad')}, {r('MAX(med) - 3 * MAX(mad)', 'low')},
 {r('MAX(med) + 3 * MAX(mad)', 'high')}, COUNT(*) FILTER (away / mad > 3) AS outliers,
 {r('COUNT(*) FILTER (away / mad > 3) * 100.0 / COUNT(*)', 'percent')}
 FROM d CROSS JOIN s""")
def mad_outliers(spark, sf):
    return rounded(quality.mad_outliers(table(spark, sf, "events"), "value"))


@query("mad_outlier_rows", with_cte(MAD) + f"""SELECT event_id, {r('value', 'value')},
 {r('away / mad', 'score')} FROM d CROSS JOIN s WHERE away / mad > 3 ORDER BY event_id LIMIT 5""")
def mad_outlier_rows(spark, sf):
    e = table(spark, sf, "events", "event_id", "value")
    return rounded(quality.mad_outlier_rows(e, "value", ["event_id"], top=5))


@query("histogram_fixed_range", f"""SELECT b.bin, {r('-10.0 + b.bin + 0.5', 'center')},
 COUNT(x) AS rows FROM range(0, 20) b(bin) LEFT JOIN (SELECT x, least(19,
 CAST(floor((x + 10) / 1.0) AS BIGINT)) AS bin FROM (SELECT ROUND(l_discount * 100 - l_quantity / 3,
 2) AS x FROM lineitem) WHERE x BETWEEN -10 AND 10) v ON v.bin = b.bin GROUP BY 1""")
def histogram_fixed_range(spark, sf):
    x = F.round(F.col("l_discount") * 100 - F.col("l_quantity") / 3, 2)
    line = table(spark, sf, "lineitem").select(x.alias("x"))
    return rounded(quality.histogram(line, "x", 20, -10, 10))


@query("histogram_data_range", f"""WITH e AS (SELECT MIN(value) AS lo, MAX(value) AS hi,
 (MAX(value) - MIN(value)) / 50 AS w FROM events), v AS (SELECT least(49,
 CAST(floor((value - lo) / w) AS BIGINT)) AS bin FROM events CROSS JOIN e)
 SELECT b.bin, {r('lo + b.bin * w + w / 2', 'center')}, COUNT(v.bin) AS rows
 FROM range(0, 50) b(bin) CROSS JOIN e LEFT JOIN v ON v.bin = b.bin GROUP BY b.bin, lo, w""")
def histogram_data_range(spark, sf):
    return rounded(quality.histogram(table(spark, sf, "events"), "value", 50))


def _box_sql(c, by=None):
    q = ", ".join(r(f"quantile_cont({c}, {p})", n) for p, n in
                  ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    return (f"SELECT {by + ', ' if by else ''}'{c}' AS variable, COUNT({c}) AS n, "
            f"{r(f'MIN({c})', 'minimum')}, {q}, {r(f'MAX({c})', 'maximum')}")


@query("box_summary", _box_sql("value") + " FROM events")
def box_summary(spark, sf):
    return rounded(quality.box_summary(table(spark, sf, "events"), ["value"]))


@query("box_summary_by_tier", with_cte(USERS) + _box_sql("value", '"group"')
       + ' FROM user_events GROUP BY "group"')
def box_summary_by_tier(spark, sf):
    return rounded(quality.box_summary(user_events(spark, sf), ["value"], ["group"]))


@query("normalisation_health", with_cte(WEEKLY) + f""", z AS (SELECT *,
 {zs_sql(['CII_roll90', 'spillover'])} FROM weekly), u AS (SELECT country_std,
 'CII_roll90_z' AS variable, CII_roll90_z AS v FROM z UNION ALL SELECT country_std,
 'spillover_z', spillover_z FROM z), p AS (SELECT country_std, variable, MIN(v) AS lo,
 MAX(v) AS hi, AVG(v) AS m, stddev_pop(v) AS s FROM u GROUP BY 1, 2)
 SELECT variable, {r('MIN(lo)', 'z_min')}, {r('MAX(hi)', 'z_max')},
 {r('AVG(abs(m))', 'mean_abs_mu', 4)}, {r('AVG(s) FILTER (s > 0)', 'mean_sigma', 4)},
 'ok' AS status FROM p GROUP BY 1""")
def normalisation_health(spark, sf):
    z = normalize.zscores(weekly(spark, sf), ["CII_roll90", "spillover"])
    return rounded(normalize.health_check(z, ["CII_roll90_z", "spillover_z"]))


@query("mean_centred", f"""WITH c AS (SELECT l_orderkey, l_linenumber,
 l_quantity - (SELECT AVG(l_quantity) FROM lineitem) AS a,
 l_tax - (SELECT AVG(l_tax) FROM lineitem) AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, {r('a', 'l_quantity_centred')}, {r('b', 'l_tax_centred')},
 CASE WHEN a >= 0 AND b >= 0 THEN 1 WHEN a < 0 AND b >= 0 THEN 2 WHEN a < 0 AND b < 0 THEN 3
 ELSE 4 END AS quadrant FROM c""")
def mean_centred(spark, sf):
    line = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(quality.centred(line, ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax"))


@query("category_codes", """WITH f AS (SELECT event_type AS category, row_number() OVER
 (ORDER BY MIN(event_id)) AS code FROM events GROUP BY 1)
 SELECT event_id, category, code FROM events JOIN f ON category = event_type""")
def category_codes(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type")
    return quality.category_codes(e, "event_type", ["event_id"]).select("event_id", "category",
                                                                         "code")


@query("live_counts", """SELECT variable, nonzero, rows FROM (SELECT 'l_discount' AS variable,
 COUNT(*) FILTER (l_discount <> 0) AS nonzero, COUNT(*) AS rows FROM lineitem UNION ALL
 SELECT 'l_tax', COUNT(*) FILTER (l_tax <> 0), COUNT(*) FROM lineitem)""")
def live_counts(spark, sf):
    return quality.live_counts(table(spark, sf, "lineitem"), ["l_discount", "l_tax"])


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 3")
def preview(spark, sf):
    return quality.preview(table(spark, sf, "orders"), 3, ["o_orderkey"])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem"
                           for a, b in _PAIRS)


@query("correlations", f"SELECT a, b, {r('r', 'r')} FROM ({_CORR})")
def correlations(spark, sf):
    return rounded(quality.correlations(table(spark, sf, "lineitem"), _NUM))


_NET = "l_quantity * (1 - l_discount) * (1 + l_tax)"
_STRONG = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({x}, {y}) AS r FROM lineitem"
                             for a, b, x, y in (("l_quantity", "net", "l_quantity", _NET),
                                                ("l_quantity", "l_tax", "l_quantity", "l_tax"),
                                                ("net", "l_tax", _NET, "l_tax")))


@query("strong_correlations", f"""SELECT a, b, {r('r', 'r', 3)} FROM ({_STRONG})
 WHERE abs(r) >= 0.6 ORDER BY abs(r) DESC, a, b""")
def strong_correlations(spark, sf):
    line = table(spark, sf, "lineitem").select("l_quantity", F.expr(_NET).alias("net"), "l_tax")
    return quality.strong_pairs(quality.correlations(line, ["l_quantity", "net", "l_tax"]))


@query("descriptive_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'AVG({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, "
    f"COUNT({c}) AS n, {r(f'MIN({c})', 'minimum')}, "
    + ", ".join(r(f"quantile_cont({c}, {p})", n)
                for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    + f", {r(f'MAX({c})', 'maximum')} FROM lineitem" for c in _NUM))
def descriptive_statistics(spark, sf):
    return rounded(quality.describe(table(spark, sf, "lineitem"), _NUM))


@query("tier_description", with_cte(SHIPMENTS) + f"""SELECT "group", 'l_quantity' AS variable,
 {r('AVG(l_quantity)', 'mean')}, {r('stddev_samp(l_quantity)', 'std')}, COUNT(*) AS n,
 {r('MIN(l_quantity)', 'minimum')}, {r('quantile_cont(l_quantity, 0.25)', 'q1')},
 {r('quantile_cont(l_quantity, 0.5)', 'median')}, {r('quantile_cont(l_quantity, 0.75)', 'q3')},
 {r('MAX(l_quantity)', 'maximum')} FROM shipments GROUP BY 1""")
def tier_description(spark, sf):
    return rounded(quality.describe(shipments(spark, sf), ["l_quantity"], ["group"]))


@query("systematic_sample", """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *,
 row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1
 AS i, COUNT(*) OVER () AS t FROM lineitem) WHERE i % greatest(1, t // 1000) = 0""")
def systematic_sample(spark, sf):
    line = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                 "l_shipdate")
    return quality.systematic_sample(line, ["l_orderkey", "l_linenumber", "l_partkey",
                                            "l_suppkey", "l_shipdate"], 1000) \
        .select("l_orderkey", "l_linenumber", "l_partkey")


@query("capped_sample", """SELECT event_id FROM events ORDER BY
 md5('42:' || CAST(event_id AS VARCHAR)), event_id LIMIT 5000""")
def capped_sample(spark, sf):
    return quality.capped_sample(table(spark, sf, "events", "event_id"), "event_id", 5000)


@query("first_outliers", with_cte(EVENTS, """q AS (SELECT quantile_cont(fatalities, 0.5) AS m
 FROM nation_events), a AS (SELECT quantile_cont(abs(fatalities - m), 0.5) * 1.4826 AS s
 FROM nation_events CROSS JOIN q)""") + f"""SELECT event_key, fatalities,
 {r('abs(fatalities - m) / s', 'score')} FROM nation_events CROSS JOIN q CROSS JOIN a
 WHERE abs(fatalities - m) / s > 1 ORDER BY event_key LIMIT 100""")
def first_outliers(spark, sf):
    e = nation_events(spark, sf).select("event_key", "fatalities")
    return rounded(quality.mad_outlier_rows(e, "fatalities", ["event_key"], top=100, threshold=1.0))
