"""Panel joins, completion, fills, neighbours and series columns."""

from pyspark.sql import functions as F

from panelrisk.functions import columns as cols
from panelrisk.operators import neighbors, normalize, panel, rolling
from panelrisk.session import pin
from panelrisk.workload.base import (ANNUAL, COUNTS, EVENTS, PLACES, USER_DAYS, WEEKLY,
                                     annual_sources, edges, places, query, r, rounded, table,
                                     user_days, weekly, weekly_counts, with_cte, z_sql, zs_sql)

GRID = COUNTS + """, cal AS (SELECT DISTINCT week_id, year, week_num FROM counts),
 ents AS (SELECT country_std, MIN("group") AS "group" FROM counts GROUP BY 1),
 grid AS (SELECT e.country_std, e."group", c.week_id, c.year, c.week_num, f.total_events,
 f.weekly_fatalities, f.battle_count FROM ents e CROSS JOIN cal c
 LEFT JOIN counts f ON f.country_std = e.country_std AND f.week_id = c.week_id)"""


def _grid(spark, sf):
    """The rollup is written once: facts, tiers and calendar all read it."""
    keep = ["total_events", "weekly_fatalities", "battle_count"]
    w = weekly_counts(spark, sf).select("country_std", "group", "week_id", "year", "week_num",
                                        *keep)
    return panel.dense_grid(pin(w))


ZERO_GRID = GRID + """, zgrid AS (SELECT country_std, week_id, year, week_num,
 CAST(COALESCE(weekly_fatalities, 0) AS DOUBLE) AS fatalities,
 CAST(COALESCE(total_events, 0) AS DOUBLE) AS events FROM grid)"""


def _zero_grid(spark, sf):
    g = _grid(spark, sf).select("country_std", "week_id", "year", "week_num",
                                F.col("weekly_fatalities").alias("fatalities"),
                                F.col("total_events").alias("events"))
    return panel.fill_constant(g, ["fatalities", "events"], 0).withColumns(
        {"fatalities": F.col("fatalities").cast("double"),
         "events": F.col("events").cast("double")})


@query("dense_grid", with_cte(GRID) + "SELECT * FROM grid")
def dense_grid(spark, sf):
    return _grid(spark, sf)


@query("zero_filled_grid", with_cte(ZERO_GRID) + "SELECT * FROM zgrid")
def zero_filled_grid(spark, sf):
    return _zero_grid(spark, sf)


@query("annual_star_join", with_cte(EVENTS, ANNUAL[len(PLACES) + 2:]) + f""", spine AS (SELECT
 country_std, CAST(year(event_date) AS INTEGER) AS year, COUNT(*) AS event_count
 FROM nation_events GROUP BY 1, 2) SELECT s.country_std, s.year, s.event_count,
 {r('a.v2x_libdem', 'v2x_libdem')}, {r('b.Inflation', 'Inflation')}, b.idps FROM spine s
 LEFT JOIN annual a USING (country_std, year) LEFT JOIN annual b USING (country_std, year)""")
def annual_star_join(spark, sf):
    from panelrisk.workload.rollup_queries import named_annual
    spine = named_annual(spark, sf).select("country_std", "year", "event_count")
    a = annual_sources(spark, sf)
    return rounded(panel.left_star(spine, [a.select("country_std", "year", "v2x_libdem"), None,
                                           a.select("country_std", "year", "Inflation", "idps")]))


STATIC = PLACES + """, static AS (SELECT country_std, ROUND(AVG(s_acctbal), 6) AS al_ethnic2000
 FROM supplier JOIN places ON s_nationkey = n_nationkey GROUP BY 1)"""


def static_attribute(spark, sf):
    """One value per entity, repeated for two years as the source does."""
    s = table(spark, sf, "supplier").join(places(spark, sf),
                                          F.col("s_nationkey") == F.col("n_nationkey"))
    one = s.groupBy("country_std").agg(F.round(F.avg("s_acctbal"), 6).alias("al_ethnic2000"))
    return one.withColumn("year", F.explode(F.array(F.lit(1999), F.lit(2000))))


@query("static_attribute_join", with_cte(COUNTS, STATIC[len(PLACES) + 2:]) + f"""SELECT
 c.country_std, c.week_id, {r('s.al_ethnic2000', 'al_ethnic2000')} FROM counts c
 LEFT JOIN static s USING (country_std)""")
def static_attribute_join(spark, sf):
    return rounded(panel.join_static(weekly_counts(spark, sf), static_attribute(spark, sf),
                                     ["al_ethnic2000"]).select("country_std", "week_id",
                                                               "al_ethnic2000"))


@query("absent_source", with_cte(ANNUAL) + """SELECT country_std, year,
 CAST(0.0 AS DOUBLE) AS FoodShock_z FROM annual""")
def absent_source(spark, sf):
    a = panel.left_star(annual_sources(spark, sf), [None])
    return a.select("country_std", "year", cols.col_or_default(a, "FoodShock_z")
                    .alias("FoodShock_z"))


@query("annual_to_weekly_join", with_cte(COUNTS, ANNUAL[len(PLACES) + 2:]) + f"""SELECT
 c.country_std, c.week_id, {r('a.v2x_corr', 'v2x_corr')} FROM counts c
 LEFT JOIN annual a ON a.country_std = c.country_std AND a.year = c.year""")
def annual_to_weekly_join(spark, sf):
    return rounded(panel.join_annual(weekly_counts(spark, sf), annual_sources(spark, sf),
                                     ["v2x_corr"]).select("country_std", "week_id", "v2x_corr"))


@query("replaced_columns", with_cte(WEEKLY) + f""", z AS (SELECT *, {z_sql('CII_roll90')}
 AS Z_CII_90d FROM weekly) SELECT country_std, week_id, total_events,
 {r('Z_CII_90d', 'Z_CII_90d')} FROM z""")
def replaced_columns(spark, sf):
    w = weekly(spark, sf)
    z = normalize.zscores(w, ["CII_roll90"]).withColumnRenamed("CII_roll90_z", "Z_CII_90d")
    stale = w.withColumn("Z_CII_90d", F.lit(-1.0))
    return rounded(panel.replace_columns(stale, z, ["Z_CII_90d"])
                   .select("country_std", "week_id", "total_events", "Z_CII_90d"))


@query("neighbour_spillover", with_cte(WEEKLY) + f"""SELECT country_std, week_id,
 {r('spillover', 'spillover')} FROM weekly""")
def neighbour_spillover(spark, sf):
    w = weekly_counts(spark, sf).withColumn("CII", F.col("weekly_fatalities").cast("double"))
    return rounded(neighbors.spillover(w, edges(spark, sf))
                   .select("country_std", "week_id", "spillover"))


Z_ANNUAL = WEEKLY + f""", z AS (SELECT *, {zs_sql(['CII_roll90'])} FROM weekly),
 az AS (SELECT country_std, year, "group", ROUND(AVG(CII_roll90_z), 6) AS Z_CII_90d
 FROM z GROUP BY 1, 2, 3)"""


@query("region_share", with_cte(Z_ANNUAL) + f"""SELECT a.country_std, a.year, (SELECT
 {r('''COALESCE(ROUND(AVG(CASE WHEN b.Z_CII_90d > 0.1 THEN 1.0 ELSE 0.0 END), 6), 0.0)''', 'x')
  .rsplit(' AS ', 1)[0]} FROM az b WHERE b."group" = a."group" AND b.year = a.year
 AND b.country_std <> a.country_std) AS regcluster FROM az a""")
def region_share(spark, sf):
    z = normalize.zscores(weekly(spark, sf), ["CII_roll90"])
    a = z.groupBy("country_std", "year").agg(F.round(F.avg("CII_roll90_z"), 6)
                                             .alias("Z_CII_90d"))
    regions = places(spark, sf).select(F.col("country_std").alias("canonical"),
                                       F.col("group").alias("region"))
    return rounded(neighbors.region_share(a, regions=regions, threshold=0.1)
                   .select("country_std", "year", "regcluster"))


@query("tier_share", with_cte(WEEKLY) + f""", z AS (SELECT *, {zs_sql(['CII'])} FROM weekly),
 s AS (SELECT "group", week_id, AVG(CASE WHEN CII_z > 1.5 THEN 1.0 ELSE 0.0 END) AS share
 FROM z GROUP BY 1, 2) SELECT z.country_std, z.week_id, {r('s.share', 'regcluster')}
 FROM z JOIN s ON s."group" = z."group" AND s.week_id = z.week_id""")
def tier_share(spark, sf):
    z = normalize.zscores(weekly(spark, sf), ["CII"])
    return rounded(neighbors.tier_share(z, z="CII_z").select("country_std", "week_id",
                                                              "regcluster"))


SIGNAL_GRID = USER_DAYS + """, cal AS (SELECT DISTINCT day FROM user_days),
 who AS (SELECT DISTINCT country_std FROM user_days),
 sg AS (SELECT w.country_std, c.day, d.signal FROM who w CROSS JOIN cal c
 LEFT JOIN user_days d ON d.country_std = w.country_std AND d.day = c.day)"""


def _signal_grid(spark, sf):
    d = user_days(spark, sf).select("country_std", "day", "signal",
                                    F.lit("OTHER").alias("group"))
    return panel.dense_grid(pin(d), period=["day"], order=["day"]).drop("group")


_LAST = """last_value(signal IGNORE NULLS) OVER (PARTITION BY country_std ORDER BY day
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_NEXT = """first_value(signal IGNORE NULLS) OVER (PARTITION BY country_std ORDER BY day
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("forward_fill", with_cte(SIGNAL_GRID) + f"""SELECT country_std, day,
 COALESCE({_LAST}, 1.0) AS signal FROM sg""")
def forward_fill(spark, sf):
    return panel.fill_forward(_signal_grid(spark, sf), ["signal"], 1.0, order=["day"])


@query("two_way_fill", with_cte(SIGNAL_GRID) + f"""SELECT country_std, day,
 COALESCE({_LAST}, {_NEXT}) AS signal FROM sg""")
def two_way_fill(spark, sf):
    return panel.fill_both_ways(_signal_grid(spark, sf), ["signal"], order=["day"])


_W = "PARTITION BY country_std ORDER BY year, week_num"


@query("moving_means", with_cte(ZERO_GRID) + f"""SELECT country_std, week_id,
 {r(f'AVG(fatalities) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 'ma4')},
 {r(f'AVG(fatalities) OVER ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)', 'ma12')}
 FROM zgrid""")
def moving_means(spark, sf):
    return rounded(rolling.rolling_means(_zero_grid(spark, sf), {
        "ma4": ("fatalities", 4), "ma12": ("fatalities", 12)})
        .select("country_std", "week_id", "ma4", "ma12"))


BASELINE = ZERO_GRID + f""", b AS (SELECT *, row_number() OVER ({_W}) AS i,
 AVG(fatalities) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS m,
 stddev_pop(fatalities) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS s FROM zgrid),
 bz AS (SELECT *, CASE WHEN i <= 12 THEN 0.0 ELSE (fatalities - m) / greatest(s, 1.0) END AS z
 FROM b)"""


@query("baseline_z", with_cte(BASELINE) + f"SELECT country_std, week_id, {r('z', 'z')} FROM bz")
def baseline_z(spark, sf):
    return rounded(rolling.baseline_z(_zero_grid(spark, sf), "fatalities")
                   .select("country_std", "week_id", "z"))


@query("escalation_velocity", with_cte(BASELINE) + f""", p AS (SELECT *, lag(z) OVER ({_W})
 AS pz FROM bz) SELECT country_std, week_id,
 {r('CASE WHEN i <= 12 THEN 0.0 ELSE (z - pz) / (abs(pz) + 1.0) END', 'escalation')} FROM p""")
def escalation_velocity(spark, sf):
    z = rolling.baseline_z(_zero_grid(spark, sf), "fatalities")
    return rounded(rolling.velocity(z).select("country_std", "week_id", "escalation"))


CHANGE = EVENTS + """, yearly AS (SELECT country_std, CAST(year(event_date) AS INTEGER) AS year,
 CAST(SUM(fatalities) AS BIGINT) AS total_deaths FROM nation_events GROUP BY 1, 2),
 pct AS (SELECT *, COALESCE((total_deaths - lag(total_deaths) OVER w) /
 NULLIF(CAST(lag(total_deaths) OVER w AS DOUBLE), 0), 0.0) AS pct_change FROM yearly
 WINDOW w AS (PARTITION BY country_std ORDER BY year))"""


def _pct(spark, sf):
    from panelrisk.workload.rollup_queries import named_annual
    return rolling.relative_change(named_annual(spark, sf).select("country_std", "year",
                                                                  "total_deaths"),
                                   "total_deaths")


@query("relative_change", with_cte(CHANGE) + f"""SELECT country_std, year,
 {r('pct_change', 'pct_change')} FROM pct""")
def relative_change(spark, sf):
    return rounded(_pct(spark, sf).drop("total_deaths"))


@query("change_z", with_cte(CHANGE) + f"""SELECT country_std, year,
 {r(z_sql('pct_change'), 'esc_z')}, {r('''(pct_change - AVG(pct_change) OVER (PARTITION BY
 country_std)) / (stddev_pop(pct_change) OVER (PARTITION BY country_std) + 1e-8)''',
 'esc_literal')} FROM pct""")
def change_z(spark, sf):
    z = rolling.change_z(_pct(spark, sf))
    return rounded(rolling.change_z(z, out="esc_literal", guard=False)
                   .drop("total_deaths", "pct_change"))


@query("lagged_counts", with_cte(ZERO_GRID) + f"""SELECT country_std, week_id,
 COALESCE(lag(events, 4) OVER ({_W}), 0.0) AS lag4,
 COALESCE(lag(events, 8) OVER ({_W}), 0.0) AS lag8 FROM zgrid""")
def lagged_counts(spark, sf):
    return rolling.lags(_zero_grid(spark, sf), "events", {"lag4": 4, "lag8": 8}) \
        .select("country_std", "week_id", "lag4", "lag8")


@query("trend_and_acceleration", with_cte(ZERO_GRID) + f""", m AS (SELECT *,
 AVG(fatalities) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) -
 AVG(fatalities) OVER ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS trend FROM zgrid)
 SELECT country_std, week_id, {r('trend', 'trend')},
 {r(f'COALESCE(trend - lag(trend) OVER ({_W}), 0.0)', 'accel')} FROM m""")
def trend_and_acceleration(spark, sf):
    m = rolling.rolling_means(_zero_grid(spark, sf), {"s": ("fatalities", 4),
                                                      "l": ("fatalities", 12)})
    return rounded(rolling.trend_and_acceleration(m, "s", "l", "trend", "accel")
                   .select("country_std", "week_id", "trend", "accel"))


@query("row_escalation", with_cte(WEEKLY) + f""", z AS (SELECT *,
 {zs_sql(['CII_roll7', 'CII_roll90'])} FROM weekly) SELECT country_std, week_id,
 {r('''greatest(-8.0, least(8.0, (CII_roll7_z - CII_roll90_z) / (abs(CII_roll90_z) + 1e-8)))''',
    'esc', 3)} FROM z""")
def row_escalation(spark, sf):
    z = normalize.zscores(weekly(spark, sf), ["CII_roll7", "CII_roll90"])
    return rounded(z.select("country_std", "week_id", rolling.escalation(
        "CII_roll7_z", "CII_roll90_z").alias("esc")), 3)


@query("fallback_z", with_cte(WEEKLY) + f""", s AS (SELECT *,
 COALESCE(stddev_samp(CII_roll90) OVER (PARTITION BY country_std), 0.0) AS sd,
 AVG(CII_roll90) OVER (PARTITION BY country_std) AS mu FROM weekly)
 SELECT country_std, week_id, {r('''CASE WHEN sd < 1e-6 THEN 0.0 ELSE
 greatest(-8.0, least(8.0, (CII_roll90 - mu) / sd)) END''', 'Z_CII_90d')}, {r(z_sql(
 'CII_roll90'), 'kept')} FROM s""")
def fallback_z(spark, sf):
    """All-zero column replaced, live column kept."""
    w = normalize.zscores(weekly(spark, sf), ["CII_roll90"])
    w = w.withColumns({"Z_CII_90d": F.lit(0.0), "kept": F.col("CII_roll90_z")})
    w = normalize.ensure_z(normalize.ensure_z(w, "CII_roll90", "Z_CII_90d"), "CII_roll90", "kept")
    return rounded(w.select("country_std", "week_id", "Z_CII_90d", "kept"))


LABELLED = EVENTS + """, yearly AS (SELECT country_std, CAST(year(event_date) AS INTEGER) AS year,
 AVG(fatalities) AS m FROM nation_events GROUP BY 1, 2), act AS (SELECT *,
 CASE WHEN m > 235 THEN 1 ELSE 0 END AS is_active_conflict FROM yearly)"""


@query("onset_label_annual", with_cte(LABELLED) + """, f AS (SELECT *, lead(is_active_conflict)
 OVER (PARTITION BY country_std ORDER BY year) AS nxt FROM act) SELECT country_std, year,
 is_active_conflict, CASE WHEN is_active_conflict = 0 AND nxt = 1 THEN 1 ELSE 0 END AS Y
 FROM f WHERE nxt IS NOT NULL""")
def onset_label_annual(spark, sf):
    from panelrisk.workload.base import nation_events
    y = nation_events(spark, sf).groupBy("country_std", F.year("event_date").alias("year")) \
        .agg(F.avg("fatalities").alias("WRI"))
    time, steps = cols.time_axis(y)
    return rolling.onset_labels(y, steps, threshold=235, order=(time,)).drop("WRI")


WEEK_LABELS = ZERO_GRID + f""", act AS (SELECT *, CASE WHEN fatalities > 600 THEN 1 ELSE 0 END
 AS is_active_conflict FROM zgrid), f AS (SELECT *, lead(is_active_conflict, 13) OVER ({_W})
 AS nxt FROM act), lab AS (SELECT country_std, week_id, year, week_num, fatalities, events,
 is_active_conflict,
 CASE WHEN is_active_conflict = 0 AND nxt = 1 THEN 1 ELSE 0 END AS Y FROM f
 WHERE nxt IS NOT NULL)"""


def labelled_weeks(spark, sf):
    g = _zero_grid(spark, sf).withColumn("is_active_conflict",
                                         (F.col("fatalities") > 600).cast("int"))
    return rolling.onset_labels(g, 13, order=("year", "week_num"))


@query("onset_label_weekly", with_cte(WEEK_LABELS) + """SELECT country_std, week_id,
 is_active_conflict, Y FROM lab""")
def onset_label_weekly(spark, sf):
    return labelled_weeks(spark, sf).select("country_std", "week_id", "is_active_conflict", "Y")


@query("neighbour_inflow", with_cte(WEEKLY) + f"""SELECT e.src, e.dst,
 {r('SUM(w.CII / (sqrt(e.dist) + 1))', 'inflow')} FROM weekly w
 JOIN edges e ON e.dst = w.country_std GROUP BY 1, 2""")
def neighbour_inflow(spark, sf):
    """What each neighbour contributes over all weeks."""
    w = weekly(spark, sf).groupBy(F.col("country_std").alias("dst")).agg(F.sum("CII").alias("v"))
    e = edges(spark, sf)
    return rounded(w.join(e, "dst").select("src", "dst", (F.col("v") / (F.sqrt("dist") + 1))
                                           .alias("inflow")))
