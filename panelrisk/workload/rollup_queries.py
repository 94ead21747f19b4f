"""Event rollups: annual, weekly, daily and monthly."""

from pyspark.sql import functions as F

from panelrisk.functions import columns
from panelrisk.operators import composite, quality, rolling, rollups
from panelrisk.operators.normalize import zscores
from panelrisk.plans import panels
from panelrisk.workload.base import (ANNUAL, CHANGES, COUNTS, EVENTS, SHIPMENTS, USERS,
                                     USER_DAYS, WEEKLY, WEEKLY_COUNTS, WEEKLY_FLOATS,
                                     annual_sources, leaders, nation_events, query, r, rounded,
                                     rs, shipments, user_days, user_events, weekly,
                                     weekly_counts, with_cte, zs_sql)

IDS = 'country_std, year, week_num, week_id, "group"'


@query("weekly_rollup", with_cte(COUNTS) + "SELECT * FROM counts")
def weekly_rollup(spark, sf):
    return weekly_counts(spark, sf)


def _dirty(spark, sf):
    """user events without some names, with unreadable dates, and with two tiers an entity."""
    e = user_events(spark, sf)
    return e.select(
        F.when(F.col("event_id") % 7 > 0, F.col("country_std")).alias("country_std"),
        F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, None)
        .otherwise(F.col("date_start")).alias("event_date"),
        F.when(F.col("event_id") % 3 == 0, "B").when(F.col("event_id") % 3 == 1, "A")
        .alias("group"), F.col("event_type"), F.col("best").alias("fatalities"))


DIRTY = USERS + """, dirty AS (SELECT CASE WHEN event_id % 7 > 0 THEN country_std END AS country_std,
 CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 THEN day END AS d, best,
 CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'OTHER' END AS tier FROM user_events)"""


@query("dirty_weekly_rollup", with_cte(DIRTY) + """SELECT country_std,
 CAST(isoyear(d) AS INTEGER) AS year, CAST(weekofyear(d) AS INTEGER) AS week_num,
 MIN(tier) AS "group", COUNT(*) AS total_events, CAST(SUM(best) AS BIGINT) AS weekly_fatalities
 FROM dirty WHERE country_std IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2, 3""")
def dirty_weekly_rollup(spark, sf):
    dated = columns.drop_null_keys(columns.with_week(_dirty(spark, sf)), ["country_std", "week_id"])
    return rollups.weekly_rollup(dated).select("country_std", "year", "week_num", "group",
                                               "total_events", "weekly_fatalities")


@query("null_key_report", with_cte(DIRTY) + """SELECT COUNT(*) AS rows,
 COUNT(*) FILTER (country_std IS NULL OR d IS NULL) AS dropped,
 COUNT(*) FILTER (country_std IS NULL) AS null_country_std,
 COUNT(*) FILTER (d IS NULL) AS null_week_id FROM dirty""")
def null_key_report(spark, sf):
    return columns.null_key_counts(columns.with_week(_dirty(spark, sf)), ["country_std", "week_id"])


@query("rolling_intensity", with_cte(WEEKLY) + f"""SELECT {IDS}, {r('CII_roll7', 'CII_roll7')},
 {r('CII_roll90', 'CII_roll90')} FROM weekly""")
def rolling_intensity(spark, sf):
    w = weekly_counts(spark, sf).withColumn("CII", F.col("weekly_fatalities").cast("double"))
    w = rolling.rolling_means(w, {"CII_roll7": ("CII", 1), "CII_roll90": ("CII", 13)})
    return rounded(w.select("country_std", "year", "week_num", "week_id", "group", "CII_roll7",
                            "CII_roll90"))


@query("weekly_panel", with_cte(WEEKLY) + f"""SELECT {IDS}, {', '.join(WEEKLY_COUNTS)},
 {rs(WEEKLY_FLOATS)} FROM weekly""")
def weekly_panel(spark, sf):
    return rounded(weekly(spark, sf))


@query("entity_zscore", with_cte(WEEKLY) + f""", z AS (SELECT *,
 {zs_sql(['CII_roll90', 'battle_ratio', 'spillover'])} FROM weekly)
 SELECT {IDS}, {rs(['CII_roll90_z', 'battle_ratio_z', 'spillover_z'])} FROM z""")
def entity_zscore(spark, sf):
    z = zscores(weekly(spark, sf), ["CII_roll90", "battle_ratio", "spillover"])
    return rounded(z.select("country_std", "year", "week_num", "week_id", "group",
                            "CII_roll90_z", "battle_ratio_z", "spillover_z"))


@query("event_zscore_rows", with_cte(USERS) + f""", v AS (SELECT event_id, country_std,
 CASE WHEN type_of_violence = 1 THEN NULL ELSE value END AS x FROM user_events),
 z AS (SELECT *, {zs_sql(['x'])} FROM v) SELECT event_id, {r('x_z', 'x_z')} FROM z""")
def event_zscore_rows(spark, sf):
    u = user_events(spark, sf).select("event_id", "country_std", F.when(
        F.col("type_of_violence") != 1, F.col("value")).alias("x"))
    return rounded(zscores(u, ["x"], grain="rows").select("event_id", "x_z"))


@query("top_risk", with_cte(WEEKLY) + f""", z AS (SELECT *, {zs_sql(['CII_roll90'])} FROM weekly)
 SELECT country_std, week_id, {r('CII_roll90', 'CII_roll90')},
 {r('CII_roll90_z', 'CII_roll90_z')}
 FROM z ORDER BY CII_roll90_z DESC, country_std, week_id LIMIT 20""")
def top_risk(spark, sf):
    z = zscores(weekly(spark, sf), ["CII_roll90"])
    return rounded(quality.top_rows(z, "CII_roll90_z", 20,
                                    ["country_std", "week_id", "CII_roll90", "CII_roll90_z"],
                                    ["country_std", "week_id"]))


def _annual_sql(src, kind, codes, month, extra=""):
    conditions = [f"{kind} = {c}" if not isinstance(c, list) else
                  f"{kind} IN ({', '.join(repr(x) for x in c)})" for c in codes]
    names = ["state", "nonstate", "onesided"]
    value = "best" if src == "user_events" else "fatalities"
    sums = ", ".join(f"CAST(COALESCE(SUM({value}) FILTER ({c}), 0) AS BIGINT) AS deaths_{n}"
                     for n, c in zip(names, conditions))
    counts = ", ".join(f"COUNT(*) FILTER ({c}) AS events_{n}"
                       for n, c in zip(names, conditions))
    return (f"SELECT {extra}, country_std, COALESCE(\"group\", 'OTHER') AS \"group\", "
            f"COUNT(*) AS event_count, CAST(COALESCE(SUM({value}), 0) AS BIGINT) AS total_deaths, "
            f"{sums}, {counts}, COUNT(DISTINCT {month}) AS active_months "
            f"FROM {src} GROUP BY 1, 2, 3")


@query("coded_annual_rollup", with_cte(USERS) + _annual_sql(
    "user_events", "type_of_violence", [1, 2, 3], "month(day)", "year"))
def coded_annual_rollup(spark, sf):
    return rollups.annual_coded(user_events(spark, sf))


NAMED_SQL = _annual_sql(
    "nation_events", "event_type",
    [["Battles"], ["Riots", "Protests", "Explosions/Remote violence", "Strategic developments"],
     ["Violence against civilians"]], "month(event_date)",
    "CAST(year(event_date) AS INTEGER) AS year")


def named_annual(spark, sf, events=None):
    return rollups.annual_named((nation_events(spark, sf) if events is None else events)
                                .withColumn("year", F.year("event_date")))


@query("named_annual_rollup", with_cte(EVENTS) + NAMED_SQL)
def named_annual_rollup(spark, sf):
    return named_annual(spark, sf)


@query("active_months_from_weeks", with_cte(EVENTS) + """SELECT country_std,
 CAST(isoyear(event_date) AS INTEGER) AS year,
 COUNT(DISTINCT least(12, CAST(ceil(week(event_date) / 4.33) AS INTEGER))) AS active_months
 FROM nation_events GROUP BY 1, 2""")
def active_months_from_weeks(spark, sf):
    from panelrisk.functions.columns import with_week
    e = with_week(nation_events(spark, sf), "event_date").select(
        "country_std", "group", "year", "event_type", "fatalities",
        F.concat(F.col("year"), F.lit("-W"), F.lpad(F.col("week_num").cast("string"), 2, "0"))
        .alias("week"))
    return rollups.annual_named(e).select("country_std", "year", "active_months")


@query("geographic_spread", with_cte(EVENTS) + """SELECT country_std,
 CAST(isoyear(event_date) AS INTEGER) AS year, CAST(week(event_date) AS INTEGER) AS week_num,
 COUNT(DISTINCT (ROUND(lat, 2), ROUND(lon, 2))) AS geographic_spread
 FROM nation_events GROUP BY 1, 2, 3""")
def geographic_spread(spark, sf):
    return weekly_counts(spark, sf).select("country_std", "year", "week_num",
                                           "geographic_spread")


@query("event_ratios", with_cte(WEEKLY) + f"""SELECT country_std, week_id,
 {rs(['battle_ratio', 'civilian_targeting_ratio'])} FROM weekly""")
def event_ratios(spark, sf):
    return rounded(rollups.with_ratios(weekly_counts(spark, sf)).select(
        "country_std", "week_id", "battle_ratio", "civilian_targeting_ratio"))


@query("displacement_annual", with_cte(SHIPMENTS) + """SELECT country_std, year,
 MIN("group") AS "group", SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END)
 AS refugee_outflow, SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS idp_count
 FROM shipments GROUP BY 1, 2""")
def displacement_annual(spark, sf):
    """Text numbers, negatives and blanks; several rows per (entity, year)."""
    s = shipments(spark, sf)
    text = F.col("l_quantity").cast("string")
    raw = s.select("country_std", "group", F.col("year").cast("string").alias("year"),
                   F.when(F.col("l_returnflag") == "R", text)
                   .when(F.col("l_returnflag") == "N", F.lit("-5")).alias("refugees"),
                   F.when(F.col("l_returnflag") == "A", text)
                   .when(F.col("l_returnflag") == "N", F.lit("n/a")).alias("idps"))
    return rollups.consolidate_annual(raw)


@query("leader_changes", with_cte(CHANGES) + """SELECT country_std, "group", year, month, leader,
 election_now, anticipation, leader_change, change_with_election, irregular_change
 FROM changed""")
def leader_changes(spark, sf):
    return rolling.state_changes(leaders(spark, sf))


FLAGS = CHANGES + """, flags AS (SELECT country_std, year, MIN("group") AS "group",
 MAX(leader_change) AS leader_change_flag, MAX(election_now) AS election_flag,
 MAX(irregular_change) AS irregular_change_flag FROM changed GROUP BY 1, 2)"""


def leader_years(spark, sf, events=None):
    return rollups.flags_to_years(rolling.state_changes(leaders(spark, sf, events)), {
        "leader_change_flag": "leader_change", "election_flag": "election_now",
        "irregular_change_flag": "irregular_change"})


@query("leader_flags_annual", with_cte(FLAGS) + "SELECT * FROM flags")
def leader_flags_annual(spark, sf):
    return leader_years(spark, sf)


@query("shock_grade", with_cte(FLAGS) + """SELECT country_std, year,
 greatest(CASE WHEN leader_change_flag = 1 THEN 0.3 ELSE 0.0 END,
 CASE WHEN election_flag = 1 THEN 0.7 ELSE 0.0 END)::DOUBLE AS PolitShock,
 0 AS irregular_change_flag FROM flags""")
def shock_grade(spark, sf):
    return composite.shock_grade(leader_years(spark, sf)).select(
        "country_std", "year", "PolitShock", "irregular_change_flag")


@query("shock_grade_irregular", with_cte(FLAGS) + """SELECT country_std, year,
 (CASE WHEN irregular_change_flag = 1 THEN 1.0 WHEN election_flag = 1 THEN 0.7
 WHEN leader_change_flag = 1 THEN 0.3 ELSE 0.0 END)::DOUBLE AS PolitShock,
 irregular_change_flag FROM flags""")
def shock_grade_irregular(spark, sf):
    return composite.shock_grade(leader_years(spark, sf), irregular_counts=True).select(
        "country_std", "year", "PolitShock", "irregular_change_flag")


@query("user_state_changes", with_cte(USER_DAYS) + """, p AS (SELECT *, lag(leader) OVER
 (PARTITION BY country_std ORDER BY day) AS prev FROM user_days)
 SELECT country_std, day, leader, CASE WHEN prev IS NOT NULL AND prev <> leader THEN 1 ELSE 0 END
 AS leader_change FROM p""")
def user_state_changes(spark, sf):
    return rolling.state_changes(user_days(spark, sf), order=("day",)).select(
        "country_std", "day", "leader", "leader_change")


@query("weekly_to_annual_means", with_cte(WEEKLY) + f""", z AS (SELECT *,
 {zs_sql(['CII_roll7', 'CII_roll90', 'spillover'])} FROM weekly)
 SELECT country_std, year, {r('AVG(CII_roll7_z)', 'Z_CII_7d')},
 {r('AVG(CII_roll90_z)', 'Z_CII_90d')}, {r('AVG(spillover_z)', 'spillover_z')}
 FROM z GROUP BY 1, 2""")
def weekly_to_annual_means(spark, sf):
    z = zscores(weekly(spark, sf), ["CII_roll7", "CII_roll90", "spillover"])
    return rounded(rollups.weekly_to_years(z, {"Z_CII_7d": "CII_roll7_z",
                                               "Z_CII_90d": "CII_roll90_z",
                                               "spillover_z": "spillover_z"}))


@query("weekly_magnitude", with_cte(COUNTS) + """SELECT country_std, week_id,
 CAST(SUM(weekly_fatalities) AS BIGINT) AS fatalities FROM counts GROUP BY 1, 2""")
def weekly_magnitude(spark, sf):
    return rollups.sum_by(weekly_counts(spark, sf), ["country_std", "week_id"],
                          "weekly_fatalities", "fatalities")


@query("kind_distribution", with_cte(EVENTS) + """SELECT event_type, COUNT(*) AS events,
 CAST(SUM(fatalities) AS BIGINT) AS deaths FROM nation_events GROUP BY 1""")
def kind_distribution(spark, sf):
    return rollups.kind_distribution(nation_events(spark, sf), "event_type", "fatalities")


@query("tier_summary", with_cte(USERS) + """SELECT COALESCE("group", 'OTHER') AS tier,
 COUNT(DISTINCT country_std) AS entities, COUNT(*) AS rows, CAST(SUM(best) AS BIGINT) AS best
 FROM user_events GROUP BY 1""")
def tier_summary(spark, sf):
    return rollups.tier_summary(user_events(spark, sf), ["best"])


@query("tier_trend", with_cte(ANNUAL) + f"""SELECT year, "group",
 {r('AVG(v2x_libdem)', 'mean_value')} FROM annual GROUP BY 1, 2""")
def tier_trend(spark, sf):
    return rounded(rollups.mean_by(annual_sources(spark, sf), ["year", "group"], "v2x_libdem",
                                   "mean_value"))


@query("annual_panel_sorted", with_cte(EVENTS) + NAMED_SQL + " ORDER BY country_std, year")
def annual_panel_sorted(spark, sf):
    events = nation_events(spark, sf).withColumn("year", F.year("event_date"))
    return panels.annual_panel(events).orderBy("country_std", "year")
