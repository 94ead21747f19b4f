"""Sub-indices, the weighted annual index and the weekly feature matrix."""

from pyspark.sql import functions as F

from panelrisk.operators import composite, quality, rolling
from panelrisk.operators.normalize import zscores
from panelrisk.plans import panels
from panelrisk.session import pin
from panelrisk.workload.base import (ANNUAL, EVENTS, MEDIA, PLACES, WEEKLY, annual_sources, exact,
                                     media, nation_events, places, query, r, rounded, rs, weekly,
                                     with_cte, z_sql, zs_sql)
from panelrisk.workload.panel_queries import STATIC, static_attribute
from panelrisk.workload.rollup_queries import FLAGS, NAMED_SQL, leader_years, named_annual

PERIOD = (1996, 2000)
EVENT_Z = ["total_deaths", "event_count", "deaths_state", "deaths_onesided"]
VDEM_Z, WB_Z = ["v2x_corr", "v2elintim"], ["GDP_Growth", "Inflation", "Military_Expenditure"]


WEEKLY_Z = ["CII_roll7", "CII_roll90", "spillover"]


def index_sources(spark, sf, food=False, weekly_z=None):
    """All annual sources in the shape the index expects."""
    a = pin(annual_sources(spark, sf))
    # the events are joined and read once for the weekly, the monthly and the annual rollup
    events = pin(nation_events(spark, sf))
    if weekly_z is None:
        weekly_z = zscores(weekly(spark, sf, events), WEEKLY_Z)
    moved = a.select("country_std", "year", F.col("refugees").alias("refugee_outflow"),
                     F.col("idps").alias("idp_count"))
    shock = composite.shock_grade(leader_years(spark, sf, events), irregular_counts=True)
    sources = {
        "ucdp": zscores(named_annual(spark, sf, events), EVENT_Z),
        "qog": zscores(static_attribute(spark, sf), ["al_ethnic2000"]),
        "vdem": zscores(a.select("country_std", "year", "v2x_libdem", *VDEM_Z), VDEM_Z),
        "wb": zscores(a.select("country_std", "year", *WB_Z), WB_Z),
        "gdelt": zscores(pin(media(spark, sf)).withColumnRenamed("ActionGeo_CountryCode",
                                                            "country_std"),
                         ["AvgTone", "AvgGoldstein"], grain="rows"),
        "acled": weekly_z,
        "reign": zscores(shock, ["PolitShock", "irregular_change_flag"]),
        "unhcr": zscores(moved, ["refugee_outflow", "idp_count"]),
        "emdat": zscores(a.select("country_std", "year", "disaster_deaths"),
                         ["disaster_deaths"]),
    }
    if food:
        sources["fao"] = zscores(a.select("country_std", "year", F.col("Inflation").alias(
            "FoodShock")), ["FoodShock"])
    return sources


def _regions(spark, sf):
    return places(spark, sf).select(F.col("country_std").alias("canonical"),
                                    F.col("group").alias("region"))


def _tail(cte):
    """CTEs after the shared ``places`` head."""
    return cte[len(PLACES) + 2:]


EVENTS_TAIL = _tail(EVENTS)
UCDP = f"""ucdp0 AS ({NAMED_SQL}), ucdp1 AS (SELECT *, {zs_sql(EVENT_Z)},
 COALESCE((total_deaths - lag(total_deaths) OVER w) / NULLIF(CAST(lag(total_deaths) OVER w
 AS DOUBLE), 0), 0.0) AS pct FROM ucdp0 WINDOW w AS (PARTITION BY country_std ORDER BY year)),
 ucdp AS (SELECT *, {z_sql('pct')} AS esc_z FROM ucdp1)"""
SHOCK = """shock AS (SELECT country_std, year, (CASE WHEN irregular_change_flag = 1 THEN 1.0
 WHEN election_flag = 1 THEN 0.7 WHEN leader_change_flag = 1 THEN 0.3 ELSE 0.0 END)::DOUBLE
 AS PolitShock, irregular_change_flag FROM flags)"""
ALL_SOURCES = ", ".join([
    WEEKLY, FLAGS[len(EVENTS) + 2:], SHOCK, UCDP, _tail(ANNUAL),
    MEDIA[MEDIA.index("media AS"):], _tail(STATIC),
    f"qz AS (SELECT country_std, {z_sql('al_ethnic2000')} AS al_ethnic2000_z FROM static)",
    f"vz AS (SELECT *, {zs_sql(VDEM_Z + WB_Z + ['refugees', 'idps', 'disaster_deaths'])} "
    "FROM annual)",
    f"""gz AS (SELECT ActionGeo_CountryCode AS country_std, SQLDATE // 10000 AS year,
 {z_sql('AvgTone', 'ActionGeo_CountryCode')} AS tone_z,
 {z_sql('AvgGoldstein', 'ActionGeo_CountryCode')} AS gold_z FROM media)""",
    """ga AS (SELECT country_std, year, AVG(tone_z) AS tone, AVG(gold_z) AS gold FROM gz
 GROUP BY 1, 2)""",
    f"wz AS (SELECT *, {zs_sql(['CII_roll7', 'CII_roll90', 'spillover'])} FROM weekly)",
    """wa AS (SELECT country_std, year, "group", AVG(CII_roll7_z) AS z7, AVG(CII_roll90_z) AS z90,
 AVG(spillover_z) AS sp FROM wz GROUP BY 1, 2, 3)""",
    """rc AS (SELECT country_std, year, COALESCE(ROUND((SUM(h) OVER g - h) / NULLIF(COUNT(*) OVER g
 - 1, 0), 6), 0.0) AS regcluster FROM (SELECT *, CASE WHEN z90 > 1.5 THEN 1.0 ELSE 0.0 END AS h
 FROM wa) WINDOW g AS (PARTITION BY "group", year))""",
    f"sz AS (SELECT *, {zs_sql(['PolitShock', 'irregular_change_flag'])} FROM shock)"])


def _c(x):
    return f"COALESCE({x}, 0.0)"


def index_sql(food, where="WHERE year BETWEEN 1996 AND 2000"):
    econ = (f"-0.40 * {_c('v.GDP_Growth_z')} + 0.25 * {_c('v.Inflation_z')} + "
            f"0.25 * {_c('v.Inflation_z')} + 0.10 * 0.0") if food else \
        f"-0.60 * {_c('v.GDP_Growth_z')} + 0.40 * {_c('v.Inflation_z')}"
    parts = f"""parts AS (SELECT u.country_std, u.year, u."group",
 {exact(f"""COALESCE(a.z90, 0.50 * u.total_deaths_z + 0.30 * u.event_count_z
 + 0.10 * u.deaths_state_z + 0.10 * u.deaths_onesided_z)""")} AS CII,
 {exact("""COALESCE(greatest(-8.0, least(8.0, (a.z7 - a.z90) / (abs(a.z90) + 1e-8))),
 u.esc_z)""")} AS ESC,
 {exact(f"""0.25 * {_c('q.al_ethnic2000_z')} + 0.30 *
 {_c('4.0 * v.v2x_libdem * (1.0 - v.v2x_libdem)')} + 0.25 * {_c('v.v2x_corr_z')}
 + 0.20 * {_c('v.Military_Expenditure_z')}""")} AS SFI,
 {exact(econ)} AS Econ,
 {exact(f"""0.50 * {_c('a.sp')} + 0.25 * (0.50 * {_c('g.tone')} + 0.50 * {_c('g.gold')})
 + 0.25 * {_c('v.refugees_z')}""")} AS Spill,
 {exact(f"""0.40 * {_c('v.v2elintim_z')} + 0.40 * {_c('s.PolitShock_z')}
 + 0.20 * {_c('s.irregular_change_flag_z')}""")} AS Polit,
 {exact(_c('a.z7'))} AS Z_CII_7d, {exact(_c('a.z90'))} AS Z_CII_90d,
 {_c('rc.regcluster')} AS regcluster, {_c('v.idps_z')} AS idp_count_z,
 CAST(0.0 AS DOUBLE) AS disaster_flag_z, {_c('v.disaster_deaths_z')} AS disaster_deaths_z
 FROM ucdp u LEFT JOIN qz q ON q.country_std = u.country_std
 LEFT JOIN vz v ON v.country_std = u.country_std AND v.year = u.year
 LEFT JOIN ga g ON g.country_std = u.country_std AND g.year = u.year
 LEFT JOIN wa a ON a.country_std = u.country_std AND a.year = u.year
 LEFT JOIN rc ON rc.country_std = u.country_std AND rc.year = u.year
 LEFT JOIN sz s ON s.country_std = u.country_std AND s.year = u.year),
 wri AS (SELECT *, {exact("""0.35 * CII + 0.20 * ESC + 0.15 * SFI + 0.10 * Econ
 + 0.12 * Spill + 0.08 * Polit""")} AS WRI FROM parts {where})"""
    return with_cte(ALL_SOURCES, parts)


PARTS = ["CII", "ESC", "SFI", "Econ", "Spill", "Polit"]
AUX = ["Z_CII_7d", "Z_CII_90d", "regcluster", "idp_count_z", "disaster_flag_z",
       "disaster_deaths_z"]


def full_index(spark, sf, food=False, period=PERIOD, weekly_z=None):
    return panels.annual_index(index_sources(spark, sf, food, weekly_z), _regions(spark, sf),
                               period=period)


@query("annual_index", index_sql(False) + f"""SELECT country_std, year, "group",
 {rs([*PARTS, *AUX, 'WRI'])} FROM wri""")
def annual_index(spark, sf):
    return rounded(full_index(spark, sf))


@query("annual_index_with_food", index_sql(True) + f"""SELECT country_std, year,
 {rs(['Econ', 'WRI'])} FROM wri""")
def annual_index_with_food(spark, sf):
    return rounded(full_index(spark, sf, food=True).select("country_std", "year", "Econ", "WRI"))


@query("annual_index_events_only", with_cte(EVENTS, UCDP) + f""", p AS (SELECT country_std, year,
 {exact("""0.50 * total_deaths_z + 0.30 * event_count_z + 0.10 * deaths_state_z
 + 0.10 * deaths_onesided_z""")} AS CII, esc_z AS ESC FROM ucdp)
 SELECT country_std, year, {rs(['CII', 'ESC'])},
 {r('0.35 * CII + 0.20 * ESC', 'WRI')} FROM p""")
def annual_index_events_only(spark, sf):
    """Only the required source: every formula uses its fallback."""
    src = {"ucdp": zscores(named_annual(spark, sf), EVENT_Z)}
    return rounded(panels.annual_index(src, period=None)
                   .select("country_std", "year", "CII", "ESC", "WRI"))


SPILL_KINDS = {"near_and_media": (True, False), "media_and_refugees": (False, True),
               "media": (False, False), "all": (True, True)}


@query("spill_regimes", with_cte(ALL_SOURCES) + f""", m AS (SELECT a.country_std, a.year,
 {_c('a.sp')} AS sp, 0.5 * {_c('g.tone')} + 0.5 * {_c('g.gold')} AS md, {_c('v.refugees_z')} AS rf
 FROM wa a LEFT JOIN ga g ON g.country_std = a.country_std AND g.year = a.year
 LEFT JOIN vz v ON v.country_std = a.country_std AND v.year = a.year)
 SELECT country_std, year, {r('0.60 * sp + 0.40 * md', 'near_and_media')},
 {r('0.50 * md + 0.50 * rf', 'media_and_refugees')}, {r('md', 'media')},
 {r('0.50 * sp + 0.25 * md + 0.25 * rf', '"all"')} FROM m""")
def spill_regimes(spark, sf):
    from panelrisk.operators import rollups
    from panelrisk.operators.panel import left_star
    s = index_sources(spark, sf)
    near = rollups.weekly_to_years(s["acled"], {"spillover_z": "spillover_z"})
    j = left_star(near, [rollups.media_to_years(s["gdelt"]),
                         s["unhcr"].select("country_std", "year", "refugee_outflow_z")])
    return rounded(j.select("country_std", "year", *[
        composite.spill_index(j if has_near else j.drop("spillover_z"), True, refugees).alias(n)
        for n, (has_near, refugees) in SPILL_KINDS.items()]))


@query("index_top_rows", index_sql(False) + f"""SELECT country_std, year, "group",
 {rs([*PARTS, 'WRI'])} FROM wri ORDER BY wri.WRI DESC, country_std, year LIMIT 20""")
def index_top_rows(spark, sf):
    return rounded(quality.top_rows(full_index(spark, sf), "WRI", 20,
                                    ["country_std", "year", "group", *PARTS, "WRI"],
                                    ["country_std", "year"]))


@query("index_by_tier", index_sql(False) + f"""SELECT "group", 'WRI' AS variable,
 {r('AVG(WRI)', 'mean')}, {r('stddev_samp(WRI)', 'std')}, COUNT(*) AS n,
 {r('MIN(WRI)', 'minimum')}, {r('quantile_cont(WRI, 0.25)', 'q1')},
 {r('quantile_cont(WRI, 0.5)', 'median')}, {r('quantile_cont(WRI, 0.75)', 'q3')},
 {r('MAX(WRI)', 'maximum')} FROM wri GROUP BY "group" """)
def index_by_tier(spark, sf):
    return rounded(quality.describe(pin(full_index(spark, sf)), ["WRI"], ["group"]))


@query("per_capita_intensity", with_cte(EVENTS) + f""", w AS (SELECT country_std,
 SUM(fatalities) AS cii, COUNT(DISTINCT lat) * (ascii(right(country_std, 1)) % 2) AS pop
 FROM nation_events GROUP BY 1) SELECT country_std,
 {r('COALESCE(cii / (NULLIF(CAST(pop AS DOUBLE), 0) / 1e6), 0.0)', 'per_million', 3)} FROM w""")
def per_capita_intensity(spark, sf):
    """Every second entity has an unknown (zero) population."""
    w = nation_events(spark, sf).groupBy("country_std").agg(
        F.sum("fatalities").alias("cii"), F.count_distinct("lat").alias("pop"))
    pop = F.col("pop") * (F.ascii(F.substring("country_std", -1, 1)) % 2)
    return rounded(w.select("country_std", composite.per_million("cii", pop)
                            .alias("per_million")), 3)


def feature_panel(spark, sf):
    # the weekly z table and the index are read several times
    w = weekly(spark, sf)
    z = pin(zscores(w, WEEKLY_Z))
    a = annual_sources(spark, sf).select("country_std", "year", "v2x_libdem", "v2elintim")
    index = pin(full_index(spark, sf, period=None, weekly_z=z)
                .select("country_std", "year", "SFI", "Econ", "Polit", "idp_count_z", "WRI"))
    labels = rolling.onset_labels(index, 1, threshold=0.0).select("country_std", "year", "Y")
    annual = index.join(labels, ["country_std", "year"], "left")
    return panels.weekly_feature_panel(w, z, annual, governance=a)


FEATURES_SQL = index_sql(False, "") + f""", ind AS (SELECT country_std, year, SFI, Econ, Polit,
 idp_count_z, WRI, CASE WHEN WRI > 0.0 THEN 1 ELSE 0 END AS act FROM wri), lab AS (SELECT *,
 lead(act) OVER (PARTITION BY country_std ORDER BY year) AS nxt FROM ind), ctx AS (SELECT l.*,
 CASE WHEN nxt IS NULL THEN NULL WHEN act = 0 AND nxt = 1 THEN 1 ELSE 0 END AS Y FROM lab l),
 cal AS (SELECT DISTINCT week_id, year, week_num FROM weekly),
 who AS (SELECT country_std, MIN("group") AS "group" FROM weekly GROUP BY 1),
 g0 AS (SELECT w.country_std, c.year, c.week_num, c.week_id, w."group",
 COALESCE(f.weekly_fatalities, 0) AS fat, COALESCE(f.total_events, 0) AS ev,
 COALESCE(f.CII, 0.0) AS CII, z.CII_roll7_z AS z7, z.CII_roll90_z AS z90, f.spillover AS sp,
 x.SFI, x.Econ, x.Polit, x.idp_count_z, x.WRI, x.Y, v.v2x_libdem
 FROM who w CROSS JOIN cal c
 LEFT JOIN weekly f ON f.country_std = w.country_std AND f.week_id = c.week_id
 LEFT JOIN wz z ON z.country_std = w.country_std AND z.week_id = c.week_id
 LEFT JOIN ctx x ON x.country_std = w.country_std AND x.year = c.year
 LEFT JOIN annual v ON v.country_std = w.country_std AND v.year = c.year),
 g1 AS (SELECT country_std, year, week_num, week_id, "group", fat, ev, CII, """ + ", ".join(
    f"""COALESCE(last_value({c} IGNORE NULLS) OVER b, 0.0) AS {c}"""
    for c in ("z7", "z90", "sp")) + ", " + ", ".join(
    f"""COALESCE(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER f)
 AS {c}""" for c in ("SFI", "Econ", "Polit", "idp_count_z", "WRI", "Y", "v2x_libdem")) + """
 FROM g0 WINDOW b AS (PARTITION BY country_std ORDER BY year, week_num ROWS BETWEEN
 UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY country_std ORDER BY year, week_num
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 g2 AS (SELECT *, AVG(CASE WHEN z90 > 1.5 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY "group",
 week_id) AS reg, AVG(fat) OVER (PARTITION BY country_std ORDER BY year, week_num ROWS BETWEEN
 3 PRECEDING AND CURRENT ROW) AS ma4, AVG(fat) OVER (PARTITION BY country_std ORDER BY year,
 week_num ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS ma12 FROM g1)"""


@query("weekly_features", FEATURES_SQL + f"""SELECT country_std, week_id, "group", fat AS
 weekly_fatalities, ev AS total_events, Y, {r('CII', 'F1_CII_pc')}, {r('z90', 'F2_Z_CII')},
 {r('COALESCE(4.0 * v2x_libdem * (1 - v2x_libdem), 0)', 'F4_Anocracy')}, {r('SFI', 'F6_SFI')},
 {r('Econ', 'F7_EconStress')}, {r('sp', 'F9_Spillover')}, {r('reg', 'F10_RegCluster')},
 {r('Polit', 'F11_PolitShock')}, {r('idp_count_z', 'F15_ForcedMig')},
 {r('z7', 'Z_CII_7d')}, {r('ma4', 'fatality_4w_ma')}, {r('ma12', 'fatality_12w_ma')},
 {r('ma4 - ma12', 'fatality_trend')},
 {r('''COALESCE(ma4 - ma12 - lag(ma4 - ma12) OVER (PARTITION BY country_std ORDER BY year,
 week_num), 0)''', 'conflict_accel')} FROM g2""")
def weekly_features(spark, sf):
    return rounded(feature_panel(spark, sf).select(
        "country_std", "week_id", "group", "weekly_fatalities", "total_events", "Y",
        "F1_CII_pc", "F2_Z_CII", "F4_Anocracy", "F6_SFI", "F7_EconStress", "F9_Spillover",
        "F10_RegCluster", "F11_PolitShock", "F15_ForcedMig", "Z_CII_7d", "fatality_4w_ma",
        "fatality_12w_ma", "fatality_trend", "conflict_accel"))
