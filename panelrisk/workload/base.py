"""The given tables in the roles of the data model, once as DataFrames and once as SQL.

orders + customer + nation + region play the long event history (25 entities),
events the one with many entities, lineitem + supplier the annual and daily
sources, nation the map. Every role is read from the whole table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.operators import rollups
from panelrisk.plans import panels

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and, if there is one, its SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = " ".join(sql.split("\n"))
        return fn
    return add


def table(spark: SparkSession, sf, name, *columns) -> DataFrame:
    """A given table, or the named columns of it."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Round all floating columns, and turn -0.0 into 0.0.

    Rounding in two steps lets the decimal value decide a tie, not floating noise.
    """
    return df.select(*[
        (F.round(F.round(F.col(f.name).cast("double"), digits + 4), digits) + F.lit(0.0))
        .alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema])


def exact(expr, digits=6):
    """SQL rounding on the decimal value of a double."""
    return (f"CAST(ROUND(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38, {digits + 4})), {digits}) "
            "AS DOUBLE)")


def r(expr, alias, digits=6):
    """SQL counterpart of ``rounded`` for one expression."""
    return f"{exact(expr, digits)} + 0.0 AS {alias}"


def rs(names, digits=6, prefix=""):
    return ", ".join(r(prefix + n, n, digits) for n in names)


def with_cte(*ctes):
    return "WITH " + ", ".join(ctes) + " "


# --- long event history -------------------------------------------------------

KIND = {"1-URGENT": "Battles", "2-HIGH": "Violence against civilians", "3-MEDIUM": "Riots",
        "4-NOT SPECIFIED": "Protests", "5-LOW": "Explosions/Remote violence"}


def places(spark, sf) -> DataFrame:
    return (table(spark, sf, "nation").join(table(spark, sf, "region"),
                                            F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("country_std"),
                    F.col("r_name").alias("group")))


def nation_events(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_orderpriority", "o_totalprice", "o_orderstatus")
    customers = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    kind = F.lit(None).cast("string")
    for code, name in KIND.items():
        kind = F.when(F.col("o_orderpriority") == code, name).otherwise(kind)
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("country_std", "group", F.col("o_orderkey").alias("event_key"),
                    F.to_date("o_orderdate").alias("event_date"), kind.alias("event_type"),
                    F.floor(F.col("o_totalprice") / 1000).cast("long").alias("fatalities"),
                    F.col("o_orderstatus").alias("status"),
                    (F.col("c_acctbal") / 97.0).alias("lat"),
                    ((F.col("c_custkey") % 360) / 7.0).alias("lon")))


_KIND_SQL = "CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"

PLACES = """places AS (SELECT n_nationkey, n_name AS country_std, r_name AS "group"
 FROM nation JOIN region ON n_regionkey = r_regionkey)"""

EVENTS = PLACES + f""", nation_events AS (
 SELECT country_std, "group", o_orderkey AS event_key, CAST(o_orderdate AS DATE) AS event_date,
 {_KIND_SQL} AS event_type, CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS fatalities,
 o_orderstatus AS status, c_acctbal / 97.0 AS lat, (c_custkey % 360) / 7.0 AS lon
 FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN places ON c_nationkey = n_nationkey)"""


def edges(spark, sf) -> DataFrame:
    """Each nation borders the ones five keys away, so two of its own region."""
    n = table(spark, sf, "nation", "n_nationkey", "n_name")
    ends = n.select(F.col("n_name").alias("src"), F.col("n_nationkey").alias("a"), F.explode(
        F.array((F.col("n_nationkey") + 5) % 25, (F.col("n_nationkey") + 20) % 25)).alias("b"))
    return ends.join(n, F.col("b") == F.col("n_nationkey")).select(
        "src", F.col("n_name").alias("dst"),
        (100.0 + 10 * ((F.col("a") + F.col("b")) % 7)).alias("dist"))


EDGES = """edges AS (SELECT s.n_name AS src, d.n_name AS dst,
 100.0 + 10 * ((s.n_nationkey + d.n_nationkey) % 7) AS dist
 FROM nation s JOIN nation d ON d.n_nationkey IN ((s.n_nationkey + 5) % 25,
 (s.n_nationkey + 20) % 25))"""


def weekly_counts(spark, sf) -> DataFrame:
    """Weekly rollup without derived columns."""
    from panelrisk.functions.columns import with_week
    return rollups.weekly_rollup(with_week(nation_events(spark, sf), "event_date"))


def weekly(spark, sf, events=None) -> DataFrame:
    """The weekly panel; its rollup of the events is written once (see ``weekly_panel``)."""
    events = nation_events(spark, sf) if events is None else events
    return panels.weekly_panel(events, edges(spark, sf), time="event_date")


WEEK_ID = "CAST(isoyear({d}) AS VARCHAR) || '-' || lpad(CAST(week({d}) AS VARCHAR), 2, '0')"

COUNTS = EVENTS + f""", counts AS (SELECT country_std, CAST(isoyear(event_date) AS INTEGER) AS year,
 CAST(week(event_date) AS INTEGER) AS week_num, {WEEK_ID.format(d='event_date')} AS week_id,
 "group", COUNT(*) AS total_events, CAST(SUM(fatalities) AS BIGINT) AS weekly_fatalities,
 COUNT(*) FILTER (event_type = 'Battles') AS battle_count,
 COUNT(*) FILTER (event_type = 'Violence against civilians') AS vac_count,
 COUNT(*) FILTER (event_type IN ('Riots', 'Protests', 'Explosions/Remote violence'))
 AS nonstate_count,
 COUNT(DISTINCT (ROUND(lat, 2), ROUND(lon, 2))) AS geographic_spread
 FROM nation_events GROUP BY ALL)"""

WEEKLY = COUNTS + ", " + EDGES + """, rolled AS (SELECT *,
 battle_count / (total_events + 1e-8) AS battle_ratio,
 vac_count / (total_events + 1e-8) AS civilian_targeting_ratio,
 CAST(weekly_fatalities AS DOUBLE) AS CII, CAST(weekly_fatalities AS DOUBLE) AS CII_roll7,
 AVG(CAST(weekly_fatalities AS DOUBLE)) OVER (PARTITION BY country_std ORDER BY year, week_num
 ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS CII_roll90 FROM counts),
 received AS (SELECT e.src AS country_std, c.week_id,
 SUM(c.CII / (sqrt(e.dist) + 1)) AS spillover
 FROM rolled c JOIN edges e ON e.dst = c.country_std GROUP BY 1, 2),
 weekly AS (SELECT w.*, COALESCE(x.spillover, 0.0) AS spillover FROM rolled w
 LEFT JOIN received x ON x.country_std = w.country_std AND x.week_id = w.week_id)"""

WEEKLY_FLOATS = ["battle_ratio", "civilian_targeting_ratio", "CII", "CII_roll7", "CII_roll90",
                 "spillover"]
WEEKLY_COUNTS = ["total_events", "weekly_fatalities", "battle_count", "vac_count",
                 "nonstate_count", "geographic_spread"]


def z_sql(c, entity="country_std"):
    """SQL of the guarded z-score of a column."""
    sd = f"stddev_pop({c}) OVER (PARTITION BY {entity})"
    return (f"CASE WHEN {c} IS NULL OR {sd} IS NULL OR {sd} < 1e-6 THEN 0.0 ELSE "
            f"greatest(-8.0, least(8.0, ROUND(({c} - AVG({c}) OVER (PARTITION BY {entity}))"
            f" / {sd}, 6))) END")


def zs_sql(cols, entity="country_std"):
    return ", ".join(f"{z_sql(c, entity)} AS {c}_z" for c in cols)


# --- many entities ------------------------------------------------------------

def user_events(spark, sf) -> DataFrame:
    """events as coded incidents: kinds 1, 2, 3; tiers with NULL; integer magnitude."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 3) \
        .otherwise(2)
    tier = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit(None)),
                        (F.col("user_id") % 4 + 1).cast("int"))
    return e.select("event_id", "ts", F.to_date("ts").alias("day"),
                    F.year("ts").alias("year"),
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("country_std"),
                    tier.alias("group"), code.alias("type_of_violence"), "event_type",
                    F.floor("value").cast("long").alias("best"), "value",
                    F.date_format("ts", "yyyy-MM-dd").alias("date_start"))


USERS = """user_events AS (SELECT event_id, ts, CAST(ts AS DATE) AS day,
 CAST(year(ts) AS INTEGER) AS year, 'user_' || CAST(user_id AS VARCHAR) AS country_std,
 CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS "group",
 CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 ELSE 2 END AS type_of_violence,
 event_type, CAST(FLOOR(value) AS BIGINT) AS best, value FROM events)"""


def user_days(spark, sf) -> DataFrame:
    """Panel grain: one row per (user, day) with the day's last event and a gappy signal."""
    u = user_events(spark, sf)
    return u.groupBy("country_std", "day").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("leader"),
        F.sum("best").alias("best"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("event_type") == "signup", F.col("best"))).cast("double")
        .alias("signal"))


USER_DAYS = USERS + """, user_days AS (SELECT country_std, day,
 arg_max(event_type, (ts, event_id)) AS leader, CAST(SUM(best) AS BIGINT) AS best,
 COUNT(*) AS n, CAST(MAX(best) FILTER (event_type = 'signup') AS DOUBLE) AS signal
 FROM user_events GROUP BY 1, 2)"""


# --- annual and daily sources -------------------------------------------------

def shipments(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
                 "l_orderkey", "l_linenumber", "l_partkey")
    sup = table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    return (line.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(places(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("year", F.year("l_shipdate")))


SHIPMENTS = PLACES + """, shipments AS (SELECT lineitem.*, country_std, "group",
 CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN places ON s_nationkey = n_nationkey)"""


def annual_sources(spark, sf) -> DataFrame:
    """One row per (nation, year) with the raw columns of all annual sources."""
    return shipments(spark, sf).groupBy("country_std", "year", "group").agg(
        F.round(F.avg("l_discount") * 10, 6).alias("v2x_libdem"),
        F.round(F.avg("l_tax") * 10, 6).alias("v2x_corr"),
        F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6)
        .alias("v2elintim"),
        F.round(F.avg("l_quantity"), 6).alias("GDP_Growth"),
        F.round(F.avg("l_extendedprice") / 1000, 6).alias("Inflation"),
        F.round(F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)), 6)
        .alias("Military_Expenditure"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
        .alias("refugees"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0))
        .alias("idps"),
        F.max("l_quantity").alias("disaster_deaths"),
        F.count(F.lit(1)).alias("rows"))


ANNUAL = SHIPMENTS + """, annual AS (SELECT country_std, year, "group",
 ROUND(AVG(l_discount) * 10, 6) AS v2x_libdem, ROUND(AVG(l_tax) * 10, 6) AS v2x_corr,
 ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS v2elintim,
 ROUND(AVG(l_quantity), 6) AS GDP_Growth, ROUND(AVG(l_extendedprice) / 1000, 6) AS Inflation,
 ROUND(AVG(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS Military_Expenditure,
 SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS refugees,
 SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS idps,
 MAX(l_quantity) AS disaster_deaths, COUNT(*) AS rows
 FROM shipments GROUP BY 1, 2, 3)"""


def media(spark, sf) -> DataFrame:
    """Daily media rows per nation and event code, from shipments."""
    s = shipments(spark, sf)
    code = F.lpad((F.col("l_partkey") % 20 + 1).cast("string"), 2, "0")
    return rollups.media_daily(
        s.withColumns({"code": F.concat(code, (F.col("l_linenumber") % 10).cast("string")),
                       "stab": F.col("l_discount") * 100 - 5,
                       "tone": F.col("l_tax") * 100 - 4,
                       "q": F.col("l_quantity").cast("long"),
                       "ln": F.col("l_linenumber").cast("long"), "one": F.lit(1)}),
        "l_shipdate", "country_std", "code", "stab", "tone", "q", "ln", "one")


MEDIA = SHIPMENTS + """, media AS (SELECT CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS SQLDATE,
 country_std AS ActionGeo_CountryCode,
 lpad(CAST(l_partkey % 20 + 1 AS VARCHAR), 2, '0') || CAST(l_linenumber % 10 AS VARCHAR)
 AS EventCode,
 AVG(l_discount * 100 - 5) AS AvgGoldstein, AVG(l_tax * 100 - 4) AS AvgTone,
 CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS TotalMentions,
 CAST(SUM(l_linenumber) AS BIGINT) AS TotalSources, COUNT(*) AS TotalArticles
 FROM shipments GROUP BY 1, 2, 3)"""


def leaders(spark, sf, events=None) -> DataFrame:
    """Monthly state per nation: kind of the last event, two election flags."""
    e = nation_events(spark, sf) if events is None else events
    return e.groupBy("country_std", "group", F.year("event_date").alias("year"),
                     F.month("event_date").alias("month")).agg(
        F.max_by(F.when(F.col("event_type") != "Protests", F.col("event_type")),
                 F.struct("event_date", "event_key")).alias("leader"),
        F.max((F.col("fatalities") > 490).cast("int")).alias("election_now"),
        F.max((F.col("status") == "P").cast("int")).alias("anticipation"))


LEADERS = EVENTS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY country_std,
 year(event_date), month(event_date) ORDER BY event_date DESC, event_key DESC) AS back
 FROM nation_events),
 leaders AS (SELECT country_std, "group", CAST(year(event_date) AS INTEGER) AS year,
 CAST(month(event_date) AS INTEGER) AS month,
 MAX(CASE WHEN back = 1 AND event_type <> 'Protests' THEN event_type END) AS leader,
 MAX(CASE WHEN fatalities > 490 THEN 1 ELSE 0 END) AS election_now,
 MAX(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS anticipation
 FROM ranked GROUP BY 1, 2, 3, 4)"""

CHANGES = LEADERS + """, lagged AS (SELECT *, lag(leader) OVER (PARTITION BY country_std
 ORDER BY year, month) AS prev FROM leaders),
 changes AS (SELECT country_std, "group", year, month, leader, election_now, anticipation,
 CASE WHEN prev IS NOT NULL AND leader IS DISTINCT FROM prev THEN 1 ELSE 0 END AS leader_change
 FROM lagged),
 changed AS (SELECT *, CASE WHEN leader_change = 1 AND (election_now = 1 OR anticipation = 1)
 THEN 1 ELSE 0 END AS change_with_election,
 CASE WHEN leader_change = 1 AND NOT (election_now = 1 OR anticipation = 1)
 THEN 1 ELSE 0 END AS irregular_change FROM changes)"""


# --- scores -------------------------------------------------------------------

def scores(spark, sf) -> DataFrame:
    """Labelled documents: y = quality, two scores and a tier-like key."""
    d = table(spark, sf, "documents", "doc_id", "lang", "n_chars", "source")
    y = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    return d.join(y, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("y"), F.col("toxic").alias("y_now"),
        F.round(F.least(F.col("n_chars"), F.lit(20000)) / 20000.0, 6).alias("p"),
        ((F.col("doc_id") * 37 % 101) / 101.0).alias("q"))


SCORES = """scores AS (SELECT doc_id, lang, source, quality AS y, toxic AS y_now,
 ROUND(least(n_chars, 20000) / 20000.0, 6) AS p, (doc_id * 37 % 101) / 101.0 AS q
 FROM documents JOIN labels USING (doc_id))"""


def curve_sql(src, by=""):
    """CTEs of the ranking curve of ``src(by, y, p)``."""
    b, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""cnt AS (SELECT {b}CAST(p AS DOUBLE) AS threshold, SUM(y) AS pos, SUM(1 - y) AS neg
 FROM {src} GROUP BY {b}CAST(p AS DOUBLE)),
 cum AS (SELECT *, SUM(pos) OVER ({part} ORDER BY threshold DESC) AS tp,
 SUM(neg) OVER ({part} ORDER BY threshold DESC) AS fp, SUM(pos) OVER ({part}) AS pt,
 SUM(neg) OVER ({part}) AS nt FROM cnt),
 pr AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec,
 CAST(tp AS DOUBLE) / NULLIF(pt, 0) AS rec FROM cum),
 curve AS (SELECT *, 2 * prec * rec / (prec + rec + 1e-8) AS f1 FROM pr)"""


AUC_SQL = """CASE WHEN MAX(pt) > 0 AND MAX(nt) > 0 THEN
 SUM(pos * (nt - fp + neg / 2.0)) / NULLIF(MAX(pt) * MAX(nt), 0) END"""
AP_SQL = """CASE WHEN MAX(pt) > 0 AND MAX(nt) > 0 THEN
 SUM(prec * pos) / NULLIF(MAX(pt), 0) END"""
