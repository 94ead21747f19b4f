"""Names, codes and tiers. The spellings are assigned to customers by key."""

from pyspark.sql import functions as F

from panelrisk.operators import entities
from panelrisk.workload.base import USERS, query, r, rounded, table, user_events, with_cte

# spelling, canonical name, tier
NAMES = [("  SYRIA ", "Syria", "A"), ("Burma", "Myanmar", "A"),
         ("congo, dem. rep.", "DR Congo", "A"), ("Korea, South", "South Korea", "C"),
         ("Atlantis ", "Atlantis", "OTHER"), (None, None, "OTHER"),
         ("DPRK", "North Korea", "OTHER"), ("uk", "United Kingdom", "OTHER"),
         ("Yemen, Rep.", "Yemen", "A"), ("DEU", "Germany", "C"), ("x", "x", "OTHER")]
# code, canonical name, tier
CODES = [("SYR", "Syria", "A"), ("IZ", "Iraq", "A"), ("Congo/Zaire", "DR Congo", "A"),
         ("KOR", "South Korea", "C"), ("XX", "XX", "?"), ("Korea South", "South Korea", "C"),
         ("HTI", "Haiti", "B"), (" GM", "Germany", "C")]
# stored name, stored tier, repaired name, repaired tier
STORED = [("Cote d’Ivoire", "OTHER", "Ivory Coast", "OTHER"),
          ("Yemen (North Yemen)", "OTHER", "Yemen", "A"), ("Syria", None, "Syria", "A"),
          ("Narnia", "B", "Narnia", "B"), ("Türkiye", None, "Turkey", "OTHER"),
          (None, None, None, "OTHER"), ("Rep. of Korea", "C", "South Korea", "C")]


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'"
                           for v in values) + "]"


def _pick_sql(values, key="c_custkey"):
    return f"{_sql_list(values)}[{key} % {len(values)} + 1]"


def _pick(values, key="c_custkey"):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (F.col(key) % len(values) + 1).cast("int"))


def _customers(spark, sf, **named):
    return table(spark, sf, "customer", "c_custkey").select(
        "c_custkey", *[_pick(v).alias(n) for n, v in named.items()])


@query("alias_names", f"""SELECT c_custkey, {_pick_sql([n[1] for n in NAMES])} AS country_std,
 {_pick_sql([n[2] for n in NAMES])} AS "group" FROM customer""")
def alias_names(spark, sf):
    c = _customers(spark, sf, raw=[n[0] for n in NAMES])
    return entities.assign_tier(entities.canonicalise(c, "raw")).drop("raw")


@query("alias_names_capitalised", f"""SELECT c_custkey,
 {_pick_sql(['Syria', 'Myanmar', 'DR Congo', 'South Korea', 'Atlantis', '', 'North Korea',
             'United Kingdom', 'Yemen', 'Germany', ''])} AS country_std,
 {_pick_sql(['A', 'A', 'A', 'C', 'OTHER', 'UNKNOWN', 'OTHER', 'OTHER', 'A', 'C', 'UNKNOWN'])}
 AS "group" FROM customer""")
def alias_names_capitalised(spark, sf):
    return _capitalised(spark, sf).drop("raw")


def _capitalised(spark, sf):
    c = _customers(spark, sf, raw=[n[0] for n in NAMES])
    return entities.assign_tier(entities.canonicalise(c, "raw", fallback="capitalise"),
                                empty="UNKNOWN")


@query("code_resolution", f"""SELECT c_custkey, {_pick_sql([n[1] for n in CODES])} AS country_std,
 {_pick_sql([n[2] for n in CODES])} AS "group" FROM customer""")
def code_resolution(spark, sf):
    return entities.resolve_codes(_customers(spark, sf, code=[n[0] for n in CODES]),
                                  "code").drop("code")


# code, canonical name, tier; the last four only a table of the caller's knows, which also has SYR
MORE_CODES = [*CODES, ("SEA", "Southeast Asia", "OTHER"), ("WSB", "West Bank", "OTHER"),
              ("AFR ", "Africa", "OTHER"), ("FRA", "France", "OTHER"), ("TUR", "Turkey", "OTHER"),
              ("ZZ9", "Zed", "B"), ("NOR2", "Norway", "C")]
OWN_CODES = [("FRA", "France", None), ("TUR ", "Turkey", "OTHER"), ("SYR", "Elsewhere", "C"),
             ("ZZ9", "Zed", "B"), ("NOR2", "Norway", None), ("SEA", "Sea", "A"), (None, "x", "A")]


@query("code_systems", f"""SELECT c_custkey, {_pick_sql([n[1] for n in MORE_CODES])} AS country_std,
 {_pick_sql([n[2] for n in MORE_CODES])} AS "group" FROM customer""")
def code_systems(spark, sf):
    """ISO-3, FIPS and names, media codes, and a table of the caller's; the first to know counts."""
    own = spark.createDataFrame(OWN_CODES, "code string, canonical string, tier string")
    return entities.resolve_codes(_customers(spark, sf, code=[n[0] for n in MORE_CODES]), "code",
                                  codes=entities.code_systems(spark, own)).drop("code")


def _repaired(spark, sf):
    c = _customers(spark, sf, country_std=[n[0] for n in STORED], group=[n[1] for n in STORED])
    return entities.repair(c, before="before")


@query("canonical_repair", f"""SELECT c_custkey, {_pick_sql([n[2] for n in STORED])}
 AS country_std, {_pick_sql([n[3] for n in STORED])} AS "group" FROM customer""")
def canonical_repair(spark, sf):
    return _repaired(spark, sf).drop("before")


@query("repair_report", f"""SELECT b AS before, a AS after, COUNT(*) AS rows FROM (SELECT
 {_pick_sql([n[0] for n in STORED])} AS b, {_pick_sql([n[2] for n in STORED])} AS a
 FROM customer) WHERE a IS DISTINCT FROM b GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20""")
def repair_report(spark, sf):
    return entities.repair_report(_repaired(spark, sf), "before", top=20)


@query("membership_counts", with_cte(USERS) + """, m AS (SELECT
 COALESCE("group", 'UNKNOWN') AS tier, country_std AS entity FROM user_events)
 SELECT tier, entity, COUNT(*) AS rows,
 CAST(list_position(['A', 'B', 'C', 'OTHER', 'UNKNOWN'], tier) AS INTEGER) AS tier_rank FROM m
 GROUP BY GROUPING SETS ((tier, entity), (tier))""")
def membership_counts(spark, sf):
    return entities.membership_counts(user_events(spark, sf))


@query("unresolved_values", f"""SELECT trim(raw) AS value, COUNT(*) AS rows,
 {r('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM customer)', 'percent')}
 FROM (SELECT {_pick_sql([n[0] for n in NAMES])} AS raw FROM customer)
 WHERE trim(raw) = 'x' GROUP BY 1""")
def unresolved_values(spark, sf):
    return rounded(entities.unresolved(_capitalised(spark, sf), "raw", top=15))
