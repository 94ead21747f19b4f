"""Names and codes to canonical entities and tiers.

The built-in lookup tables are fixed and below 250 rows, so they are broadcast.
A lookup table passed by the caller is joined without a hint: its size is not
known here, and the engine broadcasts it only when its statistics allow.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.fixed_values import (ALIASES, BORDERS, CORE_ENTITIES, MEDIA_PLACES, REGIONS,
                                    REPAIR_ALIASES, TIER_ORDER, code_rows)


def alias_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ALIASES, "alias string, canonical string"))


def repair_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(REPAIR_ALIASES,
                                             "alias string, canonical string"))


def tier_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(n, t) for n, t, _, _ in CORE_ENTITIES],
                                             "canonical string, tier string"))


def code_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(code_rows(),
                                             "code string, canonical string, tier string"))


def media_table(spark: SparkSession) -> DataFrame:
    """Media codes of places that are no country; their tier is OTHER."""
    return spark.createDataFrame([(c, n, "OTHER") for c, n in MEDIA_PLACES],
                                 "code string, canonical string, tier string")


def code_systems(spark: SparkSession, *more: DataFrame) -> DataFrame:
    """(code, canonical, tier) of several code systems, of which the first to know a code counts.

    ISO-3, FIPS and names come first, then the media codes, then the caller's tables in turn.
    Codes are trimmed and NULLs left out; a name without a tier is looked up among the core ones.
    """
    tables = [code_table(spark), media_table(spark), *more]
    all_rows = [t.select(F.trim("code").alias("code"), "canonical", "tier", F.lit(i).alias("system"))
                for i, t in enumerate(tables)]
    rows = all_rows[0]
    for t in all_rows[1:]:
        rows = rows.unionByName(t)
    first = rows.filter("code IS NOT NULL AND canonical IS NOT NULL").groupBy("code").agg(
        F.min_by(F.struct("canonical", "tier"), F.struct("system", "canonical", "tier")).alias("v"))
    known = _lookup(first.select("code", "v.*"), F.col("canonical"), tier_table(spark), "tier",
                    "_own")
    return known.select("code", "canonical", F.coalesce("tier", "_own", F.lit("OTHER")).alias("tier"))


def region_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        REGIONS, "canonical string, region string"))


def border_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(BORDERS, "src string, dst string, dist int"))


def _lookup(df, key, table, value, out):
    """Left lookup of ``value`` by an expression, without keeping the key."""
    k = table.columns[0]
    side = table.select(F.col(k).alias("_k"), F.col(value).alias(out))
    return df.withColumn("_key", key).join(side, F.col("_key") == F.col("_k"), "left") \
        .drop("_key", "_k")


def capitalised(c):
    """Trimmed text with the first letter upper and the rest lower; '' below two letters."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) >= 2,
                  F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))
                  ).otherwise(F.lit(""))


def canonicalise(df: DataFrame, name, out="country_std", aliases=None, fallback="keep"):
    """Alias lookup on the lower-cased, trimmed name.

    On a miss: ``keep`` returns the trimmed original (NULL stays NULL),
    ``capitalise`` a capitalised form, empty for names under two letters.
    """
    table = aliases if aliases is not None else alias_table(df.sparkSession)
    if aliases is not None:
        table = table.select(F.lower(F.trim(F.col("alias"))).alias("alias"), "canonical")
    found = _lookup(df, F.lower(F.trim(F.col(name))), table, "canonical", "_canonical")
    miss = F.trim(F.col(name)) if fallback == "keep" else capitalised(F.col(name))
    value = F.coalesce("_canonical", miss)
    return found.withColumn(out, value).drop("_canonical")


def assign_tier(df: DataFrame, entity="country_std", out="group", tiers=None, empty=None):
    """Tier of the core entities, OTHER for the rest; ``empty`` labels empty names."""
    table = tiers if tiers is not None else tier_table(df.sparkSession)
    found = _lookup(df, F.col(entity), table, "tier", "_tier")
    tier = F.coalesce("_tier", F.lit("OTHER"))
    if empty is not None:
        tier = F.when(F.coalesce(F.col(entity), F.lit("")) == "", F.lit(empty)).otherwise(tier)
    return found.withColumn(out, tier).drop("_tier")


def resolve_codes(df: DataFrame, code, entity="country_std", tier="group", codes=None):
    """ISO-3, FIPS or name to (entity, tier); unknown codes keep their text and tier ``?``.

    ``codes`` replaces the built-in table; ``code_systems`` makes one of several systems.
    """
    table = codes if codes is not None else code_table(df.sparkSession)
    side = table.select(F.col("code").alias("_k"), F.col("canonical").alias("_c"),
                        F.col("tier").alias("_t"))
    found = df.withColumn("_key", F.trim(F.col(code))) \
        .join(side, F.col("_key") == F.col("_k"), "left")
    return (found.withColumn(entity, F.coalesce("_c", "_key"))
            .withColumn(tier, F.coalesce("_t", F.lit("?"))).drop("_key", "_k", "_c", "_t"))


def repair(df: DataFrame, entity="country_std", tier="group", aliases=None, tiers=None,
           before=None):
    """Repair names of a tiered table; core names get their tier, others keep theirs."""
    table = aliases if aliases is not None else repair_table(df.sparkSession)
    tiers = tiers if tiers is not None else tier_table(df.sparkSession)
    straight = F.translate(F.trim(F.col(entity)), "’", "'")
    found = _lookup(df, F.lower(straight), table, "canonical", "_canonical")
    if before is not None:
        found = found.withColumn(before, F.col(entity))
    named = found.withColumn(entity, F.coalesce("_canonical", F.trim(F.col(entity)))) \
        .drop("_canonical")
    tiered = _lookup(named, F.col(entity), tiers, "tier", "_tier")
    old = F.col(tier) if tier in df.columns else F.lit(None).cast("string")
    return tiered.withColumn(tier, F.coalesce("_tier", old, F.lit("OTHER"))).drop("_tier")


def repair_report(repaired: DataFrame, before, top, entity="country_std") -> DataFrame:
    """Changed (before, after) pairs with row counts, first ``top`` in name order."""
    changed = repaired.filter(~F.col(before).eqNullSafe(F.col(entity)))
    return (changed.groupBy(F.col(before).alias("before"), F.col(entity).alias("after"))
            .agg(F.count(F.lit(1)).alias("rows")).orderBy("before", "after").limit(top))


def membership_counts(df: DataFrame, entity="country_std", tier="group") -> DataFrame:
    """Rows per (tier, entity) and per tier; the subtotal row has a NULL entity.

    Blank names and tiers count as UNKNOWN. Sort by tier_rank, then rows descending.
    """
    def known(c):
        return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("UNKNOWN"))
    # counted per pair first, so that only the counts go through the rollup
    counts = df.groupBy(known(tier).alias("tier"), known(entity).alias("entity")) \
        .agg(F.count(F.lit(1)).alias("n"))
    rolled = (counts.rollup("tier", "entity")
              .agg(F.sum("n").alias("rows"), F.grouping_id().alias("level"))
              .filter(F.col("level") <= 1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIER_ORDER)),
                                                F.col("tier")), F.lit(0)),
                      F.lit(len(TIER_ORDER) + 1))
    return rolled.select("tier", "entity", "rows", rank.cast("int").alias("tier_rank"))


def unresolved(df: DataFrame, name, top, tier="group", label="UNKNOWN") -> DataFrame:
    """Most frequent unresolved raw values with their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    bad = df.filter((F.col(tier) == label) & (F.trim(F.col(name)) != ""))
    return (bad.groupBy(F.trim(F.col(name)).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("percent", F.col("rows") * 100.0 / total)
            .orderBy(F.desc("rows"), "value").limit(top))


def entity_events(df: DataFrame, entity_name, entity="country_std", columns=None, order=None,
                  top=None) -> DataFrame:
    """Rows of one entity, projected, in an explicit order; all of them, or the first ``top``."""
    picked = df.filter(F.col(entity) == entity_name)
    picked = picked.select(*columns) if columns else picked
    picked = picked.orderBy(*order) if order else picked
    return picked if top is None else picked.limit(top)
