"""Composite indices whose formulas follow the sources at hand.

Which term goes into a formula is decided on the available columns while the
plan is built; the result is one lazy projection over the joined sources.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import INDEX_WEIGHTS, PERIOD
from panelrisk.functions.columns import col_or_default
from panelrisk.functions.scalars import anocracy, safe_div, zero
from panelrisk.operators.normalize import live_flags
from panelrisk.operators.rolling import escalation


def settled(c, digits=6):
    """Round in two steps, so that a decimal tie is not decided by floating noise."""
    return F.round(F.round(c, digits + 4), digits)


def weighted(terms):
    """Sum of weight * column with NULL as 0, added in the order given."""
    total = None
    for weight, c in terms:
        term = F.lit(float(weight)) * F.coalesce(c, F.lit(0.0))
        total = term if total is None else total + term
    return total


def intensity(df: DataFrame, long_z="Z_CII_90d"):
    """Weekly long-run z where known, else a mix of the annual event z-scores."""
    annual = weighted([(0.50, col_or_default(df, "total_deaths_z")),
                       (0.30, col_or_default(df, "event_count_z")),
                       (0.10, col_or_default(df, "deaths_state_z")),
                       (0.10, col_or_default(df, "deaths_onesided_z"))])
    return F.coalesce(F.col(long_z), annual) if long_z in df.columns else annual


def annual_escalation(df: DataFrame, short_z="Z_CII_7d", long_z="Z_CII_90d", fallback="esc_z",
                      guard=True):
    """Weekly short-against-long escalation where known, else the annual change z."""
    if short_z in df.columns and long_z in df.columns:
        return F.coalesce(escalation(short_z, long_z, bounded=guard), F.col(fallback))
    return F.coalesce(F.col(fallback), F.lit(0.0))


def fragility(df: DataFrame):
    """Ethnic fractions, anocracy (on the raw democracy score), corruption, military share.

    The ethnic score does not change over time, so a z-score against the
    entity's own history is 0 for it; pass a cross-entity z to make it count.
    """
    mixed = anocracy("v2x_libdem") if "v2x_libdem" in df.columns else F.lit(0.0)
    return weighted([(0.25, col_or_default(df, "al_ethnic2000_z")), (0.30, mixed),
                     (0.25, col_or_default(df, "v2x_corr_z")),
                     (0.20, col_or_default(df, "Military_Expenditure_z"))])


def economy(df: DataFrame, has_food):
    growth, prices = col_or_default(df, "GDP_Growth_z"), col_or_default(df, "Inflation_z")
    if not has_food:
        return weighted([(-0.60, growth), (0.40, prices)])
    return weighted([(-0.40, growth), (0.25, prices),
                     (0.25, col_or_default(df, "FoodShock_z")),
                     (0.10, col_or_default(df, "food_price_index_z"))])


def spill_index(df: DataFrame, has_media, has_displaced):
    """Four weightings of neighbour spill-over, media tension and refugees."""
    media = weighted([(0.50, F.col("AvgTone_z")), (0.50, F.col("AvgGoldstein_z"))]) \
        if has_media else F.lit(0.0)
    refugees = col_or_default(df, "refugee_outflow_z")
    if "spillover_z" in df.columns:
        near = F.col("spillover_z")
        return weighted([(0.50, near), (0.25, media), (0.25, refugees)]) if has_displaced \
            else weighted([(0.60, near), (0.40, media)])
    return weighted([(0.50, media), (0.50, refugees)]) if has_displaced else media


def political(df: DataFrame, has_leaders):
    violence = col_or_default(df, "v2elintim_z")
    if not has_leaders:
        return F.coalesce(violence, F.lit(0.0))
    return weighted([(0.40, violence), (0.40, col_or_default(df, "PolitShock_z")),
                     (0.20, col_or_default(df, "irregular_change_flag_z"))])


def index_parts(df: DataFrame, sources, guard=True) -> DataFrame:
    """Six sub-indices and the auxiliary columns of the joined annual table."""
    media = bool(sources.get("gdelt"))
    parts = {"CII": intensity(df), "ESC": annual_escalation(df, guard=guard),
             "SFI": fragility(df), "Econ": economy(df, bool(sources.get("fao"))),
             "Spill": spill_index(df, media, bool(sources.get("unhcr"))),
             "Polit": political(df, bool(sources.get("reign")))}
    aux = ["Z_CII_7d", "Z_CII_90d", "regcluster", "idp_count_z", "disaster_flag_z",
           "disaster_deaths_z"]
    return df.select("country_std", "year", "group",
                     *[settled(e).alias(n) for n, e in parts.items()],
                     *[settled(F.coalesce(col_or_default(df, c), F.lit(0.0))).alias(c)
                       for c in aux])


def weighted_index(df: DataFrame, weights=INDEX_WEIGHTS, out="WRI") -> DataFrame:
    """Weighted sum of the (already rounded) sub-indices, rounded to 6."""
    return df.withColumn(out, settled(weighted([(w, F.col(c)) for c, w in weights.items()])))


def in_index_period(df: DataFrame, period=PERIOD, year="year") -> DataFrame:
    """The period filter; applied last, after lags and per-entity statistics."""
    return df if period is None else df.filter(F.col(year).between(*period))


def shock_grade(df: DataFrame, irregular_counts=False) -> DataFrame:
    """0.3 for a leader change, at least 0.7 for an election, 1.0 for an irregular change.

    The irregular flag is not reliable, so it is set to 0 unless opted in.
    """
    grade = F.greatest(F.when(F.col("leader_change_flag") == 1, 0.3).otherwise(0.0),
                       F.when(F.col("election_flag") == 1, 0.7).otherwise(0.0))
    if irregular_counts:
        return df.withColumn("PolitShock",
                             F.when(F.col("irregular_change_flag") == 1, 1.0).otherwise(grade))
    return df.withColumns({"PolitShock": grade, "irregular_change_flag": F.lit(0)})


def per_million(value, population):
    """Value per million people; unknown or zero population gives 0."""
    return F.coalesce(safe_div(value, F.nullif(population.cast("double"), F.lit(0.0))
                               / F.lit(1e6)), F.lit(0.0))


FALLBACK_COLUMNS = ["Polit", "idp_count_z"]


def weekly_features(df: DataFrame, population=None, flags=None) -> DataFrame:
    """The ten weekly F columns; a source column that is absent or all zero uses its fallback.

    ``flags`` may bring what ``live_flags`` says of FALLBACK_COLUMNS and the population.
    """
    has = set(df.columns)
    flags = flags or live_flags(df, FALLBACK_COLUMNS, [population])

    def live(c, fallback):
        return F.when(flags[c], F.col(c)).otherwise(fallback) if c in has else fallback

    raw = F.col("CII").cast("double")
    per_head = raw if population not in has else F.when(
        flags[population], per_million(raw, F.col(population))).otherwise(raw)
    violence = zero("v2elintim") if "v2elintim" in has else F.lit(0.0)
    return df.withColumns({
        "F1_CII_pc": per_head,
        "F2_Z_CII": zero("Z_CII_90d"),
        "F3_ESC": zero("ESC"),
        "F4_Anocracy": (F.coalesce(anocracy("v2x_libdem", bounded=True), F.lit(0.0))
                        if "v2x_libdem" in has else F.lit(0.0)),
        "F6_SFI": col_or_default(df, "SFI"),
        "F7_EconStress": col_or_default(df, "Econ"),
        "F9_Spillover": col_or_default(df, "spillover"),
        "F10_RegCluster": zero("regcluster"),
        "F11_PolitShock": live("Polit", violence),
        "F15_ForcedMig": live("idp_count_z", F.lit(0.0)),
    })
