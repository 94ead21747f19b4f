"""Event tables to annual, weekly and daily panels.

All of these are hash aggregates with map-side combine: a hot entity is reduced
to one partial row per task and key before anything is shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import (CODED_KINDS, DISPLACEMENT_NAMES, EPS, LATITUDE_COLUMNS,
                                    LONGITUDE_COLUMNS, NONSTATE_KINDS, ONESIDED_KINDS,
                                    STATE_KINDS)
from panelrisk.functions.columns import first_present, rename_present
from panelrisk.functions.scalars import (active_month_of_week, day_number, flag, grid_cell,
                                         log_count, non_negative, number, week_label,
                                         year_of_text)

NAMED_KINDS = {"state": STATE_KINDS, "nonstate": NONSTATE_KINDS, "onesided": ONESIDED_KINDS}


def known_tier(tier="group"):
    return F.coalesce(F.col(tier), F.lit("OTHER"))


def _is(kind, codes):
    return F.col(kind).isin(list(codes) if isinstance(codes, (list, tuple)) else [codes])


def distinct_months(month):
    """Number of distinct months as a 12-bit mask: no second distinct shuffle."""
    bit = F.call_function("shiftleft", F.lit(1), month.cast("int") - 1)
    return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long")


def month_expression(df: DataFrame):
    """Month of an event from a date column, else from a week label, else None."""
    date = first_present(df, ["date_start", "event_date"])
    if date is not None:
        return F.month(F.col(date).try_cast("date"))
    week = first_present(df, ["week"])
    if week is None:
        return None
    # YYYY-WW, YYYY-Www, or a full date
    text = F.trim(F.col(week).cast("string"))
    day = F.when(F.length(text) > 8, text).try_cast("date")
    number_of = F.regexp_extract(text, r"(\d{1,2})$", 1).try_cast("int")
    return F.coalesce(F.month(day), active_month_of_week(number_of))


def annual_rollup(df: DataFrame, value, kind, kinds, entity="country_std", year="year",
                  tier="group", month=None) -> DataFrame:
    """Events to (year, entity, tier): counts, totals, per-kind sums and counts, active months.

    One row per entity-year whatever the tiers of its events: the smallest counts, NULL
    being OTHER.
    """
    aggs = [F.count(F.lit(1)).alias("event_count"),
            F.coalesce(F.sum(value), F.lit(0)).alias("total_deaths")]
    aggs += [F.coalesce(F.sum(F.when(_is(kind, codes), F.col(value)).otherwise(0)), F.lit(0))
             .alias(f"deaths_{name}") for name, codes in kinds.items()]
    aggs += [F.count_if(_is(kind, codes)).alias(f"events_{name}")
             for name, codes in kinds.items()]
    month = month_expression(df) if month is None else month
    aggs.append((distinct_months(month) if month is not None else F.lit(None).cast("long"))
                .alias("active_months"))
    return df.groupBy(F.col(year).alias("year"), F.col(entity).alias("country_std")) \
        .agg(F.min(known_tier(tier)).alias("group"), *aggs)


def annual_coded(df: DataFrame, value="best", kind="type_of_violence", **names) -> DataFrame:
    return annual_rollup(df, value, kind, CODED_KINDS, **names)


def annual_named(df: DataFrame, value="fatalities", kind="event_type", **names) -> DataFrame:
    return annual_rollup(df, value, kind, NAMED_KINDS, **names)


def weekly_rollup(df: DataFrame, value="fatalities", kind="event_type", entity="country_std",
                  tier="group", lat=None, lon=None) -> DataFrame:
    """Events with year and week_num to (entity, week): totals, kinds, spread.

    Spread is the number of distinct coordinate pairs at two decimals, 0 without
    coordinates. One row per entity-week whatever the tiers of its events: the smallest
    counts, NULL being OTHER. The week label is made from the grouped numbers, not per event.
    """
    lat = first_present(df, LATITUDE_COLUMNS, lat)
    lon = first_present(df, LONGITUDE_COLUMNS, lon)
    spread = F.lit(0).cast("long")
    if lat and lon:
        spread = F.count_distinct(F.struct(grid_cell(lat), grid_cell(lon)))
    out = df.groupBy(F.col(entity).alias("country_std"), "year", "week_num").agg(
        F.min(known_tier(tier)).alias("group"),
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum(value), F.lit(0)).alias("weekly_fatalities"),
        F.count_if(_is(kind, STATE_KINDS)).alias("battle_count"),
        F.count_if(_is(kind, ONESIDED_KINDS)).alias("vac_count"),
        F.count_if(_is(kind, NONSTATE_KINDS)).alias("nonstate_count"),
        spread.alias("geographic_spread"))
    return out.withColumn("week_id", week_label("year", "week_num"))


def with_ratios(df: DataFrame) -> DataFrame:
    total = F.col("total_events") + F.lit(EPS)
    return df.withColumns({"battle_ratio": F.col("battle_count") / total,
                           "civilian_targeting_ratio": F.col("vac_count") / total})


def consolidate_annual(df: DataFrame, names=DISPLACEMENT_NAMES, entity="country_std",
                       year="year", tier="group") -> DataFrame:
    """Sum duplicate (entity, year) rows; text numbers parsed, negatives and blanks are 0.

    The tier is the smallest non-NULL one, so that the pick does not depend on row order.
    """
    present = [c for c in names if c in df.columns]
    typed = df.withColumns({year: number(year).cast("int"),
                            **{c: non_negative(c) for c in present}}).dropna(subset=[year])
    out = typed.groupBy(year, entity).agg(
        F.min(tier).alias(tier), *[F.sum(c).alias(c) for c in present])
    return rename_present(out, names)


def flags_to_years(df: DataFrame, flags, entity="country_std", year="year",
                   tier="group") -> DataFrame:
    """Monthly 0/1 flags to (entity, year) by maximum; output names come from ``flags``."""
    return df.groupBy(entity, year).agg(
        *[F.max(source).alias(out) for out, source in flags.items()],
        F.min(tier).alias(tier))


def media_to_years(df: DataFrame, entity=None, year=None) -> DataFrame:
    """Daily media rows to (entity, year) means; normalised columns win over raw ones."""
    entity = first_present(df, ["country_std", "ActionGeo_CountryCode"], entity)
    y = F.col(year or "year") if (year or "year") in df.columns else year_of_text("SQLDATE")
    tone = first_present(df, ["AvgTone_z", "AvgTone"])
    stability = first_present(df, ["AvgGoldstein_z", "AvgGoldstein"])
    return df.groupBy(F.col(entity).alias("country_std"), y.alias("year")).agg(
        F.avg(tone).alias("AvgTone_z"), F.avg(stability).alias("AvgGoldstein_z"))


def weekly_to_years(df: DataFrame, means, entity="country_std", year="year") -> DataFrame:
    """(entity, year) means of weekly columns; ``means`` maps output to source."""
    return df.groupBy(entity, year).agg(*[F.avg(src).alias(out) for out, src in means.items()])


def media_daily(df: DataFrame, time, entity, code, stability, tone, mentions, sources,
                articles) -> DataFrame:
    """Sub-daily media rows to (day, entity, code): mean signal, summed volumes.

    Rows without a readable day or an entity are left out.
    """
    known = day_number(time).isNotNull() & F.col(entity).isNotNull()
    return df.filter(known).groupBy(day_number(time).alias("SQLDATE"),
                      F.col(entity).alias("ActionGeo_CountryCode"),
                      F.col(code).alias("EventCode")).agg(
        F.avg(stability).alias("AvgGoldstein"), F.avg(tone).alias("AvgTone"),
        F.sum(mentions).alias("TotalMentions"), F.sum(sources).alias("TotalSources"),
        F.sum(articles).alias("TotalArticles"))


def sum_by(df: DataFrame, keys, value, out) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def mean_by(df: DataFrame, keys, value, out) -> DataFrame:
    """Mean trend of a value, for example per (tier, period) or (entity, day)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def event_mix(df: DataFrame, keys, code) -> DataFrame:
    """Share of conflict codes (root >= 14) and isolation, 1 - share of co-operation (root <= 6).

    The root is the leading two digits of the code; unreadable codes are left out.
    """
    root = F.substring(F.col(code), 1, 2).try_cast("int")
    return (df.withColumn("_root", root).filter(F.col("_root").isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("events"),
                 F.avg(flag(F.col("_root") >= 14)).alias("conflict_share"),
                 (1 - F.avg(flag(F.col("_root") <= 6))).alias("isolation")))


def kind_distribution(df: DataFrame, kind, value) -> DataFrame:
    return (df.groupBy(kind).agg(F.count(F.lit(1)).alias("events"),
                                 F.sum(value).alias("deaths")).orderBy(F.desc("events"), kind))


def tier_summary(df: DataFrame, sums, entity="country_std", tier="group") -> DataFrame:
    return df.groupBy(known_tier(tier).alias("tier")).agg(
        F.count_distinct(entity).alias("entities"), F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(c) for c in sums])


def label_distribution(df: DataFrame, by, label="Y") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                              F.avg(F.col(label).cast("double")).alias("positive_rate"))


def log_counts(df: DataFrame, column) -> DataFrame:
    """Replace a skewed count column by log(1 + x); unreadable rows become NULL."""
    return df.withColumn(column, log_count(column))
