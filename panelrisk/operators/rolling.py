"""Time-series columns over the panel grain (see ``panel``): one sort per entity
serves all of them, frames are at most a calendar long."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.fixed_values import (ACTIVE_INDEX, EPS, LAG_FAR, LAG_NEAR, MA_LONG, MA_SHORT,
                                    SIGMA_FLOOR, Z_LIMIT)
from panelrisk.functions.scalars import clip, flag, number, relative_gap, safe_div
from panelrisk.operators.panel import WEEK_ORDER, series


def trailing_mean(column, rows, entity="country_std", order=WEEK_ORDER):
    """Mean of the last ``rows`` rows including this one; shorter at the start."""
    return F.avg(column).over(series(entity, order).rowsBetween(-(rows - 1), 0))


def rolling_means(df: DataFrame, means, entity="country_std", order=WEEK_ORDER) -> DataFrame:
    """Several trailing means; ``means`` maps output to (column, rows)."""
    return df.withColumns({out: trailing_mean(F.col(c).cast("double"), n, entity, order)
                           for out, (c, n) in means.items()})


def baseline_z(df: DataFrame, column, rows=MA_LONG, out="z", entity="country_std",
               order=WEEK_ORDER) -> DataFrame:
    """z of a row against the previous ``rows`` rows, sigma at least 1; 0 until they exist."""
    w = series(entity, order)
    before = w.rowsBetween(-rows, -1)
    z = (F.col(column) - F.avg(column).over(before)) \
        / F.greatest(F.stddev_pop(column).over(before), F.lit(1.0))
    return df.withColumn(out, F.when(F.row_number().over(w) <= rows, F.lit(0.0)).otherwise(z))


def velocity(df: DataFrame, z="z", rows=MA_LONG, out="escalation", entity="country_std",
             order=WEEK_ORDER) -> DataFrame:
    """(z - previous z) / (|previous z| + 1); 0 in the first ``rows`` rows."""
    w = series(entity, order)
    prev = F.lag(z).over(w)
    return df.withColumn(out, F.when(F.row_number().over(w) <= rows, F.lit(0.0))
                         .otherwise(relative_gap(F.col(z), prev, 1.0)))


def relative_change(df: DataFrame, column, out="pct_change", entity="country_std",
                    order=("year",)) -> DataFrame:
    """(x - previous) / previous; 0 where there is no previous value or it is 0."""
    prev = F.lag(column).over(series(entity, order)).cast("double")
    return df.withColumn(out, F.coalesce(safe_div(F.col(column).cast("double") - prev, prev),
                                         F.lit(0.0)))


def change_z(df: DataFrame, column="pct_change", out="esc_z", entity="country_std",
             guard=True) -> DataFrame:
    """z of the relative change per entity, rounded to 6.

    ``guard=True`` returns 0 for flat series and bounds to +-8; ``guard=False``
    divides by sigma + 1e-8 without bounds, which explodes on flat series.
    """
    w = Window.partitionBy(entity)
    gap, sd = F.col(column) - F.avg(column).over(w), F.stddev_pop(column).over(w)
    if not guard:
        return df.withColumn(out, F.round(gap / (sd + F.lit(EPS)), 6))
    z = F.when(sd < SIGMA_FLOOR, F.lit(0.0)).otherwise(
        clip(F.round(gap / sd, 6), -Z_LIMIT, Z_LIMIT))
    return df.withColumn(out, z)


def lags(df: DataFrame, column, steps, entity="country_std", order=WEEK_ORDER) -> DataFrame:
    """Lagged values, 0 before the series starts; ``steps`` maps output to rows back."""
    w = series(entity, order)
    return df.withColumns({out: F.coalesce(F.lag(F.col(column).cast("double"), k).over(w),
                                           F.lit(0.0)) for out, k in steps.items()})


def trend_and_acceleration(df: DataFrame, short, long, trend, acceleration,
                           entity="country_std", order=WEEK_ORDER) -> DataFrame:
    """Short minus long mean, and its first difference (0 at the start)."""
    w = series(entity, order)
    df = df.withColumn(trend, F.col(short) - F.col(long))
    return df.withColumn(acceleration, F.coalesce(F.col(trend) - F.lag(trend).over(w),
                                                  F.lit(0.0)))


def weekly_series_features(df: DataFrame, entity="country_std") -> DataFrame:
    """Moving means, trend, acceleration and lagged counts of the weekly panel."""
    df = rolling_means(df, {"fatality_4w_ma": ("weekly_fatalities", MA_SHORT),
                            "fatality_12w_ma": ("weekly_fatalities", MA_LONG)}, entity)
    df = trend_and_acceleration(df, "fatality_4w_ma", "fatality_12w_ma", "fatality_trend",
                                "conflict_accel", entity)
    return lags(df, "total_events", {"event_count_lag4": LAG_NEAR,
                                     "event_count_lag8": LAG_FAR}, entity)


def escalation(short, long, bounded=True):
    """(short - long) / (|long| + eps), bounded to +-8 for the weekly panel."""
    gap = relative_gap(short, long)
    return clip(gap, -Z_LIMIT, Z_LIMIT) if bounded else gap


def state_changes(df: DataFrame, state="leader", entity="country_std",
                  order=("year", "month"), election="election_now",
                  notice="anticipation") -> DataFrame:
    """Change of state against the previous period, with or without an election.

    A NULL state after a known one is a change; a known one after NULL is not.
    """
    prev = F.lag(state).over(series(entity, order))
    def on(c):
        return flag(number(c) > 0) if c in df.columns else F.lit(0)
    df = df.withColumns({election: on(election), notice: on(notice),
                         "leader_change": flag(prev.isNotNull()
                                               & ~F.col(state).eqNullSafe(prev))})
    with_vote = (F.col("leader_change") == 1) & ((F.col(election) == 1) | (F.col(notice) == 1))
    return df.withColumns({
        "change_with_election": flag(with_vote),
        "irregular_change": flag((F.col("leader_change") == 1) & ~with_vote)})


def onset_labels(df: DataFrame, horizon, index="WRI", threshold=ACTIVE_INDEX,
                 active="is_active_conflict", entity="country_std", order=("year",),
                 out="Y") -> DataFrame:
    """1 where the entity is inactive now and active ``horizon`` rows later.

    An existing ``active`` column is used, else index > threshold (a missing
    index is inactive). Rows without a row ``horizon`` ahead are dropped.
    """
    if active not in df.columns:
        df = df.withColumn(active, flag(F.col(index) > threshold))
    ahead = F.lead(active, horizon).over(series(entity, order))
    return (df.withColumn("_ahead", ahead).filter(F.col("_ahead").isNotNull())
            .withColumn(out, flag((F.col(active) == 0) & (F.col("_ahead") == 1)))
            .drop("_ahead"))
