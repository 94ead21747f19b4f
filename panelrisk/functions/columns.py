"""Decisions taken on ``df.columns`` while the plan is built (no job is run)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.fixed_values import (ENTITY_COLUMNS, HORIZON, NOT_A_FEATURE, PROFILES,
                                    YEAR_SYNONYMS)
from panelrisk.functions.scalars import iso_week, iso_year, week_label


def first_present(df: DataFrame, candidates, override=None):
    """Column to use: the override, else an exact, else a case-insensitive hit, else None."""
    if override is not None:
        if override not in df.columns:
            raise ValueError(f"column {override!r} not found in {df.columns}")
        return override
    for c in candidates:
        if c in df.columns:
            return c
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def entity_column(df: DataFrame, override=None):
    return first_present(df, ENTITY_COLUMNS, override)


def col_or_default(df: DataFrame, name, default=0.0):
    """The column if present, else a constant."""
    return F.col(name) if name in df.columns else F.lit(default)


def standardise_names(df: DataFrame) -> DataFrame:
    """Lower-case and trim all names; the first year synonym becomes ``year``."""
    names = [c.strip().lower() for c in df.columns]
    if "year" not in names:
        synonym = next((s for s in YEAR_SYNONYMS if s in names), None)
        names = ["year" if n == synonym else n for n in names]
    return df.toDF(*names)


def rename_present(df: DataFrame, mapping) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def detect_profile(df: DataFrame, profiles=PROFILES):
    """Name of the first profile whose marker columns all exist, else None."""
    present = set(df.columns)
    return next((name for name, markers, _ in profiles if present.issuperset(markers)), None)


def keep_profile(df: DataFrame, profile=None, profiles=PROFILES) -> DataFrame:
    """Select only the profile's columns that exist."""
    profile = profile or detect_profile(df, profiles)
    wanted = {name: keep for name, _, keep in profiles}.get(profile)
    return df if wanted is None else df.select(*[c for c in wanted if c in df.columns])


def numeric_features(df: DataFrame, exclude=NOT_A_FEATURE):
    """Names of the numeric columns outside the exclusion list."""
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def time_axis(df: DataFrame):
    """(order column, steps ahead for labels): weekly panels look 13 steps ahead, annual 1."""
    for name, steps in (("week_end", HORIZON), ("date", HORIZON), ("week_id", HORIZON), ("year", 1)):
        if name in df.columns:
            return name, steps
    raise KeyError("no week_end, date, week_id or year column")


def drop_null_keys(df: DataFrame, keys) -> DataFrame:
    """Rows whose key columns are all there."""
    return df.dropna(subset=list(keys))


def null_key_counts(df: DataFrame, keys) -> DataFrame:
    """One row: all rows, rows that ``drop_null_keys`` leaves out, and NULLs per key."""
    missing = [F.col(k).isNull() for k in keys]
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(reduce(lambda a, b: a | b, missing)).alias("dropped"),
                  *[F.count_if(m).alias(f"null_{k}") for k, m in zip(keys, missing)])


def with_year(df: DataFrame) -> DataFrame:
    """Add ``year`` from a week label or an event date if it is missing."""
    if "year" in df.columns:
        return df
    source = first_present(df, ["week", "event_date", "SQLDATE"])
    if source is None:
        raise ValueError("no year, week, event_date or SQLDATE column")
    return df.withColumn("year", F.substring(F.col(source).cast("string"), 1, 4).try_cast("int"))


def with_week(df: DataFrame, time=None) -> DataFrame:
    """Add ISO ``year``, ``week_num`` and ``week_id`` from a time column.

    Text may be ``YYYY-WW``, ``YYYY-Www`` or a date; each row is judged by itself.
    """
    time = first_present(df, ["week", "event_date"], time)
    if isinstance(df.schema[time].dataType, T.StringType):
        text = F.trim(F.col(time))
        is_label = text.rlike(r"^\d{4}-[Ww]?\d{1,2}$")
        day = F.when(~is_label, text).try_cast("date")
        year = F.when(is_label, F.substring(text, 1, 4).try_cast("int")).otherwise(iso_year(day))
        week = F.when(is_label, F.regexp_extract(text, r"(\d{1,2})$", 1).try_cast("int")) \
            .otherwise(iso_week(day))
    else:
        day = F.to_date(F.col(time))
        year, week = iso_year(day), iso_week(day)
    return (df.withColumns({"year": year, "week_num": week})
            .withColumn("week_id", week_label("year", "week_num")))


def in_period(df: DataFrame, year="year", low=None, high=None) -> DataFrame:
    """Keep rows whose (tolerantly parsed) year lies in the range; open ends allowed."""
    y = F.col(year).try_cast("int")
    if low is not None:
        df = df.filter(y >= low)
    return df if high is None else df.filter(y <= high)
