"""Entry points: events to the weekly panel, sources to the annual index, panel to features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import (CONTEXT, COUNTS, F_COLUMNS, IDS, INDEX_WEIGHTS, LABELS,
                                    NORMALISED_COLUMNS, POPULATION, ROLL_LONG, ROLL_SHORT,
                                    SERIES, SIGNALS, WEEKLY_RAW)
from panelrisk.functions.columns import drop_null_keys, numeric_features, with_week, with_year
from panelrisk.operators import composite, neighbors, panel, rolling, rollups
from panelrisk.operators.normalize import ensure_z, live_flags, zscores
from panelrisk.session import pin


def annual_panel(events: DataFrame, **names) -> DataFrame:
    """Event table to the annual panel; coded or named kinds told apart by the columns.

    Events without an entity or a year are left out (``null_key_counts`` tells how many).
    """
    events = drop_null_keys(with_year(events), [names.get("entity", "country_std"), "year"])
    cols = {c.lower() for c in events.columns}
    if {"best", "type_of_violence"} <= cols:
        return rollups.annual_coded(events, **names)
    if {"fatalities", "event_type"} <= cols:
        return rollups.annual_named(events, **names)
    raise ValueError("neither coded nor named event columns found")


def weekly_panel(events: DataFrame, edges=None, time=None, **names) -> DataFrame:
    """Event table to the weekly panel with ratios, rolling means and neighbour spill-over.

    Events without an entity or a readable week are left out (``null_key_counts`` tells how many).
    """
    # written once: the events are then scanned once, though the panel is read twice below
    keys = [names.get("entity", "country_std"), "year", "week_num"]
    weekly = pin(rollups.weekly_rollup(drop_null_keys(with_week(events, time), keys), **names))
    weekly = rollups.with_ratios(weekly)
    weekly = weekly.withColumn("CII", F.col("weekly_fatalities").cast("double"))
    weekly = rolling.rolling_means(weekly, {"CII_roll7": ("CII", ROLL_SHORT),
                                            "CII_roll90": ("CII", ROLL_LONG)})
    return neighbors.spillover(weekly, edges)


def normalised(df: DataFrame, data_set=None, columns=None, **kw) -> DataFrame:
    """Append z columns: those listed for the data set, else all numeric ones.

    The daily media set has many rows per entity and period, so its statistics are
    aggregated and joined back instead of being held in one window per entity.
    """
    if data_set == "gdelt":
        kw.setdefault("grain", "rows")
    listed = columns or NORMALISED_COLUMNS.get(data_set)
    columns = [c for c in listed if c in df.columns] if listed else numeric_features(df)
    return zscores(df, columns, **kw)


def annual_index(sources: dict, regions=None, weights=INDEX_WEIGHTS, *, period,
                 guard=True) -> DataFrame:
    """Weighted risk index per (entity, year).

    ``sources`` maps ucdp (required), qog, vdem, wb, gdelt, acled, reign, unhcr,
    fao and emdat to normalised DataFrames; missing ones are left out and the
    formulas adapt. ``period`` is the (first, last) year to return, or None for all.
    """
    spine = sources.get("ucdp")
    if spine is None:
        raise ValueError("the annual event source 'ucdp' is required")
    wanted = {"vdem": ["v2x_libdem", "v2x_corr_z", "v2elintim_z"],
              "wb": ["Military_Expenditure_z", "GDP_Growth_z", "Inflation_z"],
              "reign": ["PolitShock_z", "irregular_change_flag_z"],
              "unhcr": ["refugee_outflow_z", "idp_count_z"],
              "fao": ["FoodShock_z", "food_price_index_z"],
              "emdat": ["disaster_flag_z", "disaster_deaths_z"]}
    spine = rolling.change_z(rolling.relative_change(spine, "total_deaths",
                                                     "deaths_pct_change"),
                             "deaths_pct_change", "esc_z", guard=guard)
    joined = spine.select("country_std", "year", "group", "esc_z", *[
        c for c in ("total_deaths_z", "event_count_z", "deaths_state_z", "deaths_onesided_z")
        if c in spine.columns])
    if sources.get("qog") is not None:
        joined = panel.join_static(joined, sources["qog"], ["al_ethnic2000_z"])
    keyed = []
    for name, columns in wanted.items():
        df = sources.get(name)
        if df is not None:
            keyed.append(df.select("country_std", "year",
                                   *[c for c in columns if c in df.columns]))
    if sources.get("gdelt") is not None:
        keyed.append(rollups.media_to_years(sources["gdelt"]))
    weekly = sources.get("acled")
    if weekly is not None:
        means = {out: src for out, src in (("Z_CII_7d", "CII_roll7_z"),
                                           ("Z_CII_90d", "CII_roll90_z"),
                                           ("spillover_z", "spillover_z"))
                 if src in weekly.columns}
        if means:
            yearly = rollups.weekly_to_years(weekly, means)
            if "Z_CII_90d" in means:
                yearly = neighbors.region_share(yearly, regions=regions)
            keyed.append(yearly)
    joined = panel.left_star(joined, keyed)
    present = {k: v is not None for k, v in sources.items()}
    indexed = composite.weighted_index(composite.index_parts(joined, present, guard), weights)
    return composite.in_index_period(indexed, period)


def weekly_feature_panel(weekly: DataFrame, weekly_z=None, annual=None, governance=None,
                         economy=None) -> DataFrame:
    """Weekly panel to the dense feature matrix.

    The grid is completed before annual values are attached, so that a week
    without events takes the values of its own year.
    """
    if weekly_z is not None:
        renamed = weekly_z.withColumnsRenamed({"CII_roll7_z": "Z_CII_7d",
                                               "CII_roll90_z": "Z_CII_90d"})
        weekly = panel.replace_columns(weekly, renamed, ["Z_CII_7d", "Z_CII_90d",
                                                         "spillover_z"])
    grid = panel.fill_constant(panel.dense_grid(weekly), COUNTS, 0.0)
    for source in (annual, governance, economy):
        if source is not None:
            extra = [c for c in source.columns
                     if c in CONTEXT + LABELS + POPULATION and c not in grid.columns]
            if extra:
                grid = panel.join_annual(grid, source, extra)
    population = next((c for c in POPULATION if c in grid.columns), None)
    grid = panel.fill_forward(grid, SIGNALS, 0.0)
    grid = panel.fill_both_ways(grid, [*CONTEXT, *LABELS, *POPULATION])
    # read several times below: liveness checks, shares and the features
    grid = pin(grid)
    flags = live_flags(grid, ["Z_CII_7d", "Z_CII_90d", *composite.FALLBACK_COLUMNS], [population])
    grid = ensure_z(grid, "CII_roll7", "Z_CII_7d", live=flags.get("Z_CII_7d"))
    grid = ensure_z(grid, "CII_roll90", "Z_CII_90d", live=flags.get("Z_CII_90d"))
    grid = grid.withColumn("ESC", rolling.escalation("Z_CII_7d", "Z_CII_90d"))
    grid = neighbors.tier_share(grid)
    features = rolling.weekly_series_features(composite.weekly_features(grid, population, flags))
    extra = ["disaster_flag_z", "disaster_deaths_z", "WRI", "theta_c", "Y", "is_war_year"]
    return features.select(*IDS, *F_COLUMNS, *WEEKLY_RAW, *SERIES,
                           *[c for c in extra if c in features.columns])
