"""Panel completion, fills and joins.

Operators here expect the panel grain: one row per (entity, period). An entity
then has at most one row per calendar period, so a window over one entity stays
small however many raw events that entity has.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators.ordered import keep_first

WEEK = ["week_id", "year", "week_num"]
WEEK_ORDER = ["year", "week_num"]


def series(entity="country_std", order=WEEK_ORDER):
    return Window.partitionBy(entity).orderBy(*order)


def left_star(spine: DataFrame, sources, keys=("country_std", "year")) -> DataFrame:
    """Left equi-joins of several sources onto a spine; absent ones (None) are skipped."""
    for df in sources:
        if df is not None:
            spine = spine.join(df, list(keys), "left")
    return spine


def join_static(df: DataFrame, attributes: DataFrame, columns, entity="country_std",
                order=None) -> DataFrame:
    """Attributes without a period: one row per entity, then a left join on the entity."""
    one = keep_first(attributes.select(entity, *columns), [entity], order or list(columns))
    return df.join(one, entity, "left")


def join_annual(df: DataFrame, annual: DataFrame, columns=None, entity="country_std",
                year="year") -> DataFrame:
    """Annual (or static, if it has no year) values onto each row of a finer panel.

    Several rows for a key are reduced to the first in column order.
    """
    keys = [entity, year] if year in annual.columns else [entity]
    columns = [c for c in (columns or annual.columns) if c in annual.columns and c not in keys]
    return df.join(keep_first(annual.select(*keys, *columns), keys, columns), keys, "left")


def replace_columns(df: DataFrame, other: DataFrame, columns,
                    keys=("country_std", "week_id")) -> DataFrame:
    """Take ``columns`` from ``other`` (left join on the keys), dropping existing ones."""
    columns = [c for c in columns if c in other.columns]
    one = keep_first(other.select(*keys, *columns), keys, columns)
    return df.drop(*columns).join(one, list(keys), "left")


def current_state(rows: DataFrame, states: DataFrame, state="Y", out="y_now",
                  keys=("country_std", "week_id")) -> DataFrame:
    """State of the entity in the period of each row; NULL where the panel has none."""
    known = states.select(*keys, F.col(state).alias(out))
    return rows.join(keep_first(known, keys, [out]), list(keys), "left")


def entity_tiers(df: DataFrame, entity="country_std", tier="group",
                 order=WEEK_ORDER) -> DataFrame:
    """First non-NULL tier of each entity in period order; OTHER if it has none."""
    rank = F.when(F.col(tier).isNotNull(), F.struct(*order, tier))
    return df.groupBy(entity).agg(
        F.coalesce(F.min_by(tier, rank), F.lit("OTHER")).alias(tier))


def calendar(df: DataFrame, period=WEEK, order=WEEK_ORDER) -> DataFrame:
    """One row holding the ordered array of distinct periods (bounded by the calendar).

    A timestamp is no period: its distinct values would grow with the events, so it is refused.
    """
    moments = [f.name for f in df.schema if f.name in (*period, *[c for c in order
               if isinstance(c, str)]) and f.dataType.typeName().startswith("timestamp")]
    if moments:
        raise ValueError(f"not a period, truncate it first: {moments}")
    days = df.select(F.struct(*order, *[c for c in period if c not in order]).alias("p")) \
        .distinct()
    return days.agg(F.array_sort(F.collect_list("p")).alias("periods"))


def dense_grid(df: DataFrame, entity="country_std", tier="group", period=WEEK,
               order=WEEK_ORDER) -> DataFrame:
    """Every entity at every observed period, facts joined where they exist.

    The calendar is one array value carried to each entity row and exploded
    there, so there is no join between entities and periods.
    """
    entities = entity_tiers(df, entity, tier, order)
    grid = (entities.withColumn("_p", F.explode(calendar(df, period, order).scalar()))
            .select(entity, tier, "_p.*"))
    facts = df.drop(tier, *[c for c in period if c != period[0]])
    return grid.join(facts, [entity, period[0]], "left")


def fill_constant(df: DataFrame, columns, value=0.0) -> DataFrame:
    return df.fillna(value, subset=[c for c in columns if c in df.columns])


def fill_forward(df: DataFrame, columns, default=None, entity="country_std",
                 order=WEEK_ORDER) -> DataFrame:
    """Last known value of the entity, then a constant where nothing came before."""
    back = series(entity, order).rowsBetween(Window.unboundedPreceding, 0)
    cols = {}
    for c in [c for c in columns if c in df.columns]:
        last = F.last(c, ignorenulls=True).over(back)
        cols[c] = last if default is None else F.coalesce(last, F.lit(default))
    return df.withColumns(cols)


def fill_both_ways(df: DataFrame, columns, entity="country_std", order=WEEK_ORDER) -> DataFrame:
    """Last known value, else the next known one, always within the entity."""
    w = series(entity, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back),
                                         F.first(c, ignorenulls=True).over(ahead))
                           for c in columns if c in df.columns})
