"""Each entity against its own history: guarded z-scores and their health check."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.fixed_values import SIGMA_FLOOR, Z_LIMIT
from panelrisk.functions.scalars import clip, null_if_nan, zero
from panelrisk.operators.ordered import join_checked, unpivot


def _guarded(x, mu, sd, digits=6):
    z = (x - mu) / sd
    z = clip(F.round(z, digits) if digits is not None else z, -Z_LIMIT, Z_LIMIT)
    return F.when(x.isNull() | sd.isNull() | (sd < SIGMA_FLOOR), F.lit(0.0)).otherwise(z)


def zscores(df: DataFrame, columns, entity="country_std", grain="panel",
            suffix="_z") -> DataFrame:
    """Population z-score per entity: NULL and flat series give 0, rounded to 6, within +-8.

    ``grain="panel"`` (one row per entity and period) uses one window for all
    columns. ``grain="rows"`` is for raw event rows, where one entity may hold
    a large part of the table: the statistics come from a map-side combined
    aggregate and are joined back (broadcast while small, see ``join_checked``),
    so no task sees a whole entity.
    """
    values = {c: null_if_nan(c) for c in columns}
    if grain == "panel":
        w = Window.partitionBy(entity)
        mu = {c: F.avg(v).over(w) for c, v in values.items()}
        sd = {c: F.stddev_pop(v).over(w) for c, v in values.items()}
        return df.select("*", *[_guarded(values[c], mu[c], sd[c]).alias(f"{c}{suffix}")
                                for c in columns])
    stats = df.groupBy(entity).agg(*[F.avg(v).alias(f"_mu_{c}") for c, v in values.items()],
                                   *[F.stddev_pop(v).alias(f"_sd_{c}")
                                     for c, v in values.items()])
    joined = join_checked(df, stats, [entity])
    return joined.select(*df.columns, *[
        _guarded(values[c], F.col(f"_mu_{c}"), F.col(f"_sd_{c}")).alias(f"{c}{suffix}")
        for c in columns])


def is_live(df: DataFrame, column):
    """One-value subquery: does the column hold any non-zero value?"""
    return df.agg(F.coalesce(F.max((zero(column) != 0).cast("int")), F.lit(0))
                  .alias("live")).scalar() == 1


def live_flags(df: DataFrame, columns, known=()) -> dict:
    """Whether each column holds any non-zero value, and for ``known`` any value at all.

    All flags come from one aggregate of one row; column -> Column. Absent columns are left out.
    """
    live = [c for c in columns if c in df.columns]
    known = [c for c in known if c in df.columns]
    if not live and not known:
        return {}
    one = df.agg(F.struct(
        *[F.coalesce(F.max(zero(c) != 0), F.lit(False)).alias(c) for c in live],
        *[F.coalesce(F.max(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in known])
        .alias("flags")).scalar()
    return {c: one[c] for c in [*live, *known]}


def ensure_z(df: DataFrame, source, out, entity="country_std", live=None) -> DataFrame:
    """``out`` if it is present and not all zero, else the sample z-score of ``source``.

    ``live`` may bring the answer of ``live_flags``.
    """
    w = Window.partitionBy(entity)
    x = null_if_nan(source)
    sd = F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    z = F.when(sd < SIGMA_FLOOR, F.lit(0.0)).otherwise(
        clip((x - F.avg(x).over(w)) / sd, -Z_LIMIT, Z_LIMIT))
    if out not in df.columns:
        return df.withColumn(out, z)
    return df.withColumn(out, F.when(is_live(df, out) if live is None else live, F.col(out)).otherwise(z))


def health_check(df: DataFrame, z_columns, entity="country_std") -> DataFrame:
    """Per z column: range, mean |entity mean|, mean entity sigma, and whether it looks sound."""
    per = unpivot(df, z_columns, [entity]).groupBy(entity, "variable").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    out = per.groupBy("variable").agg(
        F.min("lo").alias("z_min"), F.max("hi").alias("z_max"),
        F.round(F.avg(F.abs("m")), 4).alias("mean_abs_mu"),
        F.round(F.avg(F.when(F.col("s") > 0, F.col("s"))), 4).alias("mean_sigma"))
    beyond = (F.abs("z_min") > Z_LIMIT + 1e-6) | (F.abs("z_max") > Z_LIMIT + 1e-6)
    odd = F.coalesce((F.col("mean_sigma") > 3) | (F.col("mean_sigma") < 0.1), F.lit(False))
    return out.withColumn("status", F.when(beyond, "out of bounds")
                          .when(odd, "odd sigma").otherwise("ok"))
