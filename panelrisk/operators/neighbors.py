"""Spatial operators: neighbour spill-over and cluster shares."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import HIGH_RISK_Z
from panelrisk.functions.scalars import flag
from panelrisk.operators.entities import border_table, region_table


def spillover(df: DataFrame, edges=None, value="CII", entity="country_std", period="week_id",
              out="spillover") -> DataFrame:
    """Sum over neighbours of value / (sqrt(distance) + 1) in the same period, 0 without any.

    Values are first reduced to one mean per (period, entity); each is then sent
    along its edges and summed per receiver, so the work is panel rows times
    degree and the sums combine map-side. ``edges`` has src, dst, dist and a row
    means that src receives from dst.
    """
    edges = edges if edges is not None else border_table(df.sparkSession)
    means = df.groupBy(period, F.col(entity).alias("dst")).agg(F.avg(value).alias("_v"))
    sent = means.join(edges.select("src", "dst", "dist"), "dst")
    received = sent.groupBy(period, F.col("src").alias(entity)).agg(
        F.sum(F.col("_v") / (F.sqrt("dist") + 1)).alias(out))
    return df.drop(out).join(received, [entity, period], "left") \
        .withColumn(out, F.coalesce(out, F.lit(0.0)))


def region_share(df: DataFrame, z="Z_CII_90d", regions=None, entity="country_std",
                 period="year", out="regcluster", threshold=HIGH_RISK_Z) -> DataFrame:
    """Share of the *other* members of an entity's region that are high risk in the period.

    Region totals minus the row itself: no self join. 0 for entities without a
    region or alone in it. Expects one row per (entity, period).
    """
    regions = regions if regions is not None else region_table(df.sparkSession)
    side = regions.select(F.col("canonical").alias(entity), F.col("region").alias("_region"))
    df = df.join(side, entity, "left").withColumn("_high", flag(F.col(z) > threshold))
    totals = (df.filter(F.col("_region").isNotNull()).groupBy("_region", period)
              .agg(F.sum("_high").alias("_highs"), F.count(F.lit(1)).alias("_members")))
    share = F.try_divide(F.col("_highs") - F.col("_high"), F.col("_members") - 1)
    return (df.join(totals, ["_region", period], "left")
            .withColumn(out, F.coalesce(F.round(share, 6), F.lit(0.0)))
            .drop("_region", "_high", "_highs", "_members"))


def tier_share(df: DataFrame, z="Z_CII_90d", tier="group", period="week_id", out="regcluster",
               threshold=HIGH_RISK_Z) -> DataFrame:
    """Share of all members of a tier, the row included, that are high risk in the period."""
    share = df.groupBy(tier, period).agg(F.avg(flag(F.col(z) > threshold)).alias(out))
    return df.drop(out).join(share, [tier, period], "left") \
        .withColumn(out, F.coalesce(out, F.lit(0.0)))
