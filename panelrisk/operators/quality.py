"""Data quality and exploratory statistics, all exact over the whole table."""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.columns import numeric_features
from panelrisk.functions.scalars import flag, number, zero
from panelrisk.operators.ordered import (cut_keys, exact_quantiles, global_index, join_checked,
                                         join_on, quantile_name, unpivot)

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _absent(df, c):
    """NULL, or NaN in a floating column."""
    floating = dict(df.dtypes)[c] in ("double", "float")
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def missing_matrix(df: DataFrame, columns, by="country_std") -> DataFrame:
    """Cells that are NULL or no number, per entity and variable."""
    wide = df.groupBy(by).agg(*[F.sum(flag(number(c).isNull())).alias(c) for c in columns])
    return unpivot(wide, columns, [by]).withColumn("value", F.col("value").cast("long")) \
        .withColumnRenamed("value", "missing")


def missing_ranking(df: DataFrame, top, columns=None) -> DataFrame:
    """Missing count and percentage per column, worst first; columns without NULL left out."""
    columns = columns or df.columns
    wide = df.agg(*[F.count_if(_absent(df, c)).alias(c) for c in columns],
                  F.count(F.lit(1)).alias("_n"))
    out = unpivot(wide, columns, ["_n"]).select(
        F.col("variable"), F.col("value").cast("long").alias("missing"),
        F.round(F.col("value") * 100.0 / F.col("_n"), 2).alias("percent"))
    return out.filter(F.col("missing") > 0).orderBy(F.desc("missing"), "variable").limit(top)


def impute(df: DataFrame, column, value=0.0, marker=None) -> DataFrame:
    """NULL to a constant; ``marker`` keeps a 0/1 column of what was filled."""
    if marker:
        df = df.withColumn(marker, flag(F.col(column).isNull()))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def column_profile(df: DataFrame, columns=None, approximate=False) -> DataFrame:
    """Type, share of non-NULL cells and distinct values per column.

    Distinct values are counted on two levels: a hash pair per cell is made distinct with
    map-side combine, then counted per column; rows are not repeated per column.
    ``approximate`` uses one mergeable sketch per column instead.
    """
    columns = columns or df.columns
    types = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(~_absent(df, c)).alias(f"n_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("variable"), F.lit(types[c]).alias("type"),
                     F.round(F.try_divide(F.col(f"n_{c}") * 100.0, F.col("_n")), 2)
                     .alias("filled_percent")) for c in columns]
    filled = wide.select(F.inline(F.array(*rows)))
    distinct = distinct_estimates(distinct_sketches(df, columns)) if approximate \
        else distinct_counts(df, columns)
    return filled.join(distinct, "variable", "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0).cast("long")))


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """(variable, distinct_values) of the non-NULL cells, told apart by 128 bits of hash."""
    cells = [F.when(F.col(c).isNotNull(), F.struct(
        F.lit(i).alias("i"), F.xxhash64(F.col(c)).alias("h1"),
        F.xxhash64(F.lit(i), F.col(c)).alias("h2"))) for i, c in enumerate(columns)]
    each = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    names = F.array(*[F.lit(c) for c in columns])
    return each.groupBy("i", "h1", "h2").agg(F.lit(1).alias("one")) \
        .groupBy("i").agg(F.count(F.lit(1)).alias("distinct_values")) \
        .select(F.get(names, F.col("i")).alias("variable"), "distinct_values")


def distinct_sketches(df: DataFrame, columns) -> DataFrame:
    """(variable, sketch): to be stored with an extract and merged with those of later ones."""
    wide = df.agg(*[F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c))))
                    .alias(f"s_{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"s_{i}").alias("sketch"))
        for i, c in enumerate(columns)])))


def distinct_estimates(*sketches: DataFrame) -> DataFrame:
    """(variable, distinct_values) of one or several extracts together, from their sketches."""
    return reduce(DataFrame.unionByName, sketches).groupBy("variable").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def iqr_outliers(df: DataFrame, columns, k=1.5, by=()) -> DataFrame:
    """Fences at k inter-quartile ranges, values outside and their percentage."""
    by = list(by)
    keys = [*by, "variable"]
    q = exact_quantiles(df, columns, (0.25, 0.75), by)
    iqr = F.col("q0_75") - F.col("q0_25")
    fences = q.select(*keys, (F.col("q0_25") - k * iqr).alias("low"),
                      (F.col("q0_75") + k * iqr).alias("high"))
    values = unpivot(df, columns, by).filter(F.col("value").isNotNull())
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    # low and high are constant per key, so grouping on them adds no groups
    return (join_checked(values, fences, keys, "inner").groupBy(*keys, "low", "high")
            .agg(F.count_if(outside).alias("outliers"),
                 (F.avg(flag(outside)) * 100.0).alias("percent")))


def mad_limits(df: DataFrame, column) -> DataFrame:
    """One row: n, median and scaled median absolute deviation (1.4826 * MAD)."""
    mid = exact_quantiles(df, [column], [0.5]).select("n", F.col("q0_5").alias("median"))
    away = df.select(F.abs(F.col(column).cast("double") - mid.select("median").scalar())
                     .alias("away"))
    mad = exact_quantiles(away, ["away"], [0.5]).select("q0_5").scalar()
    return mid.withColumn("scaled_mad", mad * F.lit(1.4826))


def _with_score(df, column, limits):
    scaled = limits.select("scaled_mad").scalar()
    mid = limits.select("median").scalar()
    return df.withColumn("score", F.try_divide(F.abs(F.col(column).cast("double") - mid), scaled))


def mad_outliers(df: DataFrame, column, threshold=3.0) -> DataFrame:
    """Two-sided outlier count and fences; a MAD of 0 makes outliers undetectable (NULL)."""
    lim = mad_limits(df, column)
    seen = _with_score(df.filter(F.col(column).isNotNull()), column, lim)
    count = seen.agg(F.count_if(F.col("score") > threshold).alias("c")).scalar()
    usable = F.col("scaled_mad") > 0
    reach = threshold * F.col("scaled_mad")
    return lim.select("n", "median", "scaled_mad",
                      F.when(usable, F.col("median") - reach).alias("low"),
                      F.when(usable, F.col("median") + reach).alias("high"),
                      F.when(usable, count).alias("outliers"),
                      F.when(usable, count * 100.0 / F.col("n")).alias("percent"))


def mad_outlier_rows(df: DataFrame, column, order, top, threshold=3.0) -> DataFrame:
    """The first outlier rows in an explicit order, with their modified z-score."""
    scored = _with_score(df, column, mad_limits(df, column))
    return scored.filter(F.col("score") > threshold).orderBy(*order).limit(top)


def histogram(df: DataFrame, column, bins, low=None, high=None) -> DataFrame:
    """Counts per equal-width bin with centres; empty bins are kept.

    With a given range, values outside are dropped. Without one the data range
    is used; one single value gives a range of width 1. The top edge belongs to
    the last bin.
    """
    x = F.col(column).cast("double")
    df = df.filter(x.isNotNull())
    if low is None:
        ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        lo = ends.select("lo").scalar()
        hi = F.when(ends.select("hi").scalar() == lo, lo + 1.0).otherwise(
            ends.select("hi").scalar())
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
        df = df.filter(x.between(low, high))
    width = (hi - lo) / bins
    counted = (df.select(F.least(F.lit(bins - 1), F.floor((x - lo) / width)).alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("rows")))
    axis = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return axis.join(counted, "bin", "left").select(
        "bin", (lo + F.col("bin") * width + width / 2).alias("center"),
        F.coalesce("rows", F.lit(0)).alias("rows"))


def box_summary(df: DataFrame, columns, by=()) -> DataFrame:
    """Minimum, quartiles and maximum, overall or per key."""
    q = exact_quantiles(df, columns, QUARTILES, by)
    return q.select(*by, "variable", "n", *[F.col(quantile_name(p)).alias(n) for p, n in zip(
        QUARTILES, ("minimum", "q1", "median", "q3", "maximum"))])


def describe(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per numeric column."""
    columns = columns or numeric_features(df, ())
    keys = [*by, "variable"]
    moments = unpivot(df, columns, by).groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return join_on(moments, box_summary(df, columns, by), keys)


def correlations(df: DataFrame, columns) -> DataFrame:
    """Pearson r of every column pair, from a single pass."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                    for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows)))


def strong_pairs(corr: DataFrame, at_least=0.6) -> DataFrame:
    return (corr.filter(F.abs("r") >= at_least).withColumn("r", F.round("r", 3))
            .orderBy(F.desc(F.abs("r")), "a", "b"))


def centred(df: DataFrame, columns) -> DataFrame:
    """Columns minus their overall mean, and the quadrant of the first two (1..4)."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    df = df.withColumns({f"{c}_centred": F.col(c) - means.select(c).scalar() for c in columns})
    if len(columns) < 2:
        return df
    right, up = F.col(f"{columns[0]}_centred") >= 0, F.col(f"{columns[1]}_centred") >= 0
    return df.withColumn("quadrant", F.when(right & up, 1).when(~right & up, 2)
                         .when(~right & ~up, 3).otherwise(4))


def category_codes(df: DataFrame, column, order, out="code") -> DataFrame:
    """1, 2, 3, ... per category in the order of first appearance; blank is Unknown."""
    label = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("Unknown"))
    first = df.groupBy(label.alias("category")).agg(F.min(F.struct(*order)).alias("_at"))
    codes = global_index(first, ["_at", "category"], "_i") \
        .select("category", (F.col("_i") + 1).alias(out))
    return df.withColumn("category", label).join(codes, "category", "left")


def live_counts(df: DataFrame, columns) -> DataFrame:
    """Non-zero rows per column and all rows."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(zero(c) != 0).alias(c) for c in columns])
    return unpivot(wide, columns, ["rows"]).select(
        "variable", F.col("value").cast("long").alias("nonzero"), "rows")


def period_report(df: DataFrame, year, low, high=None) -> DataFrame:
    """Rows inside the period, outside it, and with an unreadable year."""
    y = F.col(year).try_cast("int")
    inside = y >= low if high is None else y.between(low, high)
    return df.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("outside"),
                  F.count_if(y.isNull()).alias("unreadable"))


def unreadable(df: DataFrame, columns) -> DataFrame:
    """Cells that hold text which is no number, per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias(c)
                    for c in columns])
    return unpivot(wide, columns).select("variable", F.col("value").cast("long").alias("rows"))


def preview(df: DataFrame, rows=3, order=None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(rows)


def valid_coordinates(df: DataFrame, lat, lon) -> DataFrame:
    return df.filter((F.col(lat) != 0) & (F.col(lon) != 0))


def top_rows(df: DataFrame, metric, k, columns, ties) -> DataFrame:
    """The k rows with the highest metric; ``ties`` decide equal ones."""
    return df.select(*columns).orderBy(F.desc(metric), *ties).limit(k)


def systematic_sample(df: DataFrame, order, max_rows=100_000) -> DataFrame:
    """Every n-th row of a global order, n = rows div max_rows (at least 1).

    ``order`` names columns that together are unique. Only they are put in order; the rows at
    the wanted positions, fewer than twice ``max_rows``, are then looked up by them.
    """
    picked = cut_keys(df, order, lambda i, total: i % F.greatest(
        F.lit(1), F.floor(total / max_rows)) == 0)
    return join_checked(df, picked, list(order), "inner", limit=2 * max_rows)


def capped_sample(df: DataFrame, key, rows=50_000, seed=42) -> DataFrame:
    """At most ``rows`` rows, picked by the hash of a unique key; the same on every run."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(rows).drop("_h")
