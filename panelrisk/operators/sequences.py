"""Sliding windows over the dense weekly panel, time splits and folds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import (HORIZON, LOOK_BACK, NOT_A_WINDOW_FEATURE, TEST_YEAR,
                                    VAL_YEAR, WINDOW_STEPS, WINDOW_STRIDE)
from panelrisk.functions.columns import numeric_features
from panelrisk.functions.scalars import zero
from panelrisk.operators.ordered import cuts_below, global_index
from panelrisk.operators.panel import WEEK_ORDER, series


def vocabulary(df: DataFrame, entity="country_std", out="country_id") -> DataFrame:
    """Index of the sorted distinct names, from 0."""
    return global_index(df.select(entity).distinct(), [entity], out).drop(f"{out}_total")


def remap(df: DataFrame, known: DataFrame, entity="country_std", out="country_id") -> DataFrame:
    """Ids of another vocabulary by name; entities it does not know get NULL."""
    return df.drop(out).join(known.select(entity, out), entity, "left")


def window_features(df: DataFrame):
    return numeric_features(df, NOT_A_WINDOW_FEATURE)


def _ends(df, label, length, stride, horizon, entity, order):
    """Mark window ends on the stride and attach the label ``horizon`` rows later."""
    w = series(entity, order)
    rn = F.row_number().over(w)
    y = F.lead(label, horizon).over(w) if label in df.columns else F.lit(-1)
    return {"_on": (rn >= length) & ((rn - length) % stride == 0), "_y": y.cast("long")}


def _steps(features, length, entity, order):
    """Array of the last ``length`` steps, each an array of float features."""
    step = F.array(*[zero(c).cast("float") for c in features])
    frame = series(entity, order).rowsBetween(-(length - 1), 0)
    return F.collect_list(step).over(frame)


def _stats(features, length, entity, order):
    """Last value, mean, and last minus first of each feature, by column name."""
    w = series(entity, order)
    frame = w.rowsBetween(-(length - 1), 0)
    cols = {}
    for c in features:
        x = zero(c).cast("float").cast("double")
        cols[f"{c}__last"] = x
        cols[f"{c}__mean"] = F.avg(x).over(frame)
        cols[f"{c}__trend"] = x - F.lag(x, length - 1).over(w)
    return cols


def _cut(df, cols, label, length, stride, horizon, entity, order, end):
    marks = _ends(df, label, length, stride, horizon, entity, order)
    marked = df.select(entity, F.col(end).alias("week_end"),
                       *[c.alias(n) for n, c in {**cols, **marks}.items()])
    return marked.filter(F.col("_on") & F.col("_y").isNotNull()) \
        .select(entity, "week_end", *cols, F.col("_y").alias("Y"))


def windows(df: DataFrame, features=None, label="Y", length=WINDOW_STEPS, stride=WINDOW_STRIDE,
            horizon=HORIZON, entity="country_std", order=WEEK_ORDER,
            end="week_id") -> DataFrame:
    """One row per window: its end, float steps ``X`` (length x features), and label ``Y``.

    A window is kept if the label ``horizon`` rows after its end exists and is
    not NULL; without a label column Y is -1. A frame holds ``length`` rows.
    """
    features = features or window_features(df)
    return _cut(df, {"X": _steps(features, length, entity, order)}, label, length, stride,
                horizon, entity, order, end)


def window_stats(df: DataFrame, features=None, label="Y", length=WINDOW_STEPS,
                 stride=WINDOW_STRIDE, horizon=HORIZON, entity="country_std",
                 order=WEEK_ORDER, end="week_id", steps=False) -> DataFrame:
    """Same windows as flat columns: last value, mean, and last minus first per feature.

    ``steps=True`` adds the ordered steps ``X`` in the same pass.
    """
    features = features or window_features(df)
    cols = _stats(features, length, entity, order)
    if steps:
        cols["X"] = _steps(features, length, entity, order)
    return _cut(df, cols, label, length, stride, horizon, entity, order, end)


def assign_split(df: DataFrame, end="week_end", val=VAL_YEAR, test=TEST_YEAR,
                 out="split") -> DataFrame:
    """train / val / test by the year of the window end."""
    y = F.substring(F.col(end).cast("string"), 1, 4).cast("int")
    return df.withColumn(out, F.when(y >= test, "test").when(y >= val, "val")
                         .otherwise("train"))


def resolve_splits(df: DataFrame, split="split", order=("week_end", "country_std"),
                   val_part=0.2) -> DataFrame:
    """Add is_train, is_val, is_test with fallbacks.

    No test rows: the val rows are the test. No val rows: the last fifth of the
    training rows in time order validates.
    """
    seen = df.agg(F.count_if(F.col(split) == "val").alias("v"),
                  F.count_if(F.col(split) == "test").alias("t")).first()
    is_train, is_val = F.col(split) == "train", F.col(split) == "val"
    is_test = F.col(split) == "test" if seen.t else is_val
    if not seen.v:
        # val is empty: the key that cuts off the last part of the training rows
        late = cuts_below(df.filter(is_train), list(order), lambda i, total: i == F.floor(
            total * F.lit(1.0 - val_part)))[0] > 0
        is_train, is_val = is_train & ~late, is_train & late
    return df.withColumns({"is_test": is_test, "is_train": is_train, "is_val": is_val})


def look_back(df: DataFrame, features, length=LOOK_BACK, entity="country_std",
              order=("year",), label="Y") -> DataFrame:
    """The last ``length`` steps of each row, padded with zero steps in front."""
    steps = _steps(features, length, entity, order)
    zeros = F.array_repeat(F.array(*[F.lit(0.0).cast("float")] * len(features)),
                           F.lit(length) - F.size(steps))
    return df.select(entity, *order, *([label] if label in df.columns else []),
                     F.concat(zeros, steps).alias("X"))


def time_blocks(df: DataFrame, order, parts=4, out="block") -> DataFrame:
    """Equal consecutive blocks 0..parts-1 of the rows in time order; left-overs get ``parts``.

    Only the order's columns are put in order, to find the keys at which blocks begin.
    """
    def begins(i, total):
        step = F.floor(total / parts)
        return (i > 0) & (i <= step * parts) & (F.try_mod(i, step) == 0)

    block, cuts = cuts_below(df, order, begins)
    # without a cut there are fewer rows than parts, or there is one part
    return df.withColumn(out, block if cuts or parts == 1 else F.lit(parts))


def expanding_fold(df: DataFrame, fold, block="block"):
    """(train, validation) rows of fold 1..parts-1: all earlier blocks, then the next one."""
    return df.filter(F.col(block) < fold), df.filter(F.col(block) == fold)


def fold_roles(df: DataFrame, parts=4, block="block") -> DataFrame:
    """One row per (row, fold) it takes part in, with its role."""
    folds = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.struct(
        k.alias("fold"), F.when(F.col(block) < k, "train")
        .when(F.col(block) == k, "validate").alias("role")))
    return df.withColumn("_f", F.explode(folds)).select("*", "_f.*").drop("_f") \
        .filter(F.col("role").isNotNull())
