"""Ranking, threshold and calibration metrics as DataFrames.

Scores are reduced to one row per distinct score first; the cumulative counts
come from ``ordered.running_totals``, so no task holds the whole ranking, with
or without a ``by`` key and however large one key is.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import EPS
from panelrisk.functions.scalars import as_col, flag
from panelrisk.operators.ordered import join_on, running_totals


def ranking_curve(df: DataFrame, y, p, by=(), slices=None) -> DataFrame:
    """One row per distinct score: counts above or at it, precision, recall and F1."""
    counts = df.groupBy(*by, as_col(p).cast("double").alias("threshold")).agg(
        F.sum(as_col(y).cast("long")).alias("pos"),
        F.sum(1 - as_col(y).cast("long")).alias("neg"))
    c = running_totals(counts, [F.desc("threshold")], ["pos", "neg"], by, slices)
    c = c.withColumns({"tp": F.col("pos_before") + F.col("pos"),
                       "fp": F.col("neg_before") + F.col("neg")})
    c = c.withColumns({
        "precision": F.col("tp").cast("double") / (F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("pos_total"))})
    f1 = 2 * F.col("precision") * F.col("recall") \
        / (F.col("precision") + F.col("recall") + F.lit(EPS))
    return c.withColumn("f1", f1)


def pr_curve(curve: DataFrame, by=()) -> DataFrame:
    return curve.select(*by, "threshold", "precision", "recall")


def _two_classes():
    return (F.max("pos_total") > 0) & (F.max("neg_total") > 0)


def auc_ap(curve: DataFrame, by=()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; NULL with a single class."""
    below = F.col("neg_total") - F.col("neg_before") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    auc = F.try_divide(wins, (F.max("pos_total") * F.max("neg_total")).cast("double"))
    ap = F.try_divide(F.sum(F.col("precision") * F.col("pos")),
                      F.max("pos_total").cast("double"))
    return curve.groupBy(*by).agg(
        (F.max("pos_total") + F.max("neg_total")).alias("n"),
        F.max("pos_total").alias("positives"),
        F.when(_two_classes(), auc).alias("auc"), F.when(_two_classes(), ap).alias("ap"))


def best_f1_threshold(curve: DataFrame, by=()) -> DataFrame:
    """Lowest threshold among those with the highest F1; 0.5 with a single class."""
    best = F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("low")))
    return curve.groupBy(*by).agg(
        F.when(_two_classes(), best).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(_two_classes(), F.max("f1")).alias("f1"))


def best_at_precision(curve: DataFrame, floor, by=()) -> DataFrame:
    """Among thresholds with precision >= floor: highest recall, then F1, then lowest.

    All-NULL choice and 0 candidates if none qualifies or there is one class.
    """
    ok = (F.col("precision") >= floor) & (F.col("pos_total") > 0) & (F.col("neg_total") > 0)
    rank = F.when(ok, F.struct("recall", "f1", (-F.col("threshold")).alias("low")))
    row = F.when(ok, F.struct("threshold", "precision", "recall", "f1"))
    return curve.groupBy(*by).agg(F.max_by(row, rank).alias("_b"),
                                  F.count_if(ok).alias("n_candidates")) \
        .select(*by, "_b.*", "n_candidates")


def at_threshold(df: DataFrame, y, p, threshold, by=()) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and Brier score; x/0 is 0."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    hit, real = as_col(p) >= as_col(t), as_col(y) == 1
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(as_col(y).cast("double")).alias("positive_rate"),
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
        F.avg((as_col(p) - as_col(y)) * (as_col(p) - as_col(y))).alias("brier"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
                            "f1": ratio(2 * tp, 2 * tp + fp + fn),
                            "accuracy": ratio(tp + F.col("tn"), F.col("n"))})


def brier(df: DataFrame, y, p, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(as_col(p) - as_col(y), F.lit(2))).alias("brier"))


def evaluate(df: DataFrame, y, p, threshold, by=(), min_rows=1) -> DataFrame:
    """Threshold metrics plus AUC and AP, overall or per key (keys below ``min_rows`` left out)."""
    base = at_threshold(df, y, p, threshold, by).filter(F.col("n") >= min_rows)
    ranks = auc_ap(ranking_curve(df, y, p, by), by).drop("n", "positives")
    if by:
        return join_on(base, ranks, by)
    return base.withColumns({c: ranks.select(c).scalar() for c in ("auc", "ap")})


def blend_search(df: DataFrame, y, first, second, steps=20) -> DataFrame:
    """Weight of the first score with the best AUC, the smallest on ties; 0 with one class.

    Each row is scored under every weight, then ranked per weight.
    """
    alpha = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps))
    scored = df.select(as_col(y).alias("y"), as_col(first).alias("a"),
                       as_col(second).alias("b"), alpha.alias("alpha"))
    scored = scored.select("alpha", "y", (F.col("alpha") * F.col("a")
                                          + (1 - F.col("alpha")) * F.col("b")).alias("p"))
    per = auc_ap(ranking_curve(scored, "y", "p", ["alpha"]), ["alpha"])
    best = F.max_by("alpha", F.when(F.col("auc").isNotNull(),
                                    F.struct("auc", (-F.col("alpha")).alias("low"))))
    return per.agg(F.coalesce(best, F.lit(0.0)).alias("alpha"), F.max("auc").alias("auc"))


def persistence(df: DataFrame, y_now, y_future, p, threshold) -> DataFrame:
    """Current state as the forecast against the model, on rows whose state is known."""
    known = df.filter(as_col(y_now).isNotNull())
    base = at_threshold(known, y_future, as_col(y_now).cast("double"), 0.5)
    model = at_threshold(known, y_future, p, threshold)
    p_auc = auc_ap(ranking_curve(known, y_future, as_col(y_now).cast("double")))
    m_auc = auc_ap(ranking_curve(known, y_future, p))
    row = base.select(F.col("f1").alias("persistence_f1"),
                      F.col("accuracy").alias("persistence_acc"),
                      model.select("f1").scalar().alias("model_f1"),
                      p_auc.select("auc").scalar().alias("persistence_auc"),
                      m_auc.select("auc").scalar().alias("model_auc"))
    return row.withColumn("lift_auc", F.col("model_auc") - F.col("persistence_auc"))


def onset_recall(df: DataFrame, y_now, y_future, p, threshold) -> DataFrame:
    """Number of onsets and decays, and the share of onsets the model flags."""
    now, later, hit = as_col(y_now), as_col(y_future), as_col(p) >= as_col(threshold)
    onset = (now == 0) & (later == 1)
    out = df.agg(F.count_if(onset).alias("onset_n"),
                 F.count_if((now == 1) & (later == 0)).alias("decay_n"),
                 F.sum(flag(onset & hit)).alias("_hits"))
    return out.select("onset_n", "decay_n",
                      F.try_divide(F.col("_hits").cast("double"), F.col("onset_n"))
                      .alias("onset_recall"))


def stacked(df: DataFrame, entries) -> DataFrame:
    """(part, key, y, p, threshold): several evaluations of the same rows, for one ranked pass.

    ``entries`` are (part, key, y, p, threshold, condition) columns, the part a name; a row
    takes part where the condition holds. NULL keys are kept as a group.
    """
    rows = [F.when(condition, F.struct(
        F.lit(part).alias("part"), as_col(key).cast("string").alias("key"),
        as_col(y).cast("long").alias("y"), as_col(p).cast("double").alias("p"),
        as_col(threshold).cast("double").alias("threshold")))
        for part, key, y, p, threshold, condition in entries]
    return df.select(F.explode(F.array_compact(F.array(*rows))).alias("one")).select("one.*")
