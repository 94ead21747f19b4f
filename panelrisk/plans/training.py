"""Entry points: feature panel to windows, two learners, blend, thresholds, folds and reports."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import metrics, models, panel, sequences
from panelrisk.operators.ordered import keep_first
from panelrisk.session import pin

MODELS = ("trees", "sequence", "ensemble")
#: Fields of a model's metrics, in this order.
MEASURES = ("n", "positive_rate", "auc", "ap", "f1", "precision", "recall", "accuracy", "brier",
            "tp", "fp", "fn", "tn", "threshold")


def window_table(features: DataFrame, columns=None, label="Y") -> DataFrame:
    """Windows with ordered steps ``X``, flat statistics, label and time split."""
    columns = columns or sequences.window_features(features)
    return sequences.assign_split(sequences.window_stats(features, columns, label, steps=True))


def flat_names(columns):
    return [f"{c}__{s}" for c in columns for s in ("last", "mean", "trend")]


def _fit(table: DataFrame, columns, iterations, sequence="linear"):
    """Both learners on the training rows, and the standardiser; the table has the split flags.

    ``sequence`` is the learner of the ordered window: linear or perceptron.
    """
    flat = flat_names(columns)
    rows = models.class_weights(table.filter("is_train or is_val"), counted="is_train")
    trees = models.fit_trees(rows, flat, validation="is_val", iterations=iterations)
    stats = models.standardiser(table.filter("is_train"), "X", len(columns)).first()
    ready = models.standardise(table, stats["mean"], stats["sigma"])
    own = ready.filter("is_train")
    if sequence == "perceptron":
        return trees, models.fit_perceptron(own), stats
    if sequence != "linear":
        raise ValueError(f"unknown sequence learner {sequence!r}")
    return trees, models.fit_linear(models.class_weights(own)), stats


def _score(table, trees, linear, stats) -> DataFrame:
    ready = models.standardise(table, stats["mean"], stats["sigma"])
    return models.score(linear, models.score(trees, ready, "p_trees"), "p_sequence",
                        steps="Z").drop("Z")


def _with_context(table, context):
    """Add the current state ``y_now`` and the tier ``group`` from the weekly panel, if given."""
    if context is None:
        return table.withColumns({"y_now": F.lit(None).cast("long"),
                                  "group": F.lit(None).cast("string")})
    rows = table.drop("y_now", "group").withColumn("week_id", F.col("week_end"))
    rows = panel.current_state(rows, context).drop("week_id")
    tier = F.lit(None).cast("string")
    tiers = context.select("country_std", (F.col("group") if "group" in context.columns else tier)
                           .alias("group")).filter("group IS NOT NULL")
    return rows.join(keep_first(tiers, ["country_std"], ["group"]), "country_std", "left")


def _by_part(rows):
    return {r["part"]: r for r in rows}


def train(table: DataFrame, columns, folder=None, iterations=300, context=None,
          sequence="linear"):
    """Fit both learners, search the blend, pick threshold and final model.

    Returns (scored rows, report). The report is one nested row: blend weight, thresholds and
    final choice, test metrics of the three models and the final one, split counts and
    diagnostics. ``context`` (the weekly panel with country_std, week_id, Y and, if known,
    group) gives the state at the window's end for the persistence baseline, onset recall and
    tiers; without it these count no rows. With ``folder`` the models and their metadata are
    stored there.
    """
    spark = table.sparkSession
    if table.filter("Y < 0").limit(1).count():
        raise ValueError("unlabelled windows cannot be trained on")
    table = pin(sequences.resolve_splits(table))
    trees, linear, stats = _fit(table, columns, iterations, sequence)
    scored = pin(_with_context(_score(table, trees, linear, stats), context))

    best = metrics.blend_search(scored.filter("is_val"), "Y", "p_trees", "p_sequence").first()
    alpha = float(best["alpha"])
    scored = scored.withColumn("p_ensemble", models.blend("p_trees", "p_sequence", alpha))
    # thresholds of the three models from one ranking of the validation rows
    val = metrics.stacked(scored.filter("is_val"), [
        (m, F.lit(None), "Y", f"p_{m}", F.lit(None), F.lit(True)) for m in MODELS])
    cuts = {m: 0.5 for m in MODELS}
    cuts.update({r["part"]: float(r["threshold"]) for r in metrics.best_f1_threshold(
        metrics.ranking_curve(val, "y", "p", ["part"]), ["part"]).collect()})
    test = scored.filter("is_test")
    ranked = _by_part(metrics.evaluate(metrics.stacked(test, [
        (m, F.lit(None), "Y", f"p_{m}", F.lit(cuts[m]), F.lit(True)) for m in MODELS]),
        "y", "p", F.col("threshold"), ["part"]).collect())

    row = spark.createDataFrame([(alpha, *(
        ranked[m][k] if m in ranked else None for m in MODELS for k in ("auc", "ap")))],
        "alpha double, " + ", ".join(f"{k}_{m} double" for m in MODELS for k in ("auc", "ap")))
    choice = models.choose_final(row).first()
    cut = cuts[choice["final_model"]]
    scored = scored.withColumn("p_conflict", models.final_score(choice)).withColumns({
        "threshold": F.lit(cut), "pred": (F.col("p_conflict") >= cut).cast("int")})
    report = _report(scored, choice, best["auc"], cuts, ranked, columns, folder)
    if folder:
        names = trees.stages[0].labels
        meta = report.select(
            "final_model", "final_model_reason", "alpha", "threshold",
            F.array(*map(F.lit, columns)).alias("columns"),
            F.array(*map(F.lit, flat_names(columns))).alias("features"),
            F.lit(list(names)).alias("countries"), "n_countries", "n_features",
            F.array(*map(F.lit, stats["mean"])).alias("mean"),
            F.array(*map(F.lit, stats["sigma"])).alias("sigma"))
        models.save(folder, trees, linear, meta)
    return scored, report


def _measures(row, threshold):
    values = {} if row is None else {**row.asDict(), "threshold": threshold}
    return F.struct(*[F.lit(values.get(c)).cast(
        "long" if c in ("n", "tp", "fp", "fn", "tn") else "double").alias(c) for c in MEASURES])


def _report(scored, choice, val_auc, cuts, ranked, columns, folder) -> DataFrame:
    """The nested report; everything about the final model comes from one ranking of the test rows."""
    spark, cut = scored.sparkSession, cuts[choice["final_model"]]
    test = scored.filter("is_test")
    known = F.col("y_now").isNotNull()
    no, yes = F.lit(None), F.lit(True)
    found = metrics.evaluate(metrics.stacked(test, [
        ("final", no, "Y", "p_conflict", F.lit(cut), yes),
        ("known", no, "Y", "p_conflict", F.lit(cut), known),
        ("persistence", no, "Y", "y_now", F.lit(0.5), known),
        ("tier", "group", "Y", "p_conflict", F.lit(cut), F.col("group").isNotNull())]),
        "y", "p", F.col("threshold"), ["part", "key"]).collect()
    final = _by_part(r for r in found if r["part"] != "tier")
    tiers = sorted((r for r in found if r["part"] == "tier"), key=lambda r: r["key"])
    sizes = scored.agg(F.count_if("is_train").alias("train"), F.count_if("is_val").alias("val"),
                       F.count_if("is_test").alias("test"),
                       F.count_distinct("country_std").alias("countries")).first()
    onsets = metrics.onset_recall(test.filter(known), "y_now", "Y", "p_conflict",
                                  F.lit(cut)).first()

    def pick(part, name):
        return F.lit(final[part][name] if part in final else None).cast("double")

    by_group = F.array(*[F.struct(
        F.lit(r["key"]).alias("group"), F.lit(r["n"]).cast("long").alias("n"),
        F.lit(r["positive_rate"]).cast("double").alias("base_rate"),
        F.lit(r["auc"]).cast("double").alias("auc"),
        F.lit(r["f1"] if r["auc"] is not None else None).cast("double").alias("f1"))
        for r in tiers]).cast("array<struct<group:string,n:bigint,base_rate:double,auc:double,"
                              "f1:double>>")
    diagnostics = F.struct(
        pick("persistence", "auc").alias("persistence_auc"),
        pick("persistence", "f1").alias("persistence_f1"),
        pick("persistence", "accuracy").alias("persistence_acc"),
        pick("known", "auc").alias("model_auc_valid"), pick("known", "f1").alias("model_f1_valid"),
        (pick("known", "auc") - pick("persistence", "auc")).alias("lift_auc"),
        F.lit(onsets["onset_n"]).cast("long").alias("onset_n"),
        F.lit(onsets["decay_n"]).cast("long").alias("decay_n"),
        F.lit(onsets["onset_recall"]).cast("double").alias("onset_recall"),
        by_group.alias("by_group"))
    return spark.range(1).select(
        F.lit(choice["alpha"]).alias("alpha"), F.lit(val_auc).cast("double").alias("val_auc"),
        F.lit(cuts["ensemble"]).alias("ensemble_threshold"),
        F.lit(choice["final_model"]).alias("final_model"),
        F.lit(choice["final_reason"]).alias("final_model_reason"), F.lit(cut).alias("threshold"),
        F.lit(sizes["countries"]).cast("long").alias("n_countries"),
        F.lit(len(columns)).alias("n_features"),
        F.array(*map(F.lit, columns)).alias("features"),
        F.struct(*[_measures(ranked.get(m), cuts[m]).alias(m) for m in MODELS]).alias("test"),
        _measures(final.get("final"), cut).alias("final_test"), diagnostics.alias("diagnostics"),
        F.struct(*[F.lit(sizes[k]).cast("long").alias(k) for k in ("train", "val", "test")])
        .alias("split_counts"), F.lit(folder).cast("string").alias("model_artifacts"))


def cross_validate(table: DataFrame, columns, parts=4, order=("week_end", "country_std"),
                   iterations=80, context=None, sequence="linear", strict=True):
    """Expanding folds in time order: train on the blocks before, score the next one.

    Returns (out-of-fold rows, metrics). Folds are fitted side by side over one written
    table; scores are blended by tier. A fold whose training rows have one class is left out.
    Where that leaves no fold, it is an error, or without ``strict`` there are no rows.
    Metrics are one row per fold: n, auc, f1, precision, recall and brier at the threshold with
    the best F1; with one class in the scored block auc is 0.5, the threshold 0.5, and f1,
    precision and recall are 0.
    """
    if table.filter("Y < 0").limit(1).count():
        raise ValueError("unlabelled windows cannot be trained on")
    table = pin(sequences.time_blocks(_with_context(table, context), list(order), parts))
    classes = {r["block"]: (r["low"], r["high"]) for r in table.groupBy("block").agg(
        F.min("Y").alias("low"), F.max("Y").alias("high")).collect()}
    folds = [k for k in range(1, parts) if k in classes and len(
        {y for b, ends in classes.items() if b < k for y in ends}) > 1]

    def one(fold):
        own, late = sequences.expanding_fold(table, fold)
        flags = {"is_train": F.lit(True), "is_val": F.lit(False)}
        trees, linear, stats = _fit(own.withColumns(flags), columns, iterations, sequence)
        return pin(_score(late, trees, linear, stats).withColumn("fold", F.lit(fold)))

    if folds:
        with ThreadPoolExecutor(len(folds)) as pool:
            scored = list(pool.map(inheritable_thread_target(table.sparkSession)(one), folds))
        rows = scored[0]
        for more in scored[1:]:
            rows = rows.unionByName(more)
    elif strict:
        raise ValueError("no fold has both classes to train on")
    else:
        unknown = F.lit(None).cast("double")
        rows = table.filter(F.lit(False)).withColumns(
            {"p_trees": unknown, "p_sequence": unknown, "fold": F.lit(0)})
    rows = rows.withColumn("p_ensemble", models.blend("p_trees", "p_sequence",
                                                      models.tier_alpha("group")))
    cut = metrics.best_f1_threshold(metrics.ranking_curve(rows, "Y", "p_ensemble", ["fold"]),
                                    ["fold"]).select("fold", "threshold")
    # one row per fold
    at = metrics.evaluate(rows.join(F.broadcast(cut), "fold"), "Y", "p_ensemble",
                          F.col("threshold"), ["fold"]).join(F.broadcast(cut), "fold")
    both = F.col("auc").isNotNull()
    return rows, at.select(
        "fold", "n", F.coalesce("auc", F.lit(0.5)).alias("auc"), "threshold",
        *[F.when(both, F.col(c)).otherwise(0.0).alias(c) for c in ("f1", "precision", "recall")],
        "brier")


def evaluate_saved(spark, folder, table, split="all", start=None, end=None, floor=None):
    """Predictions of a saved model, overall metrics, and metrics per entity.

    With ``floor`` the threshold is chosen on the validation split so that
    precision reaches it.
    """
    cut = None
    if floor is not None:
        val = pin(models.predict_saved(spark, folder, table, "val"))
        best = metrics.best_at_precision(
            metrics.ranking_curve(val, "y_true", "p_conflict"), floor).first()
        if not best["n_candidates"]:
            raise ValueError(f"no validation threshold reaches precision {floor}")
        cut = best["threshold"]
    # read by every metric below, so scored once
    rows = pin(models.predict_saved(spark, folder, table, split, start, end, cut))
    overall = metrics.evaluate(rows, "y_true", "p_conflict", F.col("threshold"))
    each = metrics.evaluate(rows, "y_true", "p_conflict", F.col("threshold"), ["country_std"],
                            min_rows=2)
    return rows, overall, each
