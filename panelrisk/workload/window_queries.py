"""Vocabulary, sliding windows, splits, folds and models."""

from pyspark.sql import functions as F

from panelrisk.operators import models, rollups, sequences
from panelrisk.plans import training
from panelrisk.session import pin, scratch
from panelrisk.workload.base import (COUNTS, USERS, query, r, rounded, rs, table, user_events,
                                     weekly_counts, with_cte)
from panelrisk.workload.panel_queries import _W, WEEK_LABELS, labelled_weeks

FEATURES = ["fatalities", "events"]


@query("vocabulary", with_cte(USERS) + """SELECT country_std,
 row_number() OVER (ORDER BY country_std) - 1 AS country_id
 FROM (SELECT DISTINCT country_std FROM user_events)""")
def vocabulary(spark, sf):
    return sequences.vocabulary(user_events(spark, sf))


@query("vocabulary_remap", with_cte(USERS) + """, v AS (SELECT country_std,
 row_number() OVER (ORDER BY country_std) - 1 AS country_id
 FROM (SELECT DISTINCT country_std FROM user_events WHERE "group" IS NOT NULL))
 SELECT event_id, country_id FROM user_events LEFT JOIN v USING (country_std)""")
def vocabulary_remap(spark, sf):
    u = user_events(spark, sf)
    known = sequences.vocabulary(u.filter(F.col("group").isNotNull()))
    return sequences.remap(u, known).select("event_id", "country_id")


WINDOWS = WEEK_LABELS + f""", w AS (SELECT country_std, week_id AS week_end, fatalities, events,
 row_number() OVER ({_W}) AS i, lead(Y, 13) OVER ({_W}) AS y13,
 list(fatalities) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS fs,
 list(events) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS es FROM lab),
 win AS (SELECT * FROM w WHERE i >= 13 AND (i - 13) % 4 = 0 AND y13 IS NOT NULL)"""


@query("sliding_windows", with_cte(WINDOWS) + """SELECT country_std, week_end,
 CAST(y13 AS BIGINT) AS Y, list_reduce(fs, lambda a, b: a + b) AS sum_f, fs[1] AS first_f,
 fs[13] AS last_f, es[13] AS last_e, CAST(len(fs) AS INTEGER) AS steps FROM win""")
def sliding_windows(spark, sf):
    """Windows shown by the sum and the ends of their steps."""
    w = sequences.windows(labelled_weeks(spark, sf), FEATURES)
    total = F.aggregate("X", F.lit(0.0), lambda a, s: a + s[0].cast("double"))
    return w.select("country_std", "week_end", "Y", total.alias("sum_f"),
                    F.col("X")[0][0].cast("double").alias("first_f"),
                    F.col("X")[12][0].cast("double").alias("last_f"),
                    F.col("X")[12][1].cast("double").alias("last_e"),
                    F.size("X").alias("steps"))


FLAT = WINDOWS + """, flat AS (SELECT country_std, week_end, fatalities AS fatalities__last,
 list_avg(fs) AS fatalities__mean, fs[13] - fs[1] AS fatalities__trend, events AS events__last,
 list_avg(es) AS events__mean, es[13] - es[1] AS events__trend, CAST(y13 AS BIGINT) AS Y
 FROM win)"""
FLAT_NAMES = training.flat_names(FEATURES)


@query("window_statistics", with_cte(FLAT) + f"""SELECT country_std, week_end, Y,
 {rs(FLAT_NAMES)} FROM flat""")
def window_statistics(spark, sf):
    return rounded(sequences.window_stats(labelled_weeks(spark, sf), FEATURES))


def _split(spark, sf):
    return sequences.assign_split(sequences.window_stats(labelled_weeks(spark, sf), FEATURES),
                                  val=1999, test=2000)


SPLIT = FLAT + """, sp AS (SELECT *, CASE WHEN CAST(substr(week_end, 1, 4) AS INT) >= 2000
 THEN 'test' WHEN CAST(substr(week_end, 1, 4) AS INT) >= 1999 THEN 'val' ELSE 'train' END
 AS split FROM flat)"""


@query("time_split", with_cte(SPLIT) + "SELECT country_std, week_end, split FROM sp")
def time_split(spark, sf):
    return _split(spark, sf).select("country_std", "week_end", "split")


@query("split_labels", with_cte(SPLIT) + f"""SELECT split, COUNT(*) AS n,
 {r('AVG(Y)', 'positive_rate')} FROM sp GROUP BY 1""")
def split_labels(spark, sf):
    return rounded(rollups.label_distribution(_split(spark, sf), "split"))


@query("split_fallback", with_cte(FLAT) + """, n AS (SELECT *, row_number() OVER (ORDER BY
 week_end, country_std) - 1 AS i, COUNT(*) OVER () AS t FROM flat) SELECT country_std, week_end,
 i < floor(t * 0.8) AS is_train, i >= floor(t * 0.8) AS is_val, false AS is_test FROM n""")
def split_fallback(spark, sf):
    """All windows are training rows: the last fifth in time order validates."""
    s = sequences.assign_split(sequences.window_stats(labelled_weeks(spark, sf), FEATURES))
    return sequences.resolve_splits(s).select("country_std", "week_end", "is_train", "is_val",
                                              "is_test")


@query("look_back_windows", with_cte(COUNTS) + """, y AS (SELECT country_std,
 year, week_num, CAST(SUM(weekly_fatalities) AS DOUBLE) AS f FROM counts GROUP BY ALL),
 l AS (SELECT *, list(f) OVER (PARTITION BY country_std ORDER BY year, week_num
 ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS fs FROM y)
 SELECT country_std, year, week_num, 90 AS steps, CASE WHEN len(fs) < 90 THEN 0.0 ELSE fs[1] END
 AS first_f, fs[len(fs)] AS last_f FROM l""")
def look_back_windows(spark, sf):
    y = rollups.sum_by(weekly_counts(spark, sf), ["country_std", "year", "week_num"],
                       "weekly_fatalities", "f")
    w = sequences.look_back(y, ["f"], order=["year", "week_num"])
    return w.select("country_std", "year", "week_num", F.size("X").alias("steps"),
                    F.col("X")[0][0].cast("double").alias("first_f"),
                    F.col("X")[89][0].cast("double").alias("last_f"))


BLOCKS = """SELECT o_orderkey, CAST(COALESCE(least(4, i // NULLIF(t // 4, 0)), 4) AS INTEGER)
 AS block FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i,
 COUNT(*) OVER () AS t FROM orders)"""


def _blocks(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return sequences.time_blocks(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "block")


@query("time_blocks", BLOCKS)
def time_blocks(spark, sf):
    return _blocks(spark, sf)


@query("expanding_folds", f"""SELECT f.fold, CASE WHEN b.block < f.fold THEN 'train'
 ELSE 'validate' END AS role, COUNT(*) AS rows FROM ({BLOCKS}) b
 JOIN (VALUES (1), (2), (3)) f(fold) ON b.block <= f.fold GROUP BY 1, 2""")
def expanding_folds(spark, sf):
    return sequences.fold_roles(_blocks(spark, sf)).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"))


@query("standardiser", with_cte(WINDOWS) + """, steps AS (SELECT unnest(fs) AS f,
 unnest(es) AS e FROM win) SELECT ROUND(AVG(f), 6) AS mean_f, ROUND(AVG(e), 6) AS mean_e,
 ROUND(stddev_pop(f) + 1e-8, 6) AS sigma_f, ROUND(stddev_pop(e) + 1e-8, 6) AS sigma_e
 FROM steps""")
def standardiser(spark, sf):
    s = models.standardiser(sequences.windows(labelled_weeks(spark, sf), FEATURES), "X", 2)
    return rounded(s.select(F.col("mean")[0].alias("mean_f"), F.col("mean")[1].alias("mean_e"),
                            F.col("sigma")[0].alias("sigma_f"),
                            F.col("sigma")[1].alias("sigma_e")))


def _table(spark, sf):
    """Labelled windows, written once: training reads them many times."""
    return pin(sequences.assign_split(training.window_table(labelled_weeks(spark, sf), FEATURES),
                                      val=1999, test=2000))


def _weighted(spark, sf):
    t = sequences.resolve_splits(_table(spark, sf))
    return models.class_weights(t.filter("is_train or is_val"), counted="is_train")


@query("class_weights", with_cte(SPLIT) + f"""SELECT country_std, week_end, Y, CASE WHEN Y = 1
 THEN {r('''(SELECT greatest(1, COUNT(*) FILTER (Y = 0)) / greatest(1, COUNT(*) FILTER (Y = 1))
 FROM sp WHERE split = 'train')''', 'x').rsplit(' AS ', 1)[0]} ELSE 1.0 END::DOUBLE AS weight
 FROM sp WHERE split <> 'test'""")
def class_weights(spark, sf):
    return rounded(_weighted(spark, sf).select("country_std", "week_end", "Y", "weight"))


@query("boosted_trees")
def boosted_trees(spark, sf):
    rows = _weighted(spark, sf)
    m = models.fit_trees(rows, FLAT_NAMES, validation="is_val")
    return models.score(m, rows, "p_trees").select("country_std", "week_end", "Y", "p_trees")


@query("window_classifier")
def window_classifier(spark, sf):
    rows = _weighted(spark, sf)
    s = models.standardiser(rows.filter("is_train"), "X", 2).first()
    ready = models.standardise(rows, s["mean"], s["sigma"])
    m = models.fit_linear(ready.filter("is_train"))
    return models.score(m, ready, "p_sequence", steps="Z").select("country_std", "week_end", "Y",
                                                                  "p_sequence")


@query("perceptron_facts", with_cte(SPLIT) + """, n AS (SELECT COUNT(*) FILTER (Y = 1) AS one,
 COUNT(*) FILTER (Y = 0) AS zero FROM sp WHERE split = 'train') SELECT COUNT(*) AS rows,
 COUNT(*) AS scores_in_range, (SELECT CASE WHEN least(one, zero) = 0 THEN greatest(one, zero)
 ELSE 2 * greatest(one, zero) END FROM n) AS balanced_rows FROM sp""")
def perceptron_facts(spark, sf):
    """The non-linear window learner scores every window; its classes were evened out exactly."""
    t = _table(spark, sf)
    own = t.filter("split = 'train'")
    s = models.standardiser(own, "X", 2).first()
    ready = models.standardise(t, s["mean"], s["sigma"])
    m = models.fit_perceptron(ready.filter("split = 'train'"), iterations=30)
    even = models.balanced(own).agg(F.count(F.lit(1))).first()[0]
    return models.score(m, ready, "p", steps="Z").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p").between(0, 1))
        .alias("scores_in_range"), F.lit(even).cast("long").alias("balanced_rows"))


@query("trained_ensemble")
def trained_ensemble(spark, sf):
    scored, _ = training.train(_table(spark, sf), FEATURES)
    return scored.select("country_std", "week_end", "split", "Y", "p_trees", "p_sequence",
                         "p_ensemble", "p_conflict", "pred", "threshold")


@query("training_report")
def training_report(spark, sf):
    return training.train(_table(spark, sf), FEATURES, context=_context(spark, sf))[1]


def _context(spark, sf):
    """The weekly panel with states and a tier by the entity's last digit."""
    last = F.substring("country_std", -1, 1)
    return labelled_weeks(spark, sf).select("country_std", "week_id", "Y", F.when(
        last < "4", "A").when(last < "7", "B").alias("group"))


REPORT = SPLIT + """, sized AS (SELECT COUNT(*) FILTER (split = 'train') AS train,
 COUNT(*) FILTER (split = 'val') AS val, COUNT(*) FILTER (split = 'test') AS test,
 COUNT(DISTINCT country_std) AS n_countries FROM sp),
 t AS (SELECT sp.Y AS y, lab.Y AS y_now, CASE WHEN right(sp.country_std, 1) < '4' THEN 'A'
 WHEN right(sp.country_std, 1) < '7' THEN 'B' END AS tier FROM sp LEFT JOIN lab
 ON lab.country_std = sp.country_std AND lab.week_id = sp.week_end WHERE split = 'test'),
 d AS (SELECT COUNT(*) FILTER (y_now = 0 AND y = 1) AS onset_n,
 COUNT(*) FILTER (y_now = 1 AND y = 0) AS decay_n,
 AVG(CASE WHEN y_now = y THEN 1.0 ELSE 0.0 END) FILTER (y_now IS NOT NULL) AS acc,
 COALESCE(2.0 * COUNT(*) FILTER (y_now = 1 AND y = 1) / NULLIF(2 * COUNT(*)
 FILTER (y_now = 1 AND y = 1) + COUNT(*) FILTER (y_now <> y), 0), 0) AS f1 FROM t),
 g AS (SELECT tier, COUNT(*) AS n, AVG(y) AS rate FROM t WHERE tier IS NOT NULL GROUP BY 1)"""


@query("training_report_facts", with_cte(REPORT) + f"""SELECT train, val, test, n_countries,
 2 AS n_features, onset_n, decay_n, {r('acc', 'persistence_acc')}, {r('f1', 'persistence_f1')},
 {r('rate', 'base_rate')}, tier, n AS tier_rows, TRUE AS measured
 FROM sized CROSS JOIN d CROSS JOIN g""")
def training_report_facts(spark, sf):
    """What of the nested report does not hang on the models: one row per tier."""
    x = training_report(spark, sf).select("*", F.explode("diagnostics.by_group").alias("g"))
    d = F.col("diagnostics")
    known = [F.col(f"test.{m}.{k}").isNotNull() for m in training.MODELS
             for k in ("f1", "precision", "recall", "brier", "threshold")]
    same = (F.col("final_test.n") == F.col("split_counts.test")) & (F.col("threshold").between(0, 1))
    for k in known:
        same = same & k
    return rounded(x.select(
        "split_counts.*", "n_countries", "n_features", d["onset_n"].alias("onset_n"),
        d["decay_n"].alias("decay_n"), d["persistence_acc"].alias("persistence_acc"),
        d["persistence_f1"].alias("persistence_f1"), F.col("g.base_rate").alias("base_rate"),
        F.col("g.group").alias("tier"), F.col("g.n").alias("tier_rows"), same.alias("measured")))


FOLDS = FLAT + """, i AS (SELECT *, row_number() OVER (ORDER BY week_end, country_std) - 1 AS i,
 COUNT(*) OVER () AS n FROM flat), b AS (SELECT *, least(4, i // (n // 4)) AS block FROM i)"""


@query("fold_training", with_cte(FOLDS) + """SELECT CAST(f.fold AS INTEGER) AS fold,
 COUNT(*) AS n, COUNT(*) AS scored, TRUE AS measured FROM b JOIN range(1, 4) f(fold)
 ON b.block = f.fold WHERE (SELECT COUNT(DISTINCT x.Y) FROM b x WHERE x.block < f.fold) > 1
 GROUP BY 1""")
def fold_training(spark, sf):
    """Expanding folds, each trained and scored: rows of a fold, scores and metrics in range.

    Folds before which all labels are alike cannot be trained and have no row; there may be none.
    """
    t = training.window_table(labelled_weeks(spark, sf), FEATURES)
    rows, each = training.cross_validate(pin(t), FEATURES, iterations=15,
                                         context=_context(spark, sf), strict=False)
    inside = F.col("p_ensemble").between(0, 1) & F.col("p_trees").between(0, 1)
    good = F.col("auc").between(0, 1) & F.col("brier").between(0, 1) & (F.col("f1") >= 0)
    scored = rows.groupBy("fold").agg(F.count_if(inside).alias("scored"))
    return each.join(scored, "fold").select("fold", "n", "scored", good.alias("measured"))


@query("saved_model_scoring")
def saved_model_scoring(spark, sf):
    t, folder = _table(spark, sf), scratch(spark, "model")
    training.train(t, FEATURES, folder)
    rows, _, _ = training.evaluate_saved(spark, folder, t, "test", start="2000-06-01")
    return rows


@query("training_facts", with_cte(SPLIT) + """SELECT split, COUNT(*) AS rows,
 COUNT(*) AS scores_in_range, COUNT(*) AS scores_follow_threshold FROM sp GROUP BY split""")
def training_facts(spark, sf):
    """What must hold for any trained model: all rows scored, in range, cut at the threshold."""
    scored, _ = training.train(_table(spark, sf), FEATURES)
    inside = F.lit(True)
    for c in ("p_trees", "p_sequence", "p_ensemble", "p_conflict"):
        inside = inside & F.col(c).between(0, 1)
    follows = F.col("pred") == (F.col("p_conflict") >= F.col("threshold")).cast("int")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                       F.count_if(inside).alias("scores_in_range"),
                                       F.count_if(follows).alias("scores_follow_threshold"))


@query("saved_model_facts", with_cte(SPLIT) + """SELECT COUNT(*) AS rows, COUNT(*) AS equal_scores,
 TRUE AS auc_known FROM sp WHERE split = 'test'""")
def saved_model_facts(spark, sf):
    """A stored model scores the test rows as the trained one did; the report has an AUC."""
    t, folder = _table(spark, sf), scratch(spark, "model")
    scored, report = training.train(t, FEATURES, folder)
    again, _, _ = training.evaluate_saved(spark, folder, t, "test")
    both = again.select("country_std", "week_end", F.col("p_conflict").alias("again")) \
        .join(scored, ["country_std", "week_end"])
    auc = report.select("final_test.auc").scalar()
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.abs(F.col("again") - F.col("p_conflict")) < 1e-9)
                    .alias("equal_scores")).select("rows", "equal_scores",
                                                   auc.isNotNull().alias("auc_known"))
