"""Ranking, threshold and calibration metrics over the labelled documents."""

from pyspark.sql import functions as F

from panelrisk.operators import metrics, models, panel
from panelrisk.workload.base import (AP_SQL, AUC_SQL, EVENTS, SCORES, curve_sql, nation_events,
                                     query, r, rounded, scores, with_cte)

CURVE = SCORES + ", " + curve_sql("scores")
CURVE_BY = SCORES + ", " + curve_sql("scores", "lang")


def _curve(spark, sf, by=()):
    return metrics.ranking_curve(scores(spark, sf), "y", "p", by)


@query("ranking_metrics", with_cte(CURVE) + f"""SELECT CAST(MAX(pt + nt) AS BIGINT) AS n,
 CAST(MAX(pt) AS BIGINT) AS positives, {r(AUC_SQL, 'auc')}, {r(AP_SQL, 'ap')} FROM curve""")
def ranking_metrics(spark, sf):
    return rounded(metrics.auc_ap(_curve(spark, sf)))


@query("ranking_metrics_by_key", with_cte(CURVE_BY) + f"""SELECT lang,
 CAST(MAX(pt + nt) AS BIGINT) AS n, CAST(MAX(pt) AS BIGINT) AS positives, {r(AUC_SQL, 'auc')},
 {r(AP_SQL, 'ap')} FROM curve GROUP BY lang""")
def ranking_metrics_by_key(spark, sf):
    return rounded(metrics.auc_ap(_curve(spark, sf, ["lang"]), ["lang"]))


@query("precision_recall_curve", with_cte(CURVE) + f"""SELECT threshold, {r('prec', 'precision')},
 {r('rec', 'recall')} FROM curve""")
def precision_recall_curve(spark, sf):
    return rounded(metrics.pr_curve(_curve(spark, sf)))


@query("best_f1_threshold", with_cte(CURVE_BY) + f"""SELECT lang,
 CASE WHEN MAX(pt) > 0 AND MAX(nt) > 0 THEN arg_max(threshold, (f1, -threshold)) ELSE 0.5 END
 AS threshold, {r('CASE WHEN MAX(pt) > 0 AND MAX(nt) > 0 THEN MAX(f1) END', 'f1')}
 FROM curve GROUP BY lang""")
def best_f1_threshold(spark, sf):
    return rounded(metrics.best_f1_threshold(_curve(spark, sf, ["lang"]), ["lang"]))


@query("precision_floor_threshold", with_cte(CURVE_BY) + f""", ok AS (SELECT *,
 row_number() OVER (PARTITION BY lang ORDER BY rec DESC, f1 DESC, threshold) AS i,
 COUNT(*) OVER (PARTITION BY lang) AS c FROM curve WHERE prec >= 0.7 AND pt > 0 AND nt > 0)
 SELECT l.lang, threshold, {r('prec', 'precision')}, {r('rec', 'recall')}, {r('f1', 'f1')},
 COALESCE(c, 0) AS n_candidates FROM (SELECT DISTINCT lang FROM scores) l
 LEFT JOIN ok ON ok.lang = l.lang AND ok.i = 1""")
def precision_floor_threshold(spark, sf):
    return rounded(metrics.best_at_precision(_curve(spark, sf, ["lang"]), 0.7, ["lang"]))


CONFUSION = """COUNT(*) FILTER (p >= 0.05 AND y = 1) AS tp,
 COUNT(*) FILTER (p >= 0.05 AND y <> 1) AS fp, COUNT(*) FILTER (p < 0.05 AND y = 1) AS fn,
 COUNT(*) FILTER (p < 0.05 AND y <> 1) AS tn"""
_RATES = ", ".join([r("COALESCE(tp / NULLIF(tp + fp, 0), 0)", "precision"),
                    r("COALESCE(tp / NULLIF(tp + fn, 0), 0)", "recall"),
                    r("COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0)", "f1"),
                    r("(tp + tn) / n", "accuracy")])


@query("confusion_at_threshold", with_cte(SCORES) + f""", c AS (SELECT lang, COUNT(*) AS n,
 AVG(y) AS positive_rate, {CONFUSION}, AVG((p - y) * (p - y)) AS brier FROM scores GROUP BY 1)
 SELECT lang, n, {r('positive_rate', 'positive_rate')}, tp, fp, fn, tn, {r('brier', 'brier')},
 {_RATES} FROM c""")
def confusion_at_threshold(spark, sf):
    return rounded(metrics.at_threshold(scores(spark, sf), "y", "p", 0.05, ["lang"]))


@query("brier_score", with_cte(SCORES) + f"""SELECT lang, {r('AVG(pow(p - y, 2))', 'brier')}
 FROM scores GROUP BY 1""")
def brier_score(spark, sf):
    return rounded(metrics.brier(scores(spark, sf), "y", "p", ["lang"]))


@query("metrics_per_source", with_cte(SCORES, curve_sql("scores", "source")) + f""",
 c AS (SELECT source, COUNT(*) AS n, AVG(y) AS positive_rate, {CONFUSION},
 AVG((p - y) * (p - y)) AS brier FROM scores GROUP BY 1),
 a AS (SELECT source, {r(AUC_SQL, 'auc')}, {r(AP_SQL, 'ap')} FROM curve GROUP BY 1)
 SELECT c.source, n, {r('positive_rate', 'positive_rate')}, tp, fp, fn, tn,
 {r('brier', 'brier')}, {_RATES}, auc, ap FROM c JOIN a ON a.source = c.source WHERE n >= 2""")
def metrics_per_source(spark, sf):
    return rounded(metrics.evaluate(scores(spark, sf), "y", "p", 0.05, ["source"], min_rows=2))


@query("overall_evaluation", with_cte(CURVE) + f""", c AS (SELECT COUNT(*) AS n,
 AVG(y) AS positive_rate, {CONFUSION}, AVG((p - y) * (p - y)) AS brier FROM scores),
 a AS (SELECT {r(AUC_SQL, 'auc')}, {r(AP_SQL, 'ap')} FROM curve)
 SELECT n, {r('positive_rate', 'positive_rate')}, tp, fp, fn, tn, {r('brier', 'brier')},
 {_RATES}, auc, ap FROM c CROSS JOIN a""")
def overall_evaluation(spark, sf):
    return rounded(metrics.evaluate(scores(spark, sf), "y", "p", 0.05))


BLEND = SCORES + """, blended AS (SELECT a.i / 20.0::DOUBLE AS alpha, y,
 (a.i / 20.0::DOUBLE) * p + (1 - a.i / 20.0::DOUBLE) * q AS p
 FROM scores CROSS JOIN range(0, 21) a(i)), """ + curve_sql("blended", "alpha")


@query("blend_weight_search", with_cte(BLEND) + f""", per AS (SELECT alpha, {AUC_SQL} AS auc
 FROM curve GROUP BY alpha) SELECT COALESCE(arg_max(alpha, (ROUND(auc, 9), -alpha)), 0.0)
 AS alpha, {r('MAX(auc)', 'auc')} FROM per""")
def blend_weight_search(spark, sf):
    return rounded(metrics.blend_search(scores(spark, sf), "y", "p", "q"))


@query("tier_blend", with_cte(SCORES) + f"""SELECT doc_id, {r('''(CASE lang WHEN 'en' THEN 0.6
 WHEN 'fr' THEN 0.7 WHEN 'de' THEN 0.8 ELSE 0.7 END) * p + (1 - (CASE lang WHEN 'en' THEN 0.6
 WHEN 'fr' THEN 0.7 WHEN 'de' THEN 0.8 ELSE 0.7 END)) * q''', 'p_blend')} FROM scores""")
def tier_blend(spark, sf):
    s = scores(spark, sf).withColumn("group", F.when(F.col("lang") == "en", "A")
                                     .when(F.col("lang") == "fr", "B")
                                     .when(F.col("lang") == "de", "C").otherwise("OTHER"))
    return rounded(s.select("doc_id", models.blend("p", "q", models.tier_alpha())
                            .alias("p_blend")))


@query("final_model_choice", with_cte(SCORES) + """, g AS (SELECT source, AVG(y) AS t, AVG(p) AS s,
 AVG(q) AS e FROM scores GROUP BY 1) SELECT source,
 CASE WHEN t <= 0.05 OR e < s THEN 'sequence' WHEN e < t THEN 'trees' ELSE 'ensemble' END
 AS final_model, CASE WHEN t <= 0.05 THEN 'alpha_is_zero'
 WHEN e < s THEN 'ensemble_not_better_than_sequence'
 WHEN e < t THEN 'ensemble_not_better_than_trees' ELSE 'ensemble_best_or_tied' END
 AS final_reason FROM g""")
def final_model_choice(spark, sf):
    g = scores(spark, sf).groupBy("source").agg(F.avg("y").alias("t"), F.avg("p").alias("s"),
                                                F.avg("q").alias("e"))
    g = g.withColumns({"alpha": F.col("t"), "auc_trees": F.col("t"), "ap_trees": F.col("t"),
                       "auc_sequence": F.col("s"), "ap_sequence": F.col("s"),
                       "auc_ensemble": F.col("e"), "ap_ensemble": F.col("e")})
    return models.choose_final(g).select("source", "final_model", "final_reason")


PERSIST = SCORES + """, k AS (SELECT y, p AS model_p, CAST(y_now AS DOUBLE) AS p FROM scores
 WHERE y_now IS NOT NULL), """


@query("persistence_baseline", with_cte(PERSIST + curve_sql("k")) + f""",
 m_in AS (SELECT y, model_p AS p FROM k), {curve_sql('m_in').replace('cnt AS', 'mcnt AS')
 .replace('FROM cnt', 'FROM mcnt').replace('cum AS', 'mcum AS').replace('FROM cum', 'FROM mcum')
 .replace('pr AS', 'mpr AS').replace('FROM pr', 'FROM mpr').replace('curve AS', 'mcurve AS')},
 pa AS (SELECT {AUC_SQL} AS v FROM curve), ma AS (SELECT {AUC_SQL} AS v FROM mcurve),
 f AS (SELECT AVG(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc,
 2.0 * COUNT(*) FILTER (p = 1 AND y = 1) / NULLIF(2 * COUNT(*) FILTER (p = 1 AND y = 1) +
 COUNT(*) FILTER (p <> y), 0) AS pf1, 2.0 * COUNT(*) FILTER (model_p >= 0.05 AND y = 1) /
 NULLIF(2 * COUNT(*) FILTER (model_p >= 0.05 AND y = 1) + COUNT(*) FILTER ((model_p >= 0.05)
 <> (y = 1)), 0) AS mf1 FROM k)
 SELECT {r('COALESCE(pf1, 0)', 'persistence_f1')}, {r('acc', 'persistence_acc')},
 {r('COALESCE(mf1, 0)', 'model_f1')}, {r('pa.v', 'persistence_auc')}, {r('ma.v', 'model_auc')},
 {r('ma.v - pa.v', 'lift_auc')} FROM f CROSS JOIN pa CROSS JOIN ma""")
def persistence_baseline(spark, sf):
    return rounded(metrics.persistence(scores(spark, sf), "y_now", "y", "p", 0.05))


@query("onset_recall", with_cte(SCORES) + f"""SELECT COUNT(*) FILTER (y_now = 0 AND y = 1)
 AS onset_n, COUNT(*) FILTER (y_now = 1 AND y = 0) AS decay_n,
 {r('COUNT(*) FILTER (y_now = 0 AND y = 1 AND p >= 0.05) / NULLIF(COUNT(*) FILTER (y_now = 0 AND y = 1), 0)',
    'onset_recall')} FROM scores""")
def onset_recall(spark, sf):
    return rounded(metrics.onset_recall(scores(spark, sf), "y_now", "y", "p", F.lit(0.05)))


@query("state_lookup", with_cte(SCORES, EVENTS) + """, now AS (SELECT country_std,
 CAST(year(event_date) AS INTEGER) AS year, CAST(AVG(fatalities) > 235 AS INTEGER) AS y_now
 FROM nation_events GROUP BY 1, 2) SELECT doc_id, 'NATION_' || CAST(doc_id % 30 AS VARCHAR)
 AS country_std, n.y_now FROM scores LEFT JOIN now n ON n.country_std = 'NATION_' ||
 CAST(doc_id % 30 AS VARCHAR) AND n.year = 1995 + doc_id % 8""")
def state_lookup(spark, sf):
    """Current state of the entity and period of each prediction; NULL where unknown."""
    now = nation_events(spark, sf).groupBy("country_std", F.year("event_date").alias("year")) \
        .agg((F.avg("fatalities") > 235).cast("int").alias("y_now"))
    s = scores(spark, sf).select(
        "doc_id", F.concat(F.lit("NATION_"), (F.col("doc_id") % 30).cast("string"))
        .alias("country_std"), (1995 + F.col("doc_id") % 8).cast("int").alias("year"))
    return panel.current_state(s, now, "y_now", keys=("country_std", "year")) \
        .select("doc_id", "country_std", "y_now")
