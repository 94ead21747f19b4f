"""Daily media signal."""

from pyspark.sql import functions as F

from panelrisk.operators import rolling, rollups
from panelrisk.workload.base import MEDIA, media, query, r, rounded, rs, with_cte


@query("media_daily_rollup", with_cte(MEDIA) + f"""SELECT SQLDATE, ActionGeo_CountryCode,
 EventCode, {rs(['AvgGoldstein', 'AvgTone'])}, TotalMentions, TotalSources, TotalArticles
 FROM media""")
def media_daily_rollup(spark, sf):
    return rounded(media(spark, sf))


@query("media_annual", with_cte(MEDIA) + f"""SELECT ActionGeo_CountryCode AS country_std,
 CAST(SQLDATE // 10000 AS INTEGER) AS year, {r('AVG(AvgTone)', 'AvgTone_z')},
 {r('AVG(AvgGoldstein)', 'AvgGoldstein_z')} FROM media GROUP BY 1, 2""")
def media_annual(spark, sf):
    return rounded(rollups.media_to_years(media(spark, sf)))


@query("daily_tone", with_cte(MEDIA) + f"""SELECT ActionGeo_CountryCode, SQLDATE,
 {r('AVG(AvgTone)', 'tone')} FROM media GROUP BY 1, 2""")
def daily_tone(spark, sf):
    return rounded(_daily_tone(spark, sf))


def _daily_tone(spark, sf):
    return rollups.mean_by(media(spark, sf), ["ActionGeo_CountryCode", "SQLDATE"], "AvgTone",
                           "tone")


@query("tone_fortnight", with_cte(MEDIA) + f""", d AS (SELECT ActionGeo_CountryCode, SQLDATE,
 AVG(AvgTone) AS tone FROM media GROUP BY 1, 2) SELECT ActionGeo_CountryCode, SQLDATE,
 {r('''AVG(tone) OVER (PARTITION BY ActionGeo_CountryCode ORDER BY SQLDATE
 ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)''', 'tone_14')} FROM d""")
def tone_fortnight(spark, sf):
    d = rolling.rolling_means(_daily_tone(spark, sf), {"tone_14": ("tone", 14)},
                              "ActionGeo_CountryCode", ["SQLDATE"])
    return rounded(d.drop("tone"))


@query("event_mix", with_cte(MEDIA) + f""", m AS (SELECT ActionGeo_CountryCode,
 SQLDATE // 100 AS month, TRY_CAST(substr(EventCode, 1, 2) AS INTEGER) AS root FROM media)
 SELECT ActionGeo_CountryCode, CAST(month AS INTEGER) AS month, COUNT(*) AS events,
 {r('AVG(CASE WHEN root >= 14 THEN 1.0 ELSE 0.0 END)', 'conflict_share')},
 {r('1 - AVG(CASE WHEN root <= 6 THEN 1.0 ELSE 0.0 END)', 'isolation')}
 FROM m WHERE root IS NOT NULL AND root <> 9 GROUP BY 1, 2""")
def event_mix(spark, sf):
    m = media(spark, sf).withColumn("month", (F.col("SQLDATE") / 100).cast("int"))
    # root 9 stands for an unreadable code
    m = m.withColumn("EventCode", F.when(F.col("EventCode").startswith("09"), F.lit("--"))
                     .otherwise(F.col("EventCode")))
    return rounded(rollups.event_mix(m, ["ActionGeo_CountryCode", "month"], "EventCode"))
