"""Structured Streaming over the events in several micro-batches, checked against batch SQL."""

from pyspark.sql import functions as F

from panelrisk.session import scratch
from panelrisk.streaming import streams
from panelrisk.workload.base import USERS, query, r, rounded, table, user_days, with_cte
from panelrisk.workload.entity_queries import NAMES, _pick, _pick_sql


SLICES = 3


def _in_order(df, time, folder):
    """Write a table as ``SLICES`` arrivals in time order; the span of one in days."""
    ends = df.agg(F.min(time).alias("low"), F.max(time).alias("high"),
                  F.date_diff(F.max(time), F.min(time)).alias("days")).first()
    span = (ends.days or 0) // SLICES + 1
    at = F.floor(F.date_diff(F.to_date(F.col(time)), F.to_date(F.lit(ends.low))) / span)
    for i in range(SLICES):
        df.filter(at == i).write.mode("append").parquet(folder)
    return span


def _events(spark, sf):
    """(events as a stream of several micro-batches, how late a row can be within an arrival)."""
    folder, e = scratch(spark, "events"), table(spark, sf, "events")
    days = _in_order(e, "ts", folder)
    files = spark.read.parquet(folder).select("_metadata.file_path").distinct().count()
    s = streams.file_stream(spark, folder, spark.read.parquet(folder).schema,
                            files_per_batch=-(-files // SLICES))
    return s, f"{days + 1} days"


def _timed(spark, sf):
    e, delay = _events(spark, sf)
    return streams.event_time(e, delay=delay).withColumns({
        "volume": F.floor("value").cast("long")})


@query("stream_canonicalise", f"""SELECT event_id, {_pick_sql([n[1] for n in NAMES], 'event_id')}
 AS country_std, {_pick_sql([n[2] for n in NAMES], 'event_id')} AS "group" FROM events""")
def stream_canonicalise(spark, sf):
    e = _events(spark, sf)[0].select("event_id", _pick([n[0] for n in NAMES], "event_id")
                                  .alias("raw"))
    out = scratch(spark, "out")
    streams.run_append(streams.canonical_stream(e, "raw").drop("raw"), out)
    return spark.read.parquet(out)


@query("stream_counts", f"""SELECT {_pick_sql([n[2] for n in NAMES], 'event_id')} AS "group",
 {_pick_sql([n[1] for n in NAMES], 'event_id')} AS country_std, COUNT(*) AS rows FROM events
 GROUP BY 1, 2""")
def stream_counts(spark, sf):
    e = _events(spark, sf)[0].select(_pick([n[0] for n in NAMES], "event_id").alias("raw"))
    out = scratch(spark, "out")
    keys = ["group", "country_std"]
    streams.run_updates(streams.running_counts(streams.canonical_stream(e, "raw")), out, keys)
    return streams.latest(spark, out, keys)


@query("stream_daily_media", f"""SELECT CAST(ts AS DATE) AS day, user_id, event_type,
 {r('AVG(value)', 'mean_signal')}, CAST(SUM(floor(value)) AS BIGINT) AS volume, COUNT(*) AS n
 FROM events GROUP BY 1, 2, 3""")
def stream_daily_media(spark, sf):
    out = scratch(spark, "out")
    keys = ["day", "user_id", "event_type"]
    streams.run_updates(streams.media_daily_stream(_timed(spark, sf)), out, keys)
    df = streams.latest(spark, out, keys)
    return rounded(df.withColumn("day", F.to_date("day")))


@query("stream_weekly_rollup", with_cte(USERS) + """SELECT CAST(date_trunc('week', ts) AS DATE)
 AS monday, country_std, COUNT(*) AS total_events, CAST(SUM(best) AS BIGINT)
 AS weekly_fatalities, COUNT(*) FILTER (event_type = 'error') AS battle_count,
 COUNT(*) FILTER (event_type = 'purchase') AS vac_count,
 COUNT(*) FILTER (event_type NOT IN ('error', 'purchase')) AS nonstate_count
 FROM user_events GROUP BY 1, 2""")
def stream_weekly_rollup(spark, sf):
    kind = (F.when(F.col("event_type") == "error", "Battles")
            .when(F.col("event_type") == "purchase", "Violence against civilians")
            .otherwise("Riots"))
    e = _timed(spark, sf).select(
        "ts", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("country_std"),
        kind.alias("event_type"), F.col("volume").alias("fatalities"))
    out = scratch(spark, "out")
    keys = ["monday", "country_std"]
    streams.run_updates(streams.weekly_stream(e), out, keys)
    return streams.latest(spark, out, keys) \
        .withColumn("monday", F.to_date("monday"))


@query("stream_carry_forward", "WITH " + """d AS (SELECT 'user_' || CAST(user_id AS VARCHAR)
 AS country_std, CAST(ts AS DATE) AS day, CAST(MAX(FLOOR(value)) FILTER (event_type = 'signup')
 AS DOUBLE) AS signal FROM events GROUP BY 1, 2) SELECT country_std, day,
 COALESCE(last_value(signal IGNORE NULLS) OVER (PARTITION BY country_std ORDER BY day
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS signal FROM d""")
def stream_carry_forward(spark, sf):
    days, out = scratch(spark, "days"), scratch(spark, "out")
    span = _in_order(user_days(spark, sf).select("country_std", "day", "signal"), "day", days)
    files = spark.read.parquet(days).select("_metadata.file_path").distinct().count()
    s = streams.file_stream(spark, days, spark.read.parquet(days).schema,
                            files_per_batch=-(-files // SLICES))
    filled = streams.carry_forward(s, "country_std", "day", "signal", delay=f"{span + 1} days")
    streams.run_updates(filled, out, ["country_std", "day"], timers=True)
    return streams.latest(spark, out, ["country_std", "day"])


@query("stream_sliding_mean", f"""SELECT user_id, CAST(d.day - k.i AS DATE) AS start,
 {r('SUM(s) / SUM(c)', 'mean_value')}, CAST(SUM(c) AS BIGINT) AS n FROM (SELECT user_id,
 CAST(ts AS DATE) AS day, SUM(value) AS s, COUNT(*) AS c FROM events GROUP BY 1, 2) d
 CROSS JOIN (SELECT CAST(i AS INTEGER) AS i FROM range(0, 14) t(i)) k GROUP BY 1, 2""")
def stream_sliding_mean(spark, sf):
    out = scratch(spark, "out")
    streams.run_updates(streams.sliding_mean(_timed(spark, sf)), out, ["start", "user_id"])
    df = streams.latest(spark, out, ["start", "user_id"])
    return rounded(df.withColumn("start", F.to_date("start")))
