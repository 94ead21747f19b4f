"""Structured Streaming counterparts of the batch rollups.

Aggregating streams run in update mode with a watermark, so closed windows leave
the state store. Each micro-batch puts its changed rows into a ``Versioned`` table, which
keeps the newest row per key in few runs; ``latest`` reads it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.fixed_values import NONSTATE_KINDS, ONESIDED_KINDS, STATE_KINDS
from panelrisk.operators.entities import assign_tier, canonicalise
from panelrisk.session import scratch, settings
from panelrisk.streaming import carry
from panelrisk.streaming.versioned import Versioned

carry_forward = carry.carry_forward


def file_stream(spark: SparkSession, folder, schema, pattern="*.parquet", files_per_batch=200):
    """Files as they arrive, at most ``files_per_batch`` in a micro-batch (None: no bound)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, time="ts", delay="1 day") -> DataFrame:
    """Cast to a zoned timestamp (the session zone should be UTC) and set the watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def run_updates(stream: DataFrame, out, keys, checkpoint=None, timers=False):
    """Drain what has arrived in update mode into the ``Versioned`` table ``out``.

    ``timers`` takes the state store that keyed processors with timers need. Returns the ended
    query, whose progress tells how much state is left.
    """
    spark = stream.sparkSession
    store = {"spark__sql__streaming__stateStore__providerClass": carry.ROCKSDB} if timers else {}
    with settings(spark, **store):
        query = (stream.writeStream.outputMode("update")
                 .foreachBatch(lambda batch, i: Versioned(batch.sparkSession, out, keys)
                               .update(batch, i))
                 .option("checkpointLocation", checkpoint or scratch(spark, "stream"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return query


def latest(spark: SparkSession, out, keys) -> DataFrame:
    """Newest version of each key of an update stream's output."""
    return Versioned(spark, out, keys).read()


def run_append(stream: DataFrame, out, checkpoint=None):
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint or scratch(stream.sparkSession, "stream"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def canonical_stream(stream: DataFrame, name, aliases=None, tiers=None) -> DataFrame:
    """Chunks in, canonical name and tier appended: two stream-static lookups, no state."""
    return assign_tier(canonicalise(stream, name, aliases=aliases), tiers=tiers)


def running_counts(stream: DataFrame, keys=("group", "country_std")) -> DataFrame:
    """Rows per key over everything seen so far."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def media_daily_stream(stream: DataFrame, time="ts", keys=("user_id", "event_type"),
                       signal="value", volume="volume") -> DataFrame:
    """Tumbling daily rollup: mean signal and summed volume per day and key."""
    w = F.window(time, "1 day")
    return stream.groupBy(w.alias("w"), *keys).agg(
        F.avg(signal).alias("mean_signal"), F.sum(volume).alias("volume"),
        F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("day"), *keys, "mean_signal", "volume", "n")


def weekly_stream(stream: DataFrame, time="ts", entity="country_std", kind="event_type",
                  value="fatalities") -> DataFrame:
    """Tumbling Monday-aligned weekly conflict rollup."""
    w = F.window(time, "7 days", startTime="4 days")
    return stream.groupBy(w.alias("w"), entity).agg(
        F.count(F.lit(1)).alias("total_events"), F.sum(value).alias("weekly_fatalities"),
        F.count_if(F.col(kind).isin(STATE_KINDS)).alias("battle_count"),
        F.count_if(F.col(kind).isin(ONESIDED_KINDS)).alias("vac_count"),
        F.count_if(F.col(kind).isin(NONSTATE_KINDS)).alias("nonstate_count")) \
        .select(F.col("w.start").alias("monday"), entity, "total_events", "weekly_fatalities",
                "battle_count", "vac_count", "nonstate_count")


def sliding_mean(stream: DataFrame, time="ts", keys=("user_id",), value="value",
                 length="14 days", step="1 day") -> DataFrame:
    """Mean of a signal over sliding windows."""
    w = F.window(time, length, step)
    return stream.groupBy(w.alias("w"), *keys).agg(F.avg(value).alias("mean_value"),
                                                   F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("start"), *keys, "mean_value", "n")
