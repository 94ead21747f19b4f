"""Forward fill of a keyed series as a stateful processor with event-time timers.

A key's state holds the rows of its open window (those the watermark has not passed) and the
last known value before it. A row is filled at once from what is known; a row that arrives late
but inside the window is put in its place, and the filled rows behind it are sent again. Timers
fold rows into the last known value once the watermark has passed them, and forget a
key that has been silent for long. So the state of a key is bounded by the window.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t: datetime) -> int:
    t = t if t.tzinfo else t.astimezone()
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000)


class CarryForward(StatefulProcessor):
    """Rows (key, at, period, value) in, (key, period, value) out, in update mode."""

    def __init__(self, names, default, forget_ms):
        self.names, self.default, self.forget_ms = names, default, forget_ms

    def init(self, handle):
        self.handle = handle
        self.window = handle.getMapState("window", "at long", "period string, value double")
        self.base = handle.getValueState("base", "at long, value double")

    def _before(self):
        """(time, value) of the last row that has left the window."""
        found = self.base.get() if self.base.exists() else None
        return (None, self.default) if found is None else (found[0], found[1])

    def _out(self, key, period, value):
        return Row(**dict(zip(self.names, (key, period, value))))

    def handleInputRows(self, key, rows, timerValues):
        since, last = self._before()
        first, alone = None, []
        for r in rows:
            at = _ms(r["at"])
            value = None if r["value"] is None else float(r["value"])
            if since is not None and at <= since:
                # its neighbours have left the window: it stands for itself and repairs nothing
                alone.append((r["period"], value))
                continue
            self.window.updateValue((at,), (r["period"], value))
            first = at if first is None else min(first, at)
        for period, value in alone:
            yield self._out(key[0], period, value)
        if first is None:
            return
        held = sorted((k[0], v[0], v[1]) for k, v in self.window.iterator())
        for at, period, value in held:
            if self.forget_ms is not None and since is not None and at - since > self.forget_ms:
                last = self.default
            since, last = at, last if value is None else value
            if at >= first:
                yield self._out(key[0], period, last)
        self._wake(held[0][0] + 1)

    def _wake(self, at_ms):
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        since, last = self._before()
        left = []
        for at, value in sorted((k[0], v[1]) for k, v in self.window.iterator()):
            if at < passed:
                since, last = at, last if value is None else value
                self.window.removeKey((at,))
            else:
                left.append(at)
        if since is not None:
            self.base.update((since, last))
        if left:
            self._wake(left[0] + 1)
        elif since is not None and self.forget_ms is not None:
            if since + self.forget_ms <= passed:
                self.base.clear()
            else:
                self._wake(since + self.forget_ms)
        return iter(())

    def close(self):
        pass


def carry_forward(stream: DataFrame, key, period, value, default=1.0, delay="1 day",
                  forget=None) -> DataFrame:
    """Fill NULL values of a keyed series with the last known one, else a constant.

    Rows (key, period, value) in update mode: a (key, period) is sent again when a late row
    changes it, so the newest version of each is the answer (``run_updates`` with both as
    keys). ``delay`` is how late a row may be and still be put in its place; a later one is sent
    with its own value, NULL if it has none. ``forget`` (such as "30 days") ends the carrying after
    that long without a row, and lets a timer drop such a key's state; None keeps it, one small
    row per key. Of rows that share key and period the last to arrive counts.

    Needs the RocksDB state store, which ``run_updates`` sets with ``timers=True``.
    """
    types = dict(stream.dtypes)
    schema = f"`{key}` {types[key]}, `{period}` {types[period]}, `{value}` double"
    rows = stream.filter(F.col(period).isNotNull()).select(
        F.col(key).alias("key"), F.col(period).cast("timestamp").alias("at"),
        F.col(period).cast("string").alias("period"), F.col(value).cast("double").alias("value")) \
        .withWatermark("at", delay)
    forget_ms = None if forget is None else int(
        stream.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {forget}) AS ms")
        .first().ms)
    sent = rows.groupBy("key").transformWithState(
        CarryForward(("key", "period", "value"), float(default), forget_ms),
        f"key {types[key]}, period string, value double", "Update", "EventTime")
    return sent.select(F.col("key").alias(key), F.col("period").cast(types[period]).alias(period),
                       F.col("value").alias(value)).to(
        stream.sparkSession.createDataFrame([], schema).schema)
