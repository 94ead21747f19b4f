"""Exact order statistics without putting an ordering into one task.

A running total over a global order needs every row to know the total of all
rows before it. The rows are range-partitioned on the order, which splits even
a single hot ``by`` group over many slices, and the slice number is stored. A
window inside each slice plus the totals of the earlier slices (one small row
per slice and group) give the exact answer.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.session import pin

SLICE = "_slice"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def _match(left, right, by):
    """Null-safe equality on the group columns (right side is prefixed with _r_)."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in by])


def join_on(left: DataFrame, right: DataFrame, by, how="left") -> DataFrame:
    """Null-safe equi-join on ``by``, keeping the left columns once."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    return left.join(renamed, _match(left, renamed, by), how).drop(*[f"_r_{c}" for c in by])


def _sliced(df, by, order, slices=None):
    """Range-partition on (by, order), store the slice number, and write the result once.

    Written because the slice bounds are sampled: totals and rows must come from
    the same cut.
    """
    keys = [F.col(c) for c in by] + order
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return pin(ranged.withColumn(SLICE, F.spark_partition_id()))


def _offsets(per_slice, sums, by):
    """Totals of the earlier slices (``_off_``), of the slice (``_in_``) and of the group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *by, SLICE,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.col(c).alias(f"_in_{c}") for c in sums],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in sums])


def _local_totals(rows, order, sums, by):
    inside = Window.partitionBy(SLICE, *by).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{c}_before": F.col(f"_off_{c}")
                             + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}) \
        .drop(SLICE, *[f"_off_{c}" for c in sums], *[f"_in_{c}" for c in sums])


def _columns(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_totals(df: DataFrame, order, sums, by=(), slices=None) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` for each column in ``sums``.

    ``order`` is a list of columns (optionally descending) that is unique
    within ``by``; ``_before`` excludes the row itself.
    """
    by, sums, order = list(by), list(sums), _columns(order)
    pinned = _sliced(df, by, order, slices)
    offsets = _offsets(pinned.groupBy(*by, SLICE).agg(*[F.sum(c).alias(c) for c in sums]),
                       sums, by)
    # without a group there is one offset row per slice
    rows = join_on(pinned, offsets if by else F.broadcast(offsets), [*by, SLICE], "inner")
    return _local_totals(rows, order, sums, by)


def global_index(df: DataFrame, order, out="row_index", slices=None) -> DataFrame:
    """0-based position in a global unique order, plus ``<out>_total`` rows.

    Range-partitioned and sorted inside each slice, a row's place in its slice
    is the low part of its generated id, so no further shuffle is needed; the
    sizes of the earlier slices (one row per slice) are added.
    """
    order = _columns(order)
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    numbered = pin(ranged.sortWithinPartitions(*order)
                   .withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn(SLICE, F.shiftright("_id", 33))
    sizes = numbered.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    rows = numbered.join(F.broadcast(_offsets(sizes, ["n"], [])), SLICE)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off_n")
    return rows.withColumns({out: place, f"{out}_total": F.col("n_total")}) \
        .drop(SLICE, "_id", "_off_n", "_in_n", "n_total")


def cut_keys(df: DataFrame, order, wanted) -> DataFrame:
    """Key columns of the rows at wanted positions of a global order.

    ``wanted(position, total)`` is a condition. Only the key columns are put in order, so
    the rows themselves stay where they are. ``order`` names columns, all ascending.
    """
    numbered = global_index(df.select(*order), order, "_i")
    return numbered.filter(wanted(F.col("_i"), F.col("_i_total"))).select(*order)


def cuts_below(df: DataFrame, order, wanted):
    """(column, cuts): how many wanted positions lie at or before a row, and how many there are.

    For few positions, whose keys become constants of the plan. Rows with equal keys are on the
    same side. The column fits any frame with the key columns.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    key = F.struct(*[F.col(c).alias(c) for c in order])
    cuts = cut_keys(df, order, wanted).collect()
    passed = [(F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cut)]) <= key)
              .cast("int") for cut in cuts]
    return reduce(lambda a, b: a + b, passed, F.lit(0)), len(cuts)


def join_checked(df: DataFrame, side: DataFrame, by, how="left",
                 limit=BROADCAST_ROWS) -> DataFrame:
    """Join a reduced table back onto raw rows without shuffling them, if it is small.

    The side is written once and measured. Up to ``limit`` rows and BROADCAST_BYTES (as
    text) it is broadcast; beyond that both sides are shuffled and skewed keys are split
    by the engine.
    """
    side = pin(side)
    rows, size = side.limit(limit + 1).agg(
        F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    small = rows <= limit and (size or 0) <= BROADCAST_BYTES
    return join_on(df, F.broadcast(side) if small else side, by, how)


def unpivot(df: DataFrame, columns, by=()) -> DataFrame:
    """(by, variable, value) with the columns as double, NaN as NULL."""
    pairs = ", ".join(f"'{c}', nanvl(cast(`{c}` as double), cast(null as double))"
                      for c in columns)
    return df.select(*by, F.expr(f"stack({len(columns)}, {pairs})").alias("variable", "value"))


#: Ranks of a sketch are off by one part in ACCURACY at most; groups of up to SMALL_GROUP values
#: are not sketched.
ACCURACY = 2000
SMALL_GROUP = 4 * ACCURACY


def _brackets(values: DataFrame, keys, probs) -> DataFrame:
    """Per key and prob two values, low and high, between which its order statistics lie.

    One pass over the values with sketches that merge in any order. The margin is three times what
    a sketch can be off.
    """
    reach = 3.0 / ACCURACY
    ends = [max(0.0, p - reach) for p in probs] + [min(1.0, p + reach) for p in probs]
    made = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.percentile_approx("value", ends, ACCURACY).alias("_ends"))
    small = F.col("_n") <= SMALL_GROUP
    cols = []
    for i, p in enumerate(probs):
        low, high = F.get("_ends", F.lit(i)), F.get("_ends", F.lit(len(probs) + i))
        first, last = p - reach <= 0, p + reach >= 1
        cols += [F.when(small | F.lit(first), F.col("_min")).otherwise(low).alias(f"_low_{i}"),
                 F.when(small | F.lit(last), F.col("_max")).otherwise(high).alias(f"_high_{i}")]
        if p in (0.0, 1.0):
            end = "_min" if p == 0.0 else "_max"
            cols[-2:] = [F.when(small, F.col(f"_{x}")).otherwise(F.col(end)).alias(f"_{y}_{i}")
                         for x, y in (("min", "low"), ("max", "high"))]
    return made.select(*keys, *cols)


def _cells(values: DataFrame, keys, probs) -> DataFrame:
    """(keys, value, gap, cnt): counts of the values inside brackets, and of each gap between them.

    A gap is counted under the bracket end before it (NULL before the first) and comes
    behind the values there. Only these counts are put in order afterwards.
    """
    marked = join_checked(values, _brackets(values, keys, probs), keys, "inner")
    v, n = F.col("value"), range(len(probs))
    inside = reduce(lambda a, b: a | b, [v.between(F.col(f"_low_{i}"), F.col(f"_high_{i}"))
                                         for i in n])
    ends = [F.when(F.col(f"_high_{i}") < v, F.col(f"_high_{i}")) for i in n]
    before = F.greatest(*ends) if len(ends) > 1 else ends[0]
    return marked.groupBy(*keys, F.when(inside, v).otherwise(before).alias("value"),
                          (~inside).alias("gap")).agg(F.count(F.lit(1)).alias("cnt"))


def exact_quantiles(df: DataFrame, columns, probs, by=(), slices=None) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per (by, variable).

    Output columns: ``n`` and ``q<prob>`` with the point replaced by ``_``
    (``q0_25``). A sketch brackets each wanted rank in one pass; a second pass counts what
    lies between the brackets and keeps only values inside. Order statistics are read off
    running counts of those. A rank that its bracket missed (which the sketch rules out)
    stops the job instead of giving a wrong value.
    """
    by = list(by)
    keys = [*by, "variable"]
    # -0.0 and 0.0 are one value
    values = unpivot(df, columns, by).filter(F.col("value").isNotNull()) \
        .withColumn("value", F.col("value") + F.lit(0.0))
    pinned = _sliced(_cells(values, keys, probs), keys, [F.col("value"), F.col("gap")], slices)
    offsets = _offsets(pinned.groupBy(*keys, SLICE).agg(F.sum("cnt").alias("cnt")), ["cnt"], keys)
    # only slices that hold a wanted rank are read on
    ranks = F.array(*[fn((F.col("cnt_total") - 1) * F.lit(float(p)))
                      for p in probs for fn in (F.floor, F.ceil)])
    holds = F.exists(ranks, lambda k: (k >= F.col("_off_cnt"))
                     & (k < F.col("_off_cnt") + F.col("_in_cnt")))
    rows = join_on(pinned, offsets.filter(holds), [*keys, SLICE], "inner")
    ranked = _local_totals(rows, [F.col("value"), F.col("gap")], ["cnt"], keys)
    # looked at only where a wanted rank is
    found = F.when(F.col("gap"), F.raise_error(F.lit("a rank lies outside its bracket"))
                   .cast("double")).otherwise(F.col("value"))
    first, last = F.col("cnt_before"), F.col("cnt_before") + F.col("cnt")
    aggs = [F.max("cnt_total").alias("n")]
    for p in probs:
        h = (F.col("cnt_total") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (first <= rank) & (rank < last)
            aggs.append(F.max(F.when(hit, found)).alias(f"_{tag}_{quantile_name(p)}"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    cols = {}
    for p in probs:
        q = quantile_name(p)
        h = (F.col("n") - 1) * F.lit(float(p))
        cols[q] = F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * (h - F.floor(h))
    return picked.withColumns(cols).select(*keys, "n", *cols)


def quantile_name(p):
    return f"q{float(p):g}".replace(".", "_")


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in an explicit order.

    An aggregate with map-side combine, so a key with very many copies is
    reduced before the shuffle. Rows tied on ``order`` are told apart by the
    remaining columns.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    sort_key = F.struct(*order, *[c for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sort_key).alias("_kept"))
    return best.select(*keys, "_kept.*").select(*df.columns)
