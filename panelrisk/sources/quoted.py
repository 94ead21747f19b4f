"""CSV records with line breaks inside quotes, one large file read by many tasks.

Whether a byte range of a file begins inside quotes depends on everything before it. So
each range is first scanned under both start states, which gives a function from {outside,
inside} to {outside, inside}; the functions of a file's ranges are composed in their order
(a window over one row per range), and only then are records cut, each range under its
right start state. A record that runs over the end of a range is put together from its
fragments, the only rows that are shuffled.

A quote opens a cell only at its start; inside quotes ``""`` is a quote.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelrisk.session import pin

SEP, QUOTE = ",", '"'


def inside_after(line: str, inside: bool, sep: str = SEP) -> bool:
    """Whether a quote is open behind a line that begins inside quotes or at a cell's start."""
    at, opening = 0, sep + QUOTE
    if not inside:
        if line.startswith(QUOTE):
            inside, at = True, 1
        else:
            at = line.find(opening)
            if at < 0:
                return False
            inside, at = True, at + 2
    while True:
        close = line.find(QUOTE, at)
        if close < 0:
            return True
        if line.startswith(QUOTE, close + 1):
            at = close + 2
            continue
        # the quoted part has ended; the cell goes on up to the separator
        end = line.find(sep, close + 1)
        if end < 0:
            return False
        if line.startswith(QUOTE, end + 1):
            at = end + 2
            continue
        at = line.find(opening, end)
        if at < 0:
            return False
        at += 2


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(value, path, start): lines with the byte range they were read in, in the range's order."""
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"))


def _functions(lines: DataFrame, sep) -> DataFrame:
    """(path, start, from_outside, from_inside, closes) of each range.

    The first two tell whether the range ends inside quotes, by how it begins; ``closes`` whether
    a record that is open at its start ends in it.
    """
    schema = "path string, start long, from_outside boolean, from_inside boolean, closes boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for path, start, value in zip(*(batch.column(c).to_pylist()
                                            for c in ("path", "start", "value"))):
                if (path, start) != key:
                    if key:
                        done.append((*key, *state))
                    key, state = (path, start), [False, True, False]
                if value is None:  # a line without quotes
                    state[2] = state[2] or not state[1]
                    continue
                for i in (0, 1):
                    state[i] = inside_after(value, state[i], sep)
                state[2] = state[2] or not state[1]
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*done))))
        if key:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip((*key, *state)))))

    quoted = lines.select("path", "start", F.when(F.col("value").contains(QUOTE), F.col("value"))
                          .alias("value"))
    return quoted.mapInArrow(run, schema)


def _marks(functions: DataFrame) -> DataFrame:
    """Ranges that begin or end inside quotes: one row each.

    ``inside``: begins inside; ``origin``: where the record that is open at its start began;
    ``leaves``: a record that began here is open at its end; ``lost``: the record open at its
    start, ``tail_lost``: the one open at its end has no closing quote in the whole file.
    """
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    same = F.col("from_outside") == F.col("from_inside")
    flips = F.coalesce(F.sum(F.when(~same & F.col("from_outside"), 1).otherwise(0)).over(before),
                       F.lit(0))
    # the last range that ends in one state however it begins, and the flips after it
    rows = functions.withColumn("flips", flips)
    last = F.max(F.when(same, F.struct("start", "from_outside", "flips"))).over(before)
    rows = rows.withColumn("last", last).withColumn(
        "inside", F.coalesce("last.from_outside", F.lit(False))
        != ((F.col("flips") - F.coalesce("last.flips", F.lit(0))) % 2 == 1))
    rows = rows.withColumn("leaves", F.when(
        F.col("inside"), F.col("closes") & F.col("from_inside")).otherwise(F.col("from_outside")))
    rows = rows.withColumn("origin", F.when(F.col("inside"), F.max(
        F.when(F.col("leaves"), F.col("start"))).over(before)))
    ends = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    final = F.max_by(F.when(ends, F.when(F.col("leaves"), F.col("start"))
                            .otherwise(F.col("origin"))), "start").over(whole)
    rows = rows.withColumn("unclosed", final).filter(F.col("inside") | F.col("leaves"))
    return rows.select(
        "path", "start", "inside", "origin", "leaves",
        F.coalesce(F.col("origin") == F.col("unclosed"), F.lit(False)).alias("lost"),
        F.coalesce(F.col("start") == F.col("unclosed"), F.lit(False)).alias("tail_lost"))


def _cut(batches, header, sep):
    """Records of sorted ranges: (value, path, origin, start, open, head).

    Whole records have no path. Fragments name the range in which their record began;
    ``head`` marks the header's.
    """
    names = ["value", "path", "origin", "start", "open", "head"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    key, parts, origin, inside, row = None, [], None, False, None
    first = False  # the header record has not ended yet

    def ended(done):
        if key and parts:
            path, start = key
            mine = origin == start
            lost = row["tail_lost"] if mine else row["lost"]
            done.append((parts[0] if lost else "\n".join(parts), path, origin, start, lost,
                         mine and first))

    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        done = []
        for i, (path, start, value) in enumerate(zip(columns["path"], columns["start"],
                                                     columns["value"])):
            if (path, start) != key:
                ended(done)
                key, parts = (path, start), []
                row = {c: bool(columns[c][i]) for c in ("inside", "lost", "tail_lost")}
                inside = row["inside"]
                origin = columns["origin"][i] if inside else start
                first = header and start == 0
            inside = inside_after(value, inside, sep) if QUOTE in value else inside
            parts.append(value)
            if inside:
                if row["tail_lost"] and origin == start:
                    del parts[1:]
                continue
            if origin != start:
                done.append(("\n".join(parts), path, origin, start, False, False))
                origin = start
            elif first:
                first = False
            else:
                done.append(("\n".join(parts), None, None, None, False, False))
            parts = []
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), types)], names)
    done = []
    ended(done)
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)


CUT = "value string, path string, origin long, start long, open boolean, head boolean"


def records(spark: SparkSession, paths, header=True, sep=SEP) -> DataFrame:
    """(value, open): the records of CSV files, with the line breaks inside their quotes.

    A file is read by as many tasks as it has splits. ``open`` marks a record whose closing quote is
    missing up to the end of its file; its value is the first line, the lines behind it belong
    to it. With ``header`` the first record of each file is left out. Blank lines outside
    quotes give records without text; empty files give none. A carriage return ahead of a record's
    line feed is not part of it.
    """
    lines = _lines(spark, paths)
    marks = pin(_marks(_functions(lines, sep)))
    on = ["path", "start"]
    flags = ["inside", "origin", "lost", "tail_lost"]

    def cut(rows):
        return rows.select("value", *on, *flags).mapInArrow(
            lambda batches: _cut(batches, header, sep), CUT)

    # one row per range that begins or ends inside quotes: broadcast, so lines keep their order
    marked = lines.join(F.broadcast(marks), on, "left").filter(
        ~(F.coalesce("lost", F.lit(False)) & ~F.coalesce("leaves", F.lit(False))))
    whole = cut(marked).filter(F.col("path").isNull()).select("value", "open")
    # only ranges with a fragment are cut again for it
    fragments = cut(marked.filter(F.col("inside").isNotNull())).filter(F.col("path").isNotNull())
    joined = fragments.groupBy("path", "origin").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))),
                                 lambda p: p["value"]), "\n").alias("value"),
        F.max("open").alias("open"), F.max("head").alias("head")) \
        .filter(~F.col("head")).select("value", "open")
    return whole.unionByName(joined).withColumn("value", F.regexp_replace("value", "\r$", ""))
