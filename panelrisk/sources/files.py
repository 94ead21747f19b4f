"""Readers and writers: tolerant CSV, Parquet, reports, unions and ingest."""

import csv
import os
import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.fixed_values import EXPECTED_COLUMNS, FILE_KEYWORDS, SOURCE_SCHEMAS
from panelrisk.functions.columns import first_present
from panelrisk.session import settings
from panelrisk.sources import quoted

REJECT = "_reject"


def read_parquet(spark: SparkSession, path, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path, partition_by=()):
    """Snappy Parquet, replacing what was there."""
    df.write.mode("overwrite").option("compression", "snappy") \
        .partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path):
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path):
    """Small nested report (one row per report) as JSON lines."""
    df.write.mode("overwrite").json(path)


def list_csv_files(spark: SparkSession, paths) -> dict:
    """Given path -> the CSV files behind it (itself, or what lies in the folder); one job."""
    paths = list(dict.fromkeys(paths))
    listed = union_extracts([list_files(spark, p, "*").select(F.lit(i).alias("given"), "path")
                             for i, p in enumerate(paths)])
    found = {p: [] for p in paths}
    for r in listed.collect():
        if not os.path.basename(r.path).startswith(("_", ".")):
            found[paths[r.given]].append(r.path)
    return {p: sorted(own) or [p] for p, own in found.items()}


def _plain_path(uri) -> str:
    """A path as the file listing gives it, from the encoded form of a row's metadata."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(uri))


def first_lines(spark: SparkSession, paths) -> dict:
    """File -> its first line, for any number of files (or folders) in one job.

    Every task has one file and stops after its first rows, so files are not read through.
    Empty files are missing.
    """
    def first(batches):
        for batch in batches:
            if batch.num_rows:
                if batch.column("start")[0].as_py() == 0:
                    yield batch.slice(0, 1).select(["path", "value"])
                return

    lines = _reader(spark).text(paths).select("value", F.col("_metadata.file_path").alias("path"),
                                              F.col("_metadata.file_block_start").alias("start"))
    with settings(spark, spark__sql__files__maxPartitionBytes=str(1 << 42),
                  spark__sql__files__openCostInBytes=str(1 << 42)):
        rows = lines.mapInArrow(first, "path string, value string").collect()
    return {_plain_path(r.path): r.value for r in rows}


def catalogue(spark: SparkSession, paths, header=True, roots=None) -> dict:
    """File -> its column names, in one job: the header's, or ``_c0`` and so on without one."""
    lines = first_lines(spark, roots or paths)
    out = {}
    for p in paths:
        line = lines.get(_plain_path(quote(p, safe="/:"))) or ""
        cells = next(csv.reader([line.lstrip("\ufeff").rstrip("\r")]), [])
        out[p] = tuple(c.strip() for c in cells) if header else \
            tuple(f"_c{i}" for i in range(len(cells)))
    return out


def _reader(spark):
    return spark.read.option("recursiveFileLookup", True)


def _text_cells(spark, paths, names, header, multi_line):
    """All cells as text under the given names, ``_extra`` for one too many, ``_open`` for an
    open quote. Lines are read as text, so that a quote that is not closed shows."""
    ddl = ", ".join(f"`{c}` string" for c in [*names, "_extra"])
    how = {"mode": "PERMISSIVE", "escape": '"'}
    if multi_line:
        lines = quoted.records(spark, paths, header).select("value", F.col("open").alias("_open"))
        how["multiLine"] = "true"
    elif header:
        # the CSV reader leaves out the first line of each file and no other; here a line is one
        # cell, and a line that holds the separator comes whole as a corrupt record
        lines = _reader(spark).option("header", True).option("sep", "\x01").option("quote", "") \
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line") \
            .schema("value string, _line string").csv(paths) \
            .select(F.coalesce("_line", "value").alias("value"))
    else:
        lines = _reader(spark).text(paths)
    lines = lines.filter(F.length(F.trim("value")) > 0)
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        lines = lines.withColumn("_open", quotes % 2 == 1)
    return lines.select(F.from_csv("value", ddl, how).alias("c"), "_open").select("c.*", "_open")


def _by_header(names, roots=None) -> dict:
    """Column names -> the files that have them; the folders, where all files have the same."""
    groups = {}
    for p, own in names.items():
        groups.setdefault(own, []).append(p)
    return {own: roots for own in groups} if roots and len(groups) == 1 else groups


def scan_csv(spark: SparkSession, path, schema: T.StructType = None, header=True,
             multi_line=False, names=None) -> DataFrame:
    """Tolerant CSV scan of a file or folder (or a list); cells are bound by the header's names.

    Files may have their columns in different orders; a wanted column that a
    file lacks is NULL, columns that are not wanted are left out. Without a header the
    schema's order holds. Short rows are padded with NULL and kept. Rows with too many
    cells, an open quote or a cell that does not fit the column's type carry the cause in
    ``_reject``. With ``multi_line`` line breaks inside quotes are read, a large file by many tasks;
    a quote that is not closed up to the end of its file makes one rejected row of what follows
    it. Without a schema the types are inferred by one more pass over all files; a column
    that is text in any file is text. ``names`` (file -> its column names) spares the looks at
    the folder and the headers, which are one job each for any number of files.
    """
    roots = None
    if names is None:
        roots = [path] if isinstance(path, str) else list(path)
        paths = [f for own in list_csv_files(spark, roots).values() for f in own]
        names = catalogue(spark, paths, header, roots) if header or schema is None else \
            dict.fromkeys(paths, ())
    if schema is None:
        schema = infer_schema(spark, {"": names}, header, multi_line, roots)[""]
    if not header:
        names = dict.fromkeys(names, tuple(f.name for f in schema))
    parts = []
    for own_names, own in _by_header(names, roots).items():
        raw = _text_cells(spark, own, own_names, header, multi_line)
        cause = F.when(F.col("_open"), F.lit("open quote")) \
            .when(F.col("_extra").isNotNull(), F.lit("too many cells"))
        typed = []
        for f in schema:
            if f.name not in own_names:
                typed.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            cell = F.col(f"`{f.name}`")
            if not isinstance(f.dataType, T.StringType):
                value = F.trim(cell).try_cast(f.dataType)
                cause = cause.when(cell.isNotNull() & value.isNull(), F.lit(f"bad {f.name}"))
                cell = value
            typed.append(cell.alias(f.name))
        parts.append(raw.select(*typed, cause.alias(REJECT)))
    return union_extracts(parts)


#: Types a column of text can have: narrower ones first, each with the test of a trimmed cell.
_KINDS = [
    (T.IntegerType(), lambda c: c.try_cast("int").isNotNull()),
    (T.LongType(), lambda c: c.try_cast("long").isNotNull()),
    (T.DoubleType(), lambda c: c.try_cast("double").isNotNull()),
    (T.BooleanType(), lambda c: F.lower(c).isin("true", "false")),
    (T.DateType(), lambda c: c.rlike(r"^\d{4}-\d\d-\d\d$") & c.try_cast("date").isNotNull()),
    (T.TimestampType(), lambda c: c.rlike(r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d.*)?$")
     & c.try_cast("timestamp").isNotNull()),
]


def infer_schema(spark: SparkSession, data_sets: dict, header=True, multi_line=False,
                 roots=None) -> dict:
    """Schemas of data sets, each given as file -> its column names; one job for all of them.

    Columns are in order of appearance. Each has the narrowest type that fits every cell of every
    file: the tests of all types are and-ed, so partial results merge in any order. A column
    without a cell is text.
    """
    parts = []
    for data_set, names in data_sets.items():
        for own_names, own in _by_header(names, roots).items():
            cells = _text_cells(spark, own, own_names, header, multi_line)
            if own_names:
                parts.append(cells.select(F.explode(F.array(*[
                    F.struct(F.lit(data_set).alias("data_set"), F.lit(c).alias("name"),
                             F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias("cell"))
                    for c in own_names])).alias("one")).select("one.*"))
    found = {}
    if parts:
        flags = [f"fits_{i}" for i in range(len(_KINDS))]
        merged = union_extracts(parts).filter(F.col("cell").isNotNull()) \
            .groupBy("data_set", "name").agg(*[
                F.bool_and(F.coalesce(fits(F.col("cell")), F.lit(False))).alias(flag)
                for flag, (_, fits) in zip(flags, _KINDS)])
        with settings(spark, spark__sql__adaptive__enabled="false"):  # one job, few rows
            rows = merged.collect()
        for r in rows:
            fits = [kind for (kind, _), f in zip(_KINDS, flags) if r[f]]
            found[r.data_set, r.name] = fits[0] if fits else T.StringType()
    return {d: T.StructType([T.StructField(c, found.get((d, c), T.StringType())) for c in dict.fromkeys(
        c for own in names.values() for c in own)]) for d, names in data_sets.items()}


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REJECT).isNull()).drop(REJECT)


def rejected_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(REJECT, F.lit("accepted")).alias("outcome")) \
        .agg(F.count(F.lit(1)).alias("rows"))


def data_set_name(path, keywords=FILE_KEYWORDS) -> str:
    """Data set a file belongs to: first keyword in its lower-cased name, else its stem."""
    base = os.path.basename(path.rstrip("/"))
    return next((name for word, name in keywords if word in base.lower()),
                os.path.splitext(base)[0])


def data_set_column(file_name, keywords=FILE_KEYWORDS):
    """The same routing as a column expression, for scans over many files."""
    lower = F.lower(file_name)
    expr = None
    for word, name in keywords:
        hit = lower.contains(word)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise(F.regexp_replace(file_name, r"\.[^.]*$", ""))


def list_files(spark: SparkSession, folder, pattern) -> DataFrame:
    """(path, file, bytes) of matching files; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(folder)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("file"),
                    F.col("length").alias("bytes")))


def ingest(spark: SparkSession, csv_paths, out_dir, schemas=SOURCE_SCHEMAS,
           multi_line=False) -> dict:
    """CSV extracts to one Parquet data set per routed name; returns name -> path.

    Files routed to the same data set are united by column name, absent ones NULL. Columns
    of known sources have fixed types and need no inference; for others the types are
    inferred over all files of the data set, so a cell that differs in one file makes its
    column text. Rejected rows are left out; ``scan_csv`` and ``rejected_counts`` tell which.
    Folders, headers and unknown types take one job each, whatever the number of files.
    """
    listed = list_csv_files(spark, csv_paths)
    names = catalogue(spark, list(dict.fromkeys(f for own in listed.values() for f in own)))
    by_name, kinds = {}, {}
    for p, own in listed.items():
        by_name.setdefault(data_set_name(p), {}).update({f: names[f] for f in own})
    for name, own in by_name.items():
        known = (schemas or {}).get(name)
        known = T.StructType.fromDDL(known) if isinstance(known, str) else known
        kinds[name] = {f.name: f for f in known or []}
    unknown = {name: own for name, own in by_name.items()
               if any(c not in kinds[name] for cells in own.values() for c in cells)}
    for name, schema in infer_schema(spark, unknown, multi_line=multi_line).items():
        kinds[name] = {**{f.name: f for f in schema}, **kinds[name]}
    out = {}
    for name, own in by_name.items():
        schema = T.StructType([kinds[name][c] for c in dict.fromkeys(
            c for cells in own.values() for c in cells)])
        df = accepted(scan_csv(spark, None, schema, multi_line=multi_line, names=own))
        out[name] = f"{out_dir}/{name}.parquet"
        write_parquet(df, out[name])
    return out


def union_extracts(frames) -> DataFrame:
    """UNION ALL of extracts by name; absent extracts (None) are skipped, absent columns NULL."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no extract to unite")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing_columns(df: DataFrame, expected):
    return [c for c in expected if c not in df.columns]


def validate(df: DataFrame, data_set=None, entity="country_std", expected=None) -> DataFrame:
    """One row: rows, columns, distinct entities, first and last period, missing columns."""
    expected = EXPECTED_COLUMNS.get(data_set, []) if expected is None else expected
    period = first_present(df, ["year", "week", "week_id"])
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.lit(len(df.columns)).alias("columns"),
            (F.count_distinct(entity) if entity in df.columns
             else F.lit(None).cast("long")).alias("entities")]
    for fn, name in ((F.min, "period_min"), (F.max, "period_max")):
        aggs.append((fn(F.col(period)) if period else F.lit(None)).cast("string").alias(name))
    return df.agg(*aggs, F.lit(",".join(missing_columns(df, expected))).alias("missing"))


def conversion_stats(spark: SparkSession, csv_path, parquet_path) -> DataFrame:
    """Bytes before and after a conversion, their ratio and the row count."""
    def size(path, pattern):
        return list_files(spark, path, pattern).agg(F.sum("bytes")).scalar()
    rows = spark.read.parquet(parquet_path).agg(F.count(F.lit(1)).alias("rows"))
    sized = rows.select("rows", size(csv_path, "*.csv").alias("bytes_in"),
                        size(parquet_path, "*.parquet").alias("bytes_out"))
    return sized.withColumn("saved", 1 - F.try_divide(F.col("bytes_out"), F.col("bytes_in")))
