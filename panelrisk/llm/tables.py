"""Reading the given tables and small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators.ordered import global_index

WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text) with a NULL text as the empty text; other columns are left behind."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(lengths, limit):
    """(start, end) of consecutive runs whose lengths add up to about ``limit``.

    A single item over the limit makes a run of its own.
    """
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def packed(docs: DataFrame):
    """``docs`` as (doc_id, text, carried), and the way back from such rows to its own columns.

    All other columns travel in one struct, so an operator's own names can never meet theirs.
    The way back takes the new text (a column or name) and counts ``n_chars`` anew if it changed.
    """
    others = [c for c in docs.columns if c != "text"]
    base = docs.select("doc_id", "text",
                       F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried"))

    def back(df: DataFrame, text="text"):
        new = {"text": F.col(text)}
        if text != "text" and "n_chars" in others:
            new["n_chars"] = F.char_length(text).cast("long")
        return df.select(*[new[c].alias(c) if c in new else F.col(f"carried.`{c}`").alias(c)
                           for c in docs.columns])

    return base, back


_NO_ID = -(1 << 63)


def unique_ids(docs: DataFrame):
    """(doc_id, text) with ids that are unique and not NULL, and the way back to the given ones.

    Usually the given ids serve, with a stand-in for one that is missing. Where ids repeat
    (a small job looks while the plan is built), rows are numbered by doc_id and text, so
    that rows sharing an id are ordered by their texts and a repeated row is a later copy.
    """
    base = texts(docs).select(F.col("doc_id").cast("long").alias("given"), "text")
    filled = F.coalesce("given", F.lit(_NO_ID).cast("long"))
    twice = base.groupBy(filled.alias("id")).count().filter("count > 1")
    if twice.isEmpty():
        return base.select(filled.alias("doc_id"), "text"), lambda df: df.withColumn(
            "doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
    rows = global_index(base, ["given", "text"], "doc_id").drop("doc_id_total")
    names = rows.select(F.col("doc_id").alias("_id"), "given")
    return rows.select("doc_id", "text"), lambda df: df.join(
        names, df["doc_id"] == names["_id"]).withColumn("doc_id", F.col("given")) \
        .drop("_id", "given")


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` plus a row id that is unique and not NULL, in the order of doc_id.

    Numbered as in ``unique_ids``: the given ids serve as long as they are unique; where they
    repeat, the rows are written once with their places by doc_id and text.
    """
    given = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long"))
    twice = docs.groupBy(given.alias("id")).count().filter("count > 1")
    if twice.isEmpty():
        return docs.withColumn(name, given)
    rows = global_index(docs.select(F.struct("*").alias("_all")),
                        [F.col("_all.doc_id").cast("long"),
                         F.coalesce(F.col("_all.text"), F.lit(""))], name)
    return rows.select("_all.*", name)
