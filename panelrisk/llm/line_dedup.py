"""Line dedup across documents with DataFrame functions only (operator 2).

Lines long enough to count are exploded, normalised and hashed; distinct documents
are counted per hash with map-side combine; of a line found in too many documents
only the largest doc_id keeps it; the positions to drop go back to their document,
which is put together again by position. Only hashes, ids and positions are
shuffled for counting, never line texts; a hot line is reduced to one row per task
before the shuffle, and the join that returns its positions is a plain equi-join,
whose skewed partitions Spark splits.

A key is told by two independent 64-bit hashes, so that unequal lines do not meet
by chance at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import WHITE, packed, texts
from panelrisk.session import pin

#: A line that makes up at least this part of all long lines is looked up without a shuffle.
HOT_PARTS = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else as it is. Text that is ASCII only takes the fast built-in."""
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _occurrences(base: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of each line that is long enough."""
    lines = base.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .filter(F.octet_length("line") >= min_chars) \
        .withColumn("line", F.btrim("line", F.lit(WHITE))) \
        .filter(F.char_length("line") >= min_chars) \
        .withColumn("line", lower_ascii(F.col("line")))
    return lines.select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit(1), "line").alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, th, drop): positions of the lines that each document loses.

    ``th`` is the hash of the text, so that rows sharing a doc_id but not a text
    keep their positions apart.
    """
    keys = ["h1", "h2"]
    seen = pin(_occurrences(texts(docs).withColumn("th", F.xxhash64("text")), min_chars))
    frequent = pin(
        seen.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"),
                            F.max("doc_id").alias("keeper"))
        .filter(F.col("docs") >= min_docs).select(*keys, "n", "keeper"))
    # no more than HOT_PARTS keys can have so many of the rows; the others have fewer each
    is_hot = F.col("n") * HOT_PARTS >= seen.count()
    hot = F.broadcast(frequent.filter(is_hot))
    lost = seen.join(hot, keys).unionByName(
        seen.join(hot, keys, "left_anti").join(frequent.filter(~is_hot), keys)) \
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` plus n_lines, n_dropped and kept_text.

    A NULL or empty text is one empty line. Rows that repeat a doc_id count as one
    document and lose the same lines. Documents without a doc_id count as one
    document and lose their frequent lines if any other document has them. Texts of any length
    are taken whole. Columns of the input named like the new ones are replaced. An empty table
    gives no rows.
    """
    new = ["n_lines", "n_dropped", "kept_text"]
    drop = dropped_positions(docs, min_chars, min_docs) \
        .withColumnsRenamed({"doc_id": "_d", "th": "_h", "drop": "_drop"})
    full = docs.drop(*new, "_d", "_h", "_drop") \
        .withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    joined = full.join(drop, F.col("doc_id").eqNullSafe(F.col("_d"))
                       & (F.xxhash64("_text") == F.col("_h")), "left")
    lines = F.split("_text", "\n")
    cut = joined.withColumn("_lines", lines)
    # array_except is one pass with a hash set, so very long documents stay linear
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return cut.withColumn("n_lines", F.size("_lines").cast("long")) \
        .withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long")) \
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long"))) \
        .withColumn("kept_text", F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept)) \
        .drop("_text", "_lines", "_drop", "_d", "_h")


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the kept lines as ``text``, all other columns as they are; n_chars anew.

    NULL and empty texts, repeated ids and rows, very long texts and empty tables are as in
    ``dedup_lines``; a NULL text becomes the empty text. Columns of any name are carried.
    """
    base, back = packed(docs)
    return back(dedup_lines(base, min_chars, min_docs), "kept_text")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped",
                         F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.pos, d.line, f.k IS NOT NULL AND f.keeper <> d.doc_id AS gone
  FROM keyed d LEFT JOIN frequent f ON d.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
