"""Quality rules with a hashed n-gram likelihood ratio, DataFrame functions only (operator 6).

Two multinomials over hashed word n-grams (one and two tokens, a token being a run of
letters and digits or of other signs) are counted: the raw corpus from every document,
the trusted target from labelled documents of good quality. A document's score is the
mean over its n-grams of log p_target - log p_raw, so it does not depend on length, and
every document is held against the same fixed threshold.

Counts are combined on the map side into one row per bucket and task; the ratios form
one array of ``buckets`` values, read as a scalar. The trusted documents are a bounded
sample of the labels (``trusted_rows``), taken by a hash of their id; their ids are
broadcast. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import WHITE, packed

BUCKETS = 1 << 14
TRUSTED_ROWS = 50_000
THRESHOLD = -0.25
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOLS = r"[#*$%&|<>]"


def _words(text):
    body = F.btrim(text, F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")) \
        .otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))


def base_measures(docs: DataFrame) -> DataFrame:
    """Add the word, symbol, line and repetition measures and base_failed.

    Three-word windows are compared by a 64-bit hash; only documents with a repeated
    window are looked at further, by sorting their windows, so long ones stay
    n log n.
    """
    df = docs.withColumn("_words", _words(F.col("_text")))
    n = F.size("_words")
    hashes = F.transform(F.col("_words"), lambda w: F.xxhash64(w))
    df = df.withColumn("_h", F.when(n >= 3, hashes))
    df = df.withColumn("_g", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))))
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform(
        F.col("_g"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twin = F.transform(F.col("_s"), lambda x, k: F.when(
        (F.get("_s", k - 1)["g"] == x["g"]) | (F.get("_s", k + 1)["g"] == x["g"]), x["i"]))
    df = df.withColumn("_at", F.array_compact(twin))
    covered = F.flatten(F.transform(F.col("_at"), lambda i: F.array(i, i + 1, i + 2)))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.withColumn("_lines", lines)
    df = df.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))
        .cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 50)
                         | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _pairs(text):
    """Array of (a, b): each token and the one behind it (NULL at the end)."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return tokens, lambda t: F.arrays_zip(
        t.alias("a"), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))).alias("b"))


def _bucket(buckets, *tokens):
    return F.pmod(F.xxhash64(*tokens), F.lit(buckets)).cast("int")


def _ngrams(df: DataFrame, buckets: int) -> DataFrame:
    """One row per token with the buckets b1 (the token) and b2 (with the next one)."""
    tokens, zipped = _pairs(F.col("_text"))
    rows = df.withColumn("_t", tokens).withColumn("_p", F.explode(zipped(F.col("_t"))))
    return rows.select(*[c for c in df.columns if c != "_text"],
                       _bucket(buckets, F.col("_p.a")).alias("b1"),
                       F.when(F.col("_p.b").isNotNull(),
                              _bucket(buckets, F.col("_p.a"), F.col("_p.b"))).alias("b2"))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of at most ``rows`` documents labelled good, by the order of a hash."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    return good.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
               trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row with an array of log p_target - log p_raw per bucket.

    The raw counts are smoothed by one per bucket; the target's by as many counts in all,
    spread as the raw corpus is, so that without trusted documents all ratios are 0.
    """
    target = F.broadcast(trusted_ids(labels, trusted_rows))
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    flagged = base.join(target, base["doc_id"] == target["_id"], "left") \
        .select("_text", F.col("_id").isNotNull().cast("long").alias("hit"))
    both = _ngrams(flagged, buckets).select("hit", F.explode(F.array("b1", "b2")).alias("b")) \
        .filter("b IS NOT NULL")
    counts = both.groupBy("b").agg(F.sum("hit").alias("t"), F.count(F.lit(1)).alias("r"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "b")
    dense = every.join(counts, "b", "left").select(
        "b", F.coalesce("t", F.lit(0)).cast("double").alias("t"),
        (F.coalesce("r", F.lit(0)) + 1.0).alias("r"))
    tallies = dense.agg(F.sort_array(F.collect_list(F.struct("b", "t", "r"))).alias("c"),
                       F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    size = F.lit(float(buckets))
    return tallies.select(F.transform("c", lambda x: F.log(
        (x["t"] * F.col("nr") / x["r"] + size) / (F.col("nt") + size))).alias("ratios"))


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """All columns of ``docs`` plus the base measures, llr and kept; one row per row.

    A NULL text has no words. A text without tokens has llr 0; it is below 50 words
    and so fails the base rule. A document is kept if it passes the base rule and its
    llr is at least ``threshold``. Labels with NULLs or repeated ids count once; with
    no good label at all every llr is 0 and the base rule decides. Input columns
    named like the new ones are replaced. Carried columns must be of comparable types
    (no maps).
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "llr", "kept"]
    plain = docs.drop(*new, "_text", "_words", "_h", "_g", "_s", "_at", "_lines", "_t", "_p", "_r")
    return _once(_judged(plain, log_ratios(docs, labels, buckets, trusted_rows), buckets,
                         threshold))


def _judged(plain: DataFrame, ratios: DataFrame, buckets, threshold) -> DataFrame:
    base = base_measures(plain.withColumn("_text", F.coalesce("text", F.lit(""))))
    tokens, zipped = _pairs(F.col("_text"))
    paired = base.withColumn("_t", tokens).withColumn("_p", zipped(F.col("_t"))) \
        .withColumn("_r", ratios.scalar())
    total = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc
                        + F.get("_r", _bucket(buckets, x["a"]))
                        + F.when(x["b"].isNull(), F.lit(0.0))
                        .otherwise(F.get("_r", _bucket(buckets, x["a"], x["b"]))))
    m = F.size("_t") * 2 - 1
    return paired.withColumn("llr", F.when(m > 0, total / m).otherwise(F.lit(0.0))) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)) \
        .drop("_text", "_t", "_p", "_r")


def _once(judged: DataFrame) -> DataFrame:
    """A generator of one row: filters on the result stay above it, where the measures are done
    once, instead of being moved down with a copy of each measure for every use."""
    return judged.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in judged.columns]))))


def passing(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
            threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names.

    NULL, empty and very long texts, repeated rows and NULLs in the labels are as in
    ``score_quality``; NULL and empty texts are below the base rule and go. Only the measures that
    decide are worked out. An empty table gives no rows.
    """
    base, back = packed(docs)
    judged = _judged(base, log_ratios(docs, labels, buckets, trusted_rows), buckets, threshold)
    return back(_once(judged.select("text", "carried", "kept")).filter("kept"))
