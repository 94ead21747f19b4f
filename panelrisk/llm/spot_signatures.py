"""SpotSigs fingerprints with DataFrame functions only (operator 5).

A common word (anchor) and the chain of content words behind it form a signature; the set
of a text's signatures is its fingerprint. Sets are compared by Jaccard, after a look at
their lengths: two sets can be no more alike than the shorter is to the longer.

With the anchors' positions P in order, P[j] - j content words stand before anchor j, so a
chain is read off the array of content words without a search. A text without any anchor
takes each word as one; a text too short for a chain is one signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import unique_ids
from panelrisk.operators.ordered import global_index

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or "
    "that the their they this to was were which will with you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen "
    "einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von "
    "vor war was wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous "
    "on ou où par pas pour qui que sa se ses son sur un une vous "
    "al como con cual cuando del desde donde el ella en entre era es esta este fue ha hay la las "
    "lo los más me mi muy no nos o para pero por que se si sin sobre su sus también te un una y ya"
).split()


def signatures(df: DataFrame, text: str, out: str, chain: int = 2, anchors=ANCHORS) -> DataFrame:
    """Add ``out``: the sorted distinct signature hashes of a text column."""
    w, p, c, k = (f"_{x}_{out}" for x in "wpck")
    common = sorted(set(anchors))
    body = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))
    df = df.withColumn(w, words)
    df = df.withColumn(p, F.array_compact(F.transform(
        w, lambda x, i: F.when(x.isin(common), i))))
    df = df.withColumn(c, F.filter(w, lambda x: ~x.isin(common)))

    def link(first, at):
        return F.xxhash64(first, *[F.get(c, at + d) for d in range(chain)])

    spots = F.transform(p, lambda i, j: F.when(i - j + chain <= F.size(c),
                                               link(F.get(w, i), i - j)))
    every = F.transform(w, lambda x, i: F.when(
        i + chain < F.size(w), F.xxhash64(x, *[F.get(w, i + 1 + d) for d in range(chain)])))
    df = df.withColumn(k, F.array_compact(F.when(F.size(p) > 0, spots).otherwise(every)))
    short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))) \
        .otherwise(F.array().cast("array<bigint>"))
    found = F.when(F.size(k) > 0, F.sort_array(F.array_distinct(k))).otherwise(short)
    return df.withColumn(out, found).drop(w, p, c, k)


def as_text(sig: str) -> Column:
    """A fingerprint as text: signatures in hexadecimal, in order."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), " ")


def likeness(a: str, b: str, floor: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without comparing if their lengths rule ``floor`` out.

    Two empty sets are alike (1); an empty and another are not (0).
    """
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(long == 0, F.lit(1.0)) \
        .when((short == 0) | (short < floor * long), F.lit(0.0)) \
        .otherwise(shared / (F.size(a) + F.size(b) - shared))


def next_documents(base: DataFrame) -> DataFrame:
    """(this, n, next): each document's code points and the id behind it in falling order.

    The last is followed by the first. Only ids and lengths are sorted.
    """
    narrow = base.select("doc_id", F.char_length("text").alias("n"))
    placed = global_index(narrow, [F.col("doc_id").desc()], "r")
    after = placed.select(F.col("doc_id").alias("next"), F.col("r").alias("at"))
    return placed.select(F.col("doc_id").alias("this"), "n",
                         ((F.col("r") + 1) % F.col("r_total")).alias("at")) \
        .join(after, "at").select("this", "n", "next")


def spot_fingerprints(docs: DataFrame, chain: int = 2) -> DataFrame:
    """(doc_id, n_chars, edited, sig, edited_sig, next_sig), one row per row of ``docs``.

    ``edited`` is the text whose last third is replaced by the start of the next document.
    A NULL text is empty. Rows that share a doc_id are ordered by their texts; rows
    without one come last in the falling order. A single document is its own next. Other columns are
    ignored; an empty table gives no rows. Texts are shuffled once, since both joins
    use the same exchange; of the next document only the start that is needed and its
    signatures travel on.
    """
    base, named = unique_ids(docs)
    pairs = next_documents(base)
    third = F.floor(F.col("n") / 3).cast("int")
    # signatures are made behind the exchange, which then is the same for both joins
    behind = signatures(base.join(pairs, F.col("doc_id") == F.col("next")), "text", "next_sig",
                        chain) \
        .select("this", "n", F.substring("text", F.lit(1), third).alias("head"), "next_sig")
    both = base.join(behind, F.col("doc_id") == F.col("this"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), "head")
    both = both.select("doc_id", "text", F.col("n").cast("long").alias("n_chars"),
                       edited.alias("edited"), "next_sig")
    full = signatures(signatures(both, "text", "sig", chain), "edited", "edited_sig", chain)
    return named(full.drop("text"))


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"))
