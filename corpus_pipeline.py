"""Corpus pipeline over ``documents``: from raw texts to packed token sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``, and
carry whatever other columns there are, of any name. Texts are handled whole, whatever their
length; an empty table gives an empty table in every stage.
"""

from __future__ import annotations

import public_tokenizers

from panelrisk.llm import line_dedup, packing, quality_rules, simhash_groups, suffix_dedup
from panelrisk.llm.tables import table
from panelrisk.session import delete, owned_pins, scratch


def quality(spark, docs, sf_dir):
    """Documents that pass the quality rules; the trusted target comes from ``labels``.

    NULL and empty texts are below 50 words and go. Rows that repeat are judged each, alike.
    Labels with NULLs count as not trusted; without any the base rule decides.
    """
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Lines found in many documents stay in the one with the largest doc_id.

    Rows that share a doc_id are one document and keep the line in each; rows without one
    lose it. A NULL text becomes the empty text. No row goes.
    """
    return line_dedup.without_repeated_lines(docs)


def near_copies(spark, docs, sf_dir):
    """The document with the smallest doc_id of each group of near copies.

    Of rows that share a doc_id the smallest text comes first; equal rows leave one. Texts without
    words (NULL, empty, blank) are near copies of each other. Rows without a doc_id stay.
    """
    return simhash_groups.one_of_each(docs)


def passages(spark, docs, sf_dir):
    """Passages of 100 bytes and more stay where they stand first, by doc_id and text.

    Rows without a doc_id come first. A repeated row is a later copy, which loses its text but stays
    a row. A NULL text becomes the empty text.
    """
    return suffix_dedup.without_repeats(docs)


def sequences(spark, docs, sf_dir):
    """Token pieces (their ids little-endian unsigned 32-bit) with places in sequences of 1024.

    A NULL or empty text is one piece that holds the end token. Rows that repeat, or have no doc_id,
    are packed each; columns other than doc_id and text end here.
    """
    return packing.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies),
          ("passages", passages), ("sequences", sequences)]

#: Near copies, suffix runs and tokens cannot be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. A stage's copy goes when the next one is written, the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with owned_pins(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
