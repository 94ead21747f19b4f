"""Token counts by a two-tier lookup on the map side (operator 3).

A sentencepiece BPE model never merges across the start of a word: no piece has
the word mark after another character (checked when the model is loaded), and
its normaliser acts on single characters. A text is therefore the sum of its
words, where a word is a run of spaces with the non-spaces behind it.

Tier one is a compact table of frequent words and their lengths, broadcast. It comes from
all whole texts: each task keeps a bounded heavy-hitter summary (Misra-Gries), and these
summaries are merged. Tier two is a cache in each Python worker that is filled as words
are met. Neither decides a result: a word that is in no tier is encoded by the library. Words
of texts are never shuffled; only the summaries are.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import texts

#: Words in the broadcast table, and counters in a task's summary. A word that makes up more than
#: one part in SUMMARY_SIZE of a task's words is always in its summary.
TABLE_SIZE = 50_000
SUMMARY_SIZE = 50_000
#: Words in a worker's cache before it starts anew, and the longest word kept in it.
CACHE_SIZE = 400_000
CACHED_CHARS = 64

MARK = "▁"
#: One or more spaces (or marks, which the model treats alike) in a row, or a mark.
_ODD_SPACES = re.compile(f"  |{MARK}|^ | $")
_WORD = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+$")

_models: dict = {}
_caches: dict = {}


def _model(path):
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = [p for p in map(model.id_to_piece, range(model.vocab_size()))
                 if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces cross the start of a word: {inner[:3]}")
        if not model.encode("a", out_type=str)[0].startswith(MARK):
            raise ValueError("the model must put a word mark before the first word")
        _models[path] = model
    return _models[path]


def thinned(counts: Counter, size: int) -> Counter:
    """At most ``size`` counters: all lowered by the count that comes after those, as Misra-Gries."""
    if len(counts) <= size:
        return counts
    floor = heapq.nlargest(size + 1, counts.values())[-1]
    return Counter({w: n - floor for w, n in counts.items() if n > floor})


def frequent_words(docs: DataFrame, size=TABLE_SIZE, summary=SUMMARY_SIZE):
    """The most frequent words of all texts, for the broadcast table; at most ``size``."""

    def summarise(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(text.as_py().split(" "))
                if len(seen) > 4 * summary:
                    seen = thinned(seen, summary)
        kept = [(w, n) for w, n in thinned(seen, summary).items()
                if w and len(w) <= CACHED_CHARS and MARK not in w]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*kept), (pa.string(), pa.int64()))], ["word", "n"])

    merged = texts(docs).select("text").mapInArrow(summarise, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in merged.orderBy(F.desc("n"), "word").limit(size).collect()]


class _Counter:
    def __init__(self, path, frequent):
        self.model = _model(path)
        self.frequent = frequent
        self.cache = _caches.setdefault(path, {})

    def _encode(self, words):
        # the empty word is a lone mark at the end of a text
        return [len(ids) if w else 1
                for w, ids in zip(words, self.model.encode(words, num_threads=1))]

    def _learn(self, words):
        new = list(set(words))
        if len(self.cache) + len(new) > CACHE_SIZE:
            self.cache.clear()
        found = dict(zip(new, self._encode(new)))
        self.cache.update((w, n) for w, n in found.items() if len(w) <= CACHED_CHARS)
        return found

    def counts(self, batch):
        """Token counts of a list of texts."""
        out, open_words, missing = [], [], []
        for text in batch:
            if _ODD_SPACES.search(text):
                # runs of spaces: words with their spaces, the leading one being implied
                words = _WORD.findall(" " + text) if text else []
                words = [w[1:] for w in words]
            else:
                words = text.split(" ") if text else []
            found = list(map(self.frequent.get, words))
            if None in found:
                late = [w for w, n in zip(words, found) if n is None]
                again = list(map(self.cache.get, late))
                lost = [w for w, n in zip(late, again) if n is None]
                out.append(sum(filter(None, found)) + sum(filter(None, again)))
                open_words.append(lost)
                missing.extend(lost)
            else:
                out.append(sum(found))
                open_words.append(())
        if missing:
            found = self._learn(missing)
            for i, lost in enumerate(open_words):
                if lost:
                    out[i] += sum(map(found.__getitem__, lost))
        return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, **tier) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A NULL text is the empty text with 0 tokens. Every row of the table gives a
    row, also when a doc_id repeats. Texts are never cut; a long word or text is
    encoded whole. Strings of control symbols inside a text are ordinary text, as
    the library has it. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, **tier)
    lengths = [len(ids) for ids in _model(model_path).encode(words, num_threads=1)]
    table = spark.sparkContext.broadcast(dict(zip(words, lengths)))

    def run(batches):
        counter = _Counter(model_path, table.value)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            n = []
            for i in range(0, len(rows), 256):
                n += counter.counts(rows[i:i + 256])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    base = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")) \
        .withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
