"""Best-fit packing planned on a histogram of lengths (operator 9).

The plan needs lengths only: best fit in falling order of length is worked out over
counts ("so many pieces of this length into so many sequences with this room left"),
at most ``capacity`` lengths, on the driver. It gives segments: the pieces of one length
with ranks from lo to hi go to sequences from a first number on, so many in each, from an
offset on. Every piece then takes its slot by joining on its length and its rank among
the pieces of that length. Ranks are counted per task first, so no length is ever
gathered or sorted in one place.
"""

from __future__ import annotations

import bisect
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.tables import slices, texts
from panelrisk.llm.word_cache import ENTRY_BYTES, WordCache
from panelrisk.session import pin

#: Text bytes whose words are looked up at a time, and about the bytes of unknown words or
#: of texts without plain words that the tokenizer takes at a time.
BATCH_BYTES = 4 << 20
ENCODED_BYTES = 1 << 20
#: Bytes of cached words in a worker.
CACHE_BYTES = 192 << 20
_caches: dict = {}

#: A word of letters, led by a space or not; beyond Latin letters Unicode versions differ.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: The characters that byte-level tokenizers show bytes as, by byte.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _byte_level(tokenizer) -> bool:
    """Whether the tokenizer cuts texts by the byte-level pattern only."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    cut = tokenizer.pre_tokenizer
    return tokenizer.normalizer is None and isinstance(tokenizer.model, BPE) \
        and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space


def encoder(tokenizer):
    """``encode(strings)``: the ids of each as bytes, little-endian unsigned 32-bit.

    A string that is one word of letters is never cut by the byte-level pattern, so it goes to
    the tokenizer's model at once, in the characters that stand for its bytes.
    """
    tokens = tokenizer.model.tokenize
    word = _WORD.fullmatch if _byte_level(tokenizer) else lambda text: None

    def encode(strings):
        out, others = [], []
        for at, text in enumerate(strings):
            if word(text):
                shown = text.replace(" ", "Ġ") if text.isascii() else \
                    text.encode().decode("latin-1").translate(_SHOWN)
                out.append(array("I", [t.id for t in tokens(shown)]).tobytes())
            else:
                others.append(at)
                out.append(b"")
        for a, b in slices([ENTRY_BYTES + len(strings[i]) for i in others], ENCODED_BYTES):
            found = tokenizer.encode_batch_fast([strings[i] for i in others[a:b]],
                                                add_special_tokens=False)
            for i, e in zip(others[a:b], found):
                out[i] = array("I", e.ids).tobytes()
        return out

    return encode


def _cache(path: str) -> WordCache:
    if path not in _caches:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _caches[path] = WordCache(encoder(tokenizer),
                                  lambda text: any(s in text for s in special),
                                  most_bytes=CACHE_BYTES)
    return _caches[path]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2,
           capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids): documents as token pieces of at most ``capacity``.

    The ids (little-endian unsigned 32-bit) end with ``end_id``, so a NULL or empty text
    is one piece of length 1. Only longer documents are cut, with the shorter piece first.
    Rows that repeat a doc_id are documents of their own. Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache = _cache(tokenizer_path)
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in slices(pc.binary_length(column).to_pylist(), BATCH_BYTES):
                rows = []
                for doc, data in zip(ids[a:b], cache.ids(column.slice(a, b - a).to_pylist())):
                    data += end
                    n = len(data) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    rows += [(doc, k, x, y - x, data[4 * x:4 * y])
                             for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "piece", "start", "length", "ids"])

    base = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = 1024):
    """Segments (length, lo, hi, sequence, per, offset) of best fit in falling order.

    Sequences are told apart only by the room they have left; all with the same history
    are one group, so the work grows with the number of lengths, not of pieces.
    """
    room: dict[int, list] = {}      # room left -> groups (first sequence, how many)
    rooms: list[int] = []           # sorted
    segments, opened = [], 0

    def give(r, first, n):
        if n and r:
            if r not in room:
                bisect.insort(rooms, r)
                room[r] = []
            room[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                n = -(-left // per)
                give(capacity, opened, n)
                opened += n
                continue
            r = rooms[at]
            first, n = room[r].pop()
            if not room[r]:
                del room[r], rooms[at]
            per = r // length
            full = min(n, left // per)
            if full:
                segments.append((length, rank, rank + full * per, first, per, capacity - r))
                rank, left = rank + full * per, left - full * per
                give(r - per * length, first, full)
                first, n = first + full, n - full
            if n and 0 < left < per:
                segments.append((length, rank, rank + left, first, left, capacity - r))
                give(r - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            give(r, first, n)
    return segments


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to ``capacity``.

    The rows are written once to the shared folder, since their order inside a task is
    what they are ranked by. One row per row; other columns are carried along. The
    segments broadcast at the end number at most ``capacity`` squared.
    """
    spark = parts.sparkSession
    rows = pin(parts.withColumn("_task", F.spark_partition_id())
               .withColumn("_at", F.monotonically_increasing_id()))
    own = Window.partitionBy("_task", "length").orderBy("_at")
    per_task = rows.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("_task", "length",
                              F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1) \
        .join(offsets, ["_task", "length"]) \
        .withColumn("_rank", F.col("_own") + F.col("_before"))
    counts = {r.length: r.n for r in
              rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, capacity), "_l long, _lo long, _hi long, _seq long, _per long, _off long")
    inside = (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_lo")) \
        & (F.col("_rank") < F.col("_hi"))
    place = F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(slots), inside).select(
        *parts.columns,
        (F.col("_seq") + F.floor(place / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_off") + place % F.col("_per") * F.col("length")).cast("long").alias("offset"))


def packed_digest(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """Pieces with their slots, the ids as their CRC-32."""
    parts = pieces(docs, tokenizer_path, capacity=capacity) \
        .withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(parts, capacity)


def packed_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2,
                  capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): tokens ready for training.

    ``ids`` are little-endian unsigned 32-bit. The pieces are written once; the plan is made over
    (row, length) alone and joined to them, so ids move once. NULL and empty texts are one
    piece of ``end_id``; repeated rows and missing doc_ids are documents of their own; other
    columns are left out. An empty table gives no rows.
    """
    rows = pin(pieces(docs, tokenizer_path, end_id, capacity)
               .withColumn("row", F.monotonically_increasing_id()))
    places = pack(rows.select("row", "length"), capacity).drop("length")
    return rows.join(places, "row").drop("row")
