"""Byte-level BPE encoding and decoding from a table of ranks (operator 8).

A pre-token is merged with a segment tree over its byte positions. A leaf holds the rank
of the pair that starts at its position together with the position, so the root is the
leftmost pair of lowest rank; a merge updates the leaves of the pair, of the token
swallowed and of the live neighbour before it, each in logarithmic time. Long
pre-tokens thus cost n log n. Words met before come from a cache in the worker.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import slices, texts
from panelrisk.llm.word_cache import WordCache

#: Text bytes encoded at a time.
BATCH_BYTES = 1 << 20

#: Bytes of cached words in a worker, and pre-tokens remembered within one call besides.
CACHE_BYTES = 192 << 20
MET_SIZE = 50_000

_workers: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())}


def merge_pairs(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the leftmost pair of lowest rank is merged until none is left."""
    n = len(data)
    if n < 2:
        return [ranks[data]] if n else []
    none = 1 << 62
    get = ranks.get
    size = n - 1
    tree = [none] * size
    for i in range(size):
        rank = get(data[i:i + 2])
        tree.append(none if rank is None else rank << 32 | i)
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    end = list(range(1, n + 1))     # where the token that starts here ends
    before = list(range(-1, n))     # where the token before the one that starts here starts

    def put(p, value):
        p += size
        tree[p] = value
        p >>= 1
        while p:
            a, b = tree[2 * p], tree[2 * p + 1]
            if b < a:
                a = b
            if tree[p] == a:
                return
            tree[p] = a
            p >>= 1

    while (best := tree[1]) < none:
        i = best & 0xFFFFFFFF
        j = end[i]
        after = end[j]
        end[i] = after
        if j < size:
            put(j, none)
        if after < n:
            before[after] = i
            rank = get(data[i:end[after]])
            put(i, none if rank is None else rank << 32 | i)
        else:
            put(i, none)
        if i:
            h = before[i]
            rank = get(data[h:after])
            put(h, none if rank is None else rank << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ranks, pattern and the one cache of words, built once per worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.cache = WordCache(self.encode_all, most_bytes=CACHE_BYTES)

    def _pre_token(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else merge_pairs(data, self.ranks)
        return array("I", ids).tobytes()

    def encode_all(self, strings):
        """Ids of each string; a pre-token that is a cached word is not merged again."""
        known, met, out = self.cache.known, {}, []
        for s in strings:
            ids = []
            for piece in self.pattern.findall(s):
                own = known.get(piece) or met.get(piece)
                if own is None:
                    own = met[piece] = self._pre_token(piece)
                ids.append(own)
            out.append(b"".join(ids))
            if len(met) > MET_SIZE:
                met = {}
        return out

    def ids(self, column):
        """Ids of a column of texts, about ``BATCH_BYTES`` of text at a time."""
        for a, b in slices(pc.binary_length(column).to_pylist(), BATCH_BYTES):
            yield a, b, self.cache.ids(column.slice(a, b - a).to_pylist())


class Decoder:
    """The bytes of each id."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _kept(kind, *key):
    if (kind, key) not in _workers:
        _workers[kind, key] = kind(*key)
    return _workers[kind, key]


def _base(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, one row per row.

    A NULL or empty text has no ids; a NULL doc_id stays NULL. Texts are encoded whole,
    whatever their length; control strings are ordinary text. A byte without a rank stops
    the job. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        own = _kept(Encoder, ranks_path, pattern)
        for batch in batches:
            for a, b, ids in own.ids(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())],
                    ["doc_id", "ids"])

    return _base(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded`` (binary): the bytes that the ids stand for."""

    def run(batches):
        own = _kept(Decoder, ranks_path)
        for batch in batches:
            lengths = pc.binary_length(batch.column("ids")).to_pylist()
            for a, b in slices(lengths, BATCH_BYTES):
                part = batch.slice(a, b - a)
                data = [own.decode(v.as_buffer()) for v in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())],
                                                 [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one step, so one worker a task."""

    def run(batches):
        coder, back = _kept(Encoder, ranks_path, pattern), _kept(Decoder, ranks_path)
        for batch in batches:
            for a, b, ids in coder.ids(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary()),
                     pa.array([back.decode(v) for v in ids], pa.binary())],
                    ["doc_id", "ids", "decoded"])

    return _base(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
