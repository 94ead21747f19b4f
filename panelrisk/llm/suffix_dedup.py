"""Exact substring dedup by a distributed merge of front-coded suffix runs (operator 1).

A byte goes if it lies in a ``span``-byte string that also starts earlier (smaller
doc_id, or earlier in the same document). Each such string ("window") is tied to one
suffix: the one that starts at the smallest hash among the window's K-byte strings
("anchor"). Equal windows have equal anchors at equal distance, so it is enough to sort
the suffixes at anchors, about one in 35, together with the few bytes before them.

1. Anchors: their K-byte hashes are counted. A hash seen once decides all windows of its
   anchor (they are unique), which leaves out almost all suffixes of text that does not
   repeat. Hashes are cut into ``parts``; each batch sends one packed row per part, and of
   a hot hash one witness only.
2. Runs: each task sorts its remaining suffixes, settles windows that repeat inside the
   run, and sends the rest as front-coded runs (bytes shared with the suffix before are
   left out), one run per part.
3. Merge: a loser tree combines the runs of a part. Every run keeps the length of the
   prefix it shares with the last winner, so known prefixes are never compared again and
   the merged order comes with its common-prefix lengths. From these follows, for every
   distance between window and anchor, which windows are equal; the earliest stays.
4. The runs of removed bytes go back to their document.

Hot anchors (a passage that a third of all documents share, in ever new surroundings) are
told by a hash that is frequent inside one batch: so frequent that, were it so in all
batches, a part would gather more than ``hot_rows`` suffixes. Their windows are sent one by one as
suffixes of their own, spread by a hash of the whole window, of which a run holds one copy
at most; so no part gathers a hot group. All of this is exact, with no cap on copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import packed, shuffle_width, slices, texts, unique_ids, with_row_ids

#: Bytes that an anchor's hash covers; windows of ``span`` bytes choose among span - K + 1 anchors.
K = 32
#: Most rows that one hash may bring to a part; beyond, it counts as hot everywhere.
HOT_ROWS = 250_000
#: Text bytes handled at a time, and positions hashed at a time.
BATCH_BYTES = 8 << 20
CHUNK = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position (K is a power of two)."""
    h = _TABLE[data]
    step = 1
    while step < K:
        h = h[:-step] * _MIX + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _anchors(data: np.ndarray, span: int):
    """(position, hash, low, high): windows at position - high .. position - low choose it.

    Only windows inside ``data`` count. Worked in overlapping chunks; an anchor cut by
    a chunk's end comes twice, each time with its own windows.
    """
    width = span - K + 1
    out = []
    for at in range(0, max(0, len(data) - span + 1), CHUNK):
        h = _hashes(data[at:at + CHUNK + span - 1])
        # the low 7 bits tell how far behind the window's start the smallest hash is
        key = h & ~np.uint64(127)
        have = 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:] + np.uint64(have))
            have *= 2
        if have < width:
            rest = width - have
            key = np.minimum(key[:-rest], key[rest:] + np.uint64(rest))
        away = (key & np.uint64(127)).astype(np.int64)
        pos = np.arange(len(key)) + away
        first = np.concatenate(([0], np.flatnonzero(pos[1:] != pos[:-1]) + 1))
        last = np.concatenate((first[1:], [len(pos)])) - 1
        out.append((pos[first] + at, h[pos[first]], away[last], away[first]))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64),
                np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(pos, low, high):
    return pos << 14 | low << 7 | high


def _unpack(x):
    return x >> 14, x >> 7 & 127, x & 127


def _split_by(which, parts, *arrays):
    """(part, arrays of it) for each part that occurs."""
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(parts + 1))
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
        rows = order[cuts[p]:cuts[p + 1]]
        yield int(p), [a[rows] for a in arrays]


# --- step 1: which anchors occur more than once --------------------------------------------

_SEEN = "part int, doc_id long, at binary, hash binary, doc binary, many binary"


def _seen_rows(span, parts, local_hot):
    """Rows of kind (part, hashes, docs, packed) and, for hot hashes, rows per document."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            column = batch.column("text")
            sizes = [len(v.as_buffer()) for v in column]
            for a, b in slices(sizes, BATCH_BYTES):
                found = [_anchors(np.frombuffer(column[i].as_buffer(), np.uint8), span)
                         for i in range(a, b)]
                n = [len(f[0]) for f in found]
                if not sum(n):
                    continue
                pos, h, low, high = (np.concatenate(x) for x in zip(*found))
                doc, packed = np.repeat(ids[a:b], n), _pack(pos, low, high)
                _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
                hot = counts[inverse] >= local_hot
                # a hot hash sends its first row as a witness, the rest needs no answer
                order = np.argsort(inverse, kind="stable")
                firsts = np.zeros(len(h), bool)
                firsts[order[np.concatenate(([0], np.cumsum(counts)[:-1]))]] = True
                send = ~hot | firsts
                rows = []
                for p, (hh, dd, pp, mm) in _split_by(
                        (h[send] % np.uint64(parts)).astype(np.int64), parts, h[send],
                        doc[send], packed[send], hot[send]):
                    rows.append((p, None, pp.tobytes(), hh.tobytes(), dd.tobytes(),
                                 np.packbits(mm).tobytes()))
                rest = hot & ~firsts
                if rest.any():
                    for p, (dd, pp) in _split_by(np.abs(doc[rest] % parts), parts, doc[rest],
                                                 packed[rest]):
                        rows.append((p, 0, pp.tobytes(), None, dd.tobytes(), None))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("part", "doc_id", "at", "hash", "doc", "many"), r)) for r in rows],
                    schema=pa.schema([("part", pa.int32()), ("doc_id", pa.int64()),
                                      ("at", pa.binary()), ("hash", pa.binary()),
                                      ("doc", pa.binary()), ("many", pa.binary())]))

    return run


def _join(column, dtype):
    return np.frombuffer(b"".join(column), dtype)


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors of a part whose hash occurs more than once; hot ones as negative values."""
    known = pdf[pdf["hash"].isna()]
    doc, at = [_join(known["doc"], np.int64)], [-1 - _join(known["at"], np.int64)]
    asked = pdf[pdf["hash"].notna()]
    if len(asked):
        h = _join(asked["hash"], np.uint64)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x) // 8)
                               for m, x in zip(asked["many"], asked["hash"])]).astype(bool)
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        hot = np.zeros(len(counts), bool)
        hot[inverse[many]] = True
        twice = (counts > 1) | hot
        keep, is_hot = twice[inverse], hot[inverse]
        own = _join(asked["at"], np.int64)
        doc.append(_join(asked["doc"], np.int64)[keep])
        at.append(np.where(is_hot, -1 - own, own)[keep])
    return pd.DataFrame({"doc_id": np.concatenate(doc), "at": np.concatenate(at)})


# --- steps 2 and 3: runs, merge, equal windows ---------------------------------------------

class _Suffixes:
    """Suffixes in sorted order: ``right`` (n x span bytes), ``left`` (n x width - 1, reversed),
    document, anchor position, and the range of windows (low..high before the anchor)."""

    def __init__(self, right, left, doc, pos, low, high):
        self.right, self.left, self.doc, self.pos = right, left, doc, pos
        self.low, self.high = low, high

    def take(self, rows):
        return _Suffixes(self.right[rows], self.left[rows], self.doc[rows], self.pos[rows],
                         self.low[rows], self.high[rows])

    def __len__(self):
        return len(self.doc)

    @staticmethod
    def concat(many):
        return _Suffixes(*(np.concatenate([getattr(m, k) for m in many])
                           for k in ("right", "left", "doc", "pos", "low", "high")))


def _order(matrix):
    return np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(),
                      kind="stable")


def _lcp(matrix):
    """Bytes that each row shares with the one before (0 for the first)."""
    out = np.zeros(len(matrix), np.int64)
    if len(matrix) > 1:
        differ = matrix[1:] != matrix[:-1]
        at = differ.argmax(axis=1)
        at[~differ.any(axis=1)] = matrix.shape[1]
        out[1:] = at
    return out


def _repeats(s: _Suffixes, lcp, span):
    """n x width booleans: the window that starts that far before the anchor has an earlier twin.

    Two windows at the same distance o are equal if their suffixes share span - o bytes
    and the bytes before them share o; both are told from common-prefix lengths in sorted
    order. Within the rows of a class the earliest (document, position) is no repeat.
    """
    n, width = len(s), span - K + 1
    out = np.zeros((n, width), bool)
    if n < 2:
        return out
    near = np.concatenate((lcp[1:] >= K, [False])) | (lcp >= K)
    age = np.lexsort((s.pos, s.doc))
    age = age[near[age]]
    left_order = _order(s.left)
    left_lcp = _lcp(s.left[left_order])
    left_class = np.empty(n, np.int64)
    for o in range(width):
        rows = age[(s.low[age] <= o) & (o <= s.high[age])]
        if len(rows) < 2:
            continue
        left_class[left_order] = np.cumsum(left_lcp < o)
        right_class = np.cumsum(lcp < span - o)
        key = right_class[rows] * np.int64(n + 1) + left_class[rows]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(rows), bool)
        later[first] = False
        out[rows[later], o] = True
    return out


def _spans(s: _Suffixes, repeats, span):
    """(doc_id, start, end) of the bytes that repeated windows cover, one per run of distances."""
    edge = np.diff(np.pad(repeats.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edge == 1)
    _, behind = np.nonzero(edge == -1)
    return _union(s.doc[rows], s.pos[rows] - (behind - 1), s.pos[rows] - first + span)


def _union(doc, start, stop):
    """Ranges of the same document that touch made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if len(doc) < 2:
        return doc, start, stop
    # shifting each document beyond the one before makes one running maximum do for all
    shift = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    head = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(head)[1:], [len(doc)])) - 1
    return doc[head], start[head], reach[last] - shift[last]


def _windows(data, doc, at, span):
    """Suffixes of one document at the packed anchors ``at``; hot ones window by window."""
    width = span - K + 1
    hot = at < 0
    pos, low, high = _unpack(np.where(hot, -1 - at, at))
    n = (high - low + 1)[hot]
    start = np.repeat(pos[hot] - high[hot], n) + np.arange(n.sum()) - np.repeat(
        np.cumsum(n) - n, n)
    alone = len(start)
    anchor = np.concatenate((pos[~hot], start))
    none = np.zeros(alone, np.int64)
    padded = np.pad(data, (width, span))
    right = padded[anchor[:, None] + (width + np.arange(span))]
    left = padded[anchor[:, None] + (width - 1 - np.arange(width - 1))]
    left[len(anchor) - alone:] = 0
    return _Suffixes(right, left, np.full(len(anchor), doc), anchor,
                     np.concatenate((low[~hot], none)), np.concatenate((high[~hot], none))), \
        np.arange(len(anchor)) >= len(anchor) - alone


def _front_code(s: _Suffixes):
    """A sorted run as bytes: shared lengths, the bytes that differ, and the fixed fields."""
    lcp = _lcp(s.right)
    keep = np.arange(s.right.shape[1]) >= lcp[:, None]
    fields = np.stack((s.doc, _pack(s.pos, s.low, s.high)))
    return zstandard.ZstdCompressor(level=3).compress(
        lcp.astype(np.uint8).tobytes() + fields.tobytes() + s.left.tobytes()
        + s.right[keep].tobytes()), len(s)


def _decode(blob, n, span):
    """Lists (lcp, suffix bytes) and the remaining fields of a run."""
    width = span - K
    head = n * (1 + 16 + width)
    raw = memoryview(blob)
    lcp = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    doc, packed = np.frombuffer(raw[n:n * 17], np.int64).reshape(2, n)
    left = np.frombuffer(raw[n * 17:head], np.uint8).reshape(n, width)
    tails, at, texts_, before = bytes(raw[head:]), 0, [], b""
    for shared in lcp.tolist():
        end = at + span - shared
        before = before[:shared] + tails[at:end]
        at = end
        texts_.append(before)
    return lcp.tolist(), texts_, doc, packed, left


class _Run:
    """A sorted run being read: the current suffix and what it shares with the last winner."""

    __slots__ = ("lcp", "texts", "at", "end", "text", "shared")

    def __init__(self, lcp, texts_):
        self.lcp, self.texts, self.at, self.end = lcp, texts_, 0, len(texts_)
        self.text, self.shared = texts_[0], 0

    def step(self):
        """The next suffix shares with the winner (its predecessor) what the run recorded."""
        self.at += 1
        if self.at == self.end:
            self.text = None
            return
        self.text, self.shared = self.texts[self.at], self.lcp[self.at]


def _loses(a: _Run, b: _Run) -> bool:
    """Whether ``a`` sorts behind ``b``; the loser learns what it shares with the winner.

    Both know what they share with the last winner. The one that shares more is smaller,
    without looking at a byte; on a draw bytes are compared from there on.
    """
    if a.text is None:
        return True
    if b.text is None:
        return False
    if a.shared != b.shared:
        return a.shared < b.shared
    x, y = a.text[a.shared:], b.text[a.shared:]
    if x == y:
        (b if a.at <= b.at else a).shared = len(a.text)
        return a.at > b.at
    d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    differ = len(x) - (d.bit_length() + 7) // 8
    behind, same = x[differ] > y[differ], a.shared + differ
    (a if behind else b).shared = same
    return behind


def merge_runs(runs):
    """(run, index, shared with the one before) of all suffixes in sorted order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    leaves = runs + [None] * (k - len(runs))
    empty = _Run([0], [None])
    leaves = [r if r is not None else empty for r in leaves]
    number = {id(r): i for i, r in enumerate(runs)}
    tree = [None] * k

    def build(node):
        if node >= k:
            return leaves[node - k]
        a, b = build(2 * node), build(2 * node + 1)
        if _loses(a, b):
            a, b = b, a
        tree[node] = b
        return a

    winner = build(1)
    place = {id(r): k + i for i, r in enumerate(leaves) if r is not empty}
    while winner.text is not None:
        yield number[id(winner)], winner.at, winner.shared
        node = place[id(winner)]
        winner.step()
        node //= 2
        while node:
            other = tree[node]
            if _loses(winner, other):
                tree[node], winner = winner, other
            node //= 2


_RUN = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("run", pa.binary()),
                  ("doc_id", pa.binary()), ("start", pa.binary()), ("stop", pa.binary())])
_RUN_DDL = "part int, n int, run binary, doc_id binary, start binary, stop binary"


def _runs(span, parts):
    def settle(many, hot):
        s = _Suffixes.concat(many)
        hot = np.concatenate(hot)
        order = _order(s.right)
        s, hot = s.take(order), hot[order]
        lcp = _lcp(s.right)
        repeats = _repeats(s, lcp, span)
        o = np.arange(repeats.shape[1])
        asked = (s.low[:, None] <= o) & (o <= s.high[:, None])
        open_ = (asked & ~repeats).any(axis=1)
        doc, start, stop = _spans(s, repeats, span)
        rows = [(p, 0, None, d.tobytes(), a.tobytes(), b.tobytes())
                for p, (d, a, b) in _split_by(np.abs(doc % parts), parts, doc, start, stop)]
        s, hot = s.take(open_), hot[open_]
        # equal windows meet: by the anchor's K bytes, or for single windows by all bytes
        whole = s.right.copy()
        whole[~hot, K:] = 0
        folded = (_TABLE[whole] * _TABLE_ROW[:span]).sum(axis=1, dtype=np.uint64)
        folded ^= folded >> np.uint64(33)
        which = (folded * _MIX >> np.uint64(20)) % np.uint64(parts)
        for p, (index,) in _split_by(which.astype(np.int64), parts, np.arange(len(s))):
            run, n = _front_code(s.take(index))
            rows.append((p, n, run, None, None, None))
        return pa.RecordBatch.from_pylist([dict(zip(_RUN.names, r)) for r in rows], schema=_RUN)

    def run(batches):
        many, hot, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, doc in enumerate(ids):
                data = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
                at = batch.column("at")[i].values.to_numpy(zero_copy_only=False)
                s, h = _windows(data, doc, np.unique(at), span)
                many.append(s)
                hot.append(h)
                size += len(s)
                if size * 2 * span >= BATCH_BYTES * 4:
                    yield settle(many, hot)
                    many, hot, size = [], [], 0
        if size:
            yield settle(many, hot)

    return run


_TABLE_ROW = np.random.default_rng(2).integers(0, 1 << 63, 128, np.uint64) * np.uint64(2) \
    + np.uint64(1)


def _merge(span):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["run"].isna()]
        doc, start, stop = ([_join(known[c], np.int64)] for c in ("doc_id", "start", "stop"))
        coded = pdf[pdf["run"].notna()]
        if len(coded):
            sizes = coded["n"].tolist()
            inflate = zstandard.ZstdDecompressor().decompress
            runs = [_decode(inflate(b), n, span) for b, n in zip(coded["run"], sizes)]
            base = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
            index, lcp = [], []
            for r, i, shared in merge_runs([_Run(x[0], x[1]) for x in runs]):
                index.append(base[r] + i)
                lcp.append(shared)
            index = np.array(index)
            text = np.frombuffer(b"".join(t for x in runs for t in x[1]), np.uint8)
            pos, low, high = _unpack(np.concatenate([x[3] for x in runs])[index])
            s = _Suffixes(text.reshape(-1, span)[index], np.concatenate([x[4] for x in runs])[index],
                          np.concatenate([x[2] for x in runs])[index], pos, low, high)
            d, a, b = _spans(s, _repeats(s, np.array(lcp), span), span)
            doc.append(d)
            start.append(a)
            stop.append(b)
        return pd.DataFrame({"doc_id": np.concatenate(doc), "start": np.concatenate(start),
                             "stop": np.concatenate(stop)})

    return run


# --- the operator --------------------------------------------------------------------------

def _local_hot(base: DataFrame, hot_rows: int) -> int:
    """Rows of a hash in one batch from which all batches together could pass ``hot_rows``."""
    per_task = base.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("b"))
    batches = per_task.agg(F.sum(2 * F.ceil(F.col("b") / BATCH_BYTES) + 1)).first()[0] or 1
    return max(2, hot_rows // int(batches))


def repeated_spans(base: DataFrame, span: int = 100, parts: int | None = None,
                   hot_rows: int = HOT_ROWS, local_hot: int | None = None) -> DataFrame:
    """(doc_id, spans): per document the (start, stop) byte ranges to remove, not yet merged.

    ``base`` has doc_id (unique) and text (binary).
    """
    parts = parts or 4 * shuffle_width(base.sparkSession)
    local_hot = local_hot or _local_hot(base, hot_rows)
    seen = base.mapInArrow(_seen_rows(span, parts, local_hot), _SEEN)
    again = seen.groupBy("part").applyInPandas(_repeated, "doc_id long, at long")
    per_doc = again.groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    runs = base.join(per_doc, "doc_id").mapInArrow(_runs(span, parts), _RUN_DDL)
    found = runs.groupBy("part").applyInPandas(_merge(span), "doc_id long, start long, stop long")
    return found.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))


def _cut(data: bytes, starts, stops):
    """(kept bytes, removed, runs) after removing the union of the ranges."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    head = np.concatenate(([True], starts[1:] > stops[:-1]))
    starts, stops = starts[head], stops[np.concatenate((head[1:], [True]))]
    kept, at = [], 0
    for a, b in zip(starts.tolist(), stops.tolist()):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), int((stops - starts).sum()), len(starts)


def _apply(batches, as_text=False):
    kind = pa.string() if as_text else pa.binary()
    for batch in batches:
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [],
               "kept": []}
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = text.as_py()
            kept, removed, n = data, 0, 0
            if spans.is_valid and len(spans.values):
                kept, removed, n = _cut(data, spans.values.field("start").to_numpy(),
                                        spans.values.field("stop").to_numpy())
            if as_text:
                kept = kept.decode("utf-8", "ignore")
            for k, v in (("n_bytes", len(data)), ("n_removed", removed), ("n_spans", n),
                         ("kept", kept)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
             ("n_spans", pa.int64()), ("kept", kind)]))


def _cut_texts(base, span, parts=None, hot_rows=HOT_ROWS, local_hot=None, as_text=False):
    """The rows of ``suffix_dedup`` for a base of unique doc_ids that are not NULL, and texts."""
    if not K < span <= 127:
        raise ValueError("span must be above 32 and at most 127")
    base = base.withColumn("text", F.col("text").cast("binary"))
    spans = repeated_spans(base, span, parts, hot_rows, local_hot)
    kind = "string" if as_text else "binary"
    return base.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        lambda batches: _apply(batches, as_text),
        f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")


def suffix_dedup(docs: DataFrame, span: int = 100, parts: int | None = None,
                 hot_rows: int = HOT_ROWS, local_hot: int | None = None,
                 as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` holds the remaining bytes.

    With ``as_text`` it is a string, without characters that lost some of their bytes.

    One row per row of ``docs``. A NULL text is empty and stays so; texts shorter than
    ``span`` lose nothing. Rows without a doc_id come before all others. Rows that share
    a doc_id are taken in the order of their texts, so a repeated row is a later copy.
    Other columns are ignored; an empty table gives no rows. 33 <= span <= 127. Two small
    jobs look for repeated ids and at the size of the input while the plan is built.
    """
    base, named = unique_ids(docs)
    return named(_cut_texts(base, span, parts, hot_rows, local_hot, as_text))


def without_repeats(docs: DataFrame, span: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``, all other columns as they are.

    One row per row of ``docs``, in the order of ``suffix_dedup``; the other columns are
    joined by a row id, so doc_id may be NULL or repeat. A character that loses some of its
    bytes goes whole; n_chars, if there, is counted anew. A NULL text becomes the empty text;
    very long texts are cut whole. Columns of any name are carried; an empty table gives no rows.
    """
    base, back = packed(docs)
    rows = with_row_ids(base, "row")
    kept = _cut_texts(texts(rows, "row"), span, as_text=True).select(
        F.col("doc_id").alias("row"), "kept")
    return back(rows.drop("text").join(kept, "row"), "kept")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans",
                         F.sha2("kept", 256).alias("kept_sha256"))
