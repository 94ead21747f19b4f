"""Cross-tokenizer alignment by interval coalescing (operator 13).

Both tokenizers cut the same bytes (a space and the text). All tokens of a slice of texts
are lexsorted by start, and ``maximum.accumulate`` runs over their ends: where a start reaches the
running maximum, both tokenizers have ended a token, and a new group begins. Within a
group every token of one side is linked to every token of the other.

How often a pair of ids is linked is a count over the whole corpus. Pairs held by many
documents, at most ``TIER_PAIRS`` of them, are broadcast; the others are in few documents
each, so their join has no hot key.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import slices, texts
from panelrisk.llm.word_cache import CACHED_CHARS, ENTRY_BYTES
from panelrisk.session import pin

#: Text bytes handled at a time, and bytes of cached words in a worker.
BATCH_BYTES = 1 << 19
CACHE_BYTES = 96 << 20
#: Links of a group beyond which its ids are made distinct before they are paired.
WIDE_LINKS = 1 << 16
#: Most pairs in the broadcast tier of counts.
TIER_PAIRS = 1_000_000

MARK = "▁"
_workers: dict = {}


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Aligner:
    """Both tokenizers, the bytes of their ids and one cache of words, built once per worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(map(back.__getitem__, token))
        self.b_bytes, inner = [], []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            inner += [piece] if MARK in piece.lstrip(MARK) else []
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace(MARK, " ").encode())
        if inner:
            raise ValueError(f"pieces cross the start of a word: {inner[:3]}")
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.known: dict = {}
        self.bytes = 0

    def _both(self, strings):
        """(ids of A, ids of B, whether both give the bytes back) of a space and each string."""
        a = self.a.encode_batch_fast([" " + s for s in strings], add_special_tokens=False)
        b = self.b.encode(strings, num_threads=1)
        out = []
        for s, one, two in zip(strings, a, b):
            given = b" " + s.encode()
            ids = one.ids
            fits = b"".join(map(self.a_bytes.__getitem__, ids)) == given \
                and b"".join(map(self.b_bytes.__getitem__, two)) == given
            out.append((array("I", ids).tobytes(), array("I", two).tobytes(), fits))
        return out

    @staticmethod
    def _cost(words):
        return sum(2 * ENTRY_BYTES + 2 * len(w) + len(v[0]) + len(v[1]) for w, v in words.items())

    def _learn(self, words):
        """What new words give; those that are short are kept.

        The words met first are the frequent ones: when the cache is full they stay, and the later
        half goes.
        """
        found = dict(zip(words, self._both(words)))
        short = {w: v for w, v in found.items() if len(w) <= CACHED_CHARS}
        size = self._cost(short)
        if self.bytes + size > CACHE_BYTES:
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.bytes = self._cost(self.known)
        if self.bytes + size <= CACHE_BYTES:
            self.known.update(short)
            self.bytes += size
        return found

    def ids(self, batch):
        """(bytes of A's ids, bytes of B's ids) of each text; none where the bytes differ.

        With single spaces between words a text is the sum of its words, since neither
        tokenizer joins a character with a following space; other texts are encoded whole.
        """
        split = [t.split(" ") if t and MARK not in t and "  " not in t
                 and t[0] != " " and t[-1] != " " else None for t in batch]
        seen = self.known
        missing = {w for ws in split if ws for w in ws if w not in seen}
        found = self._learn(list(missing)) if missing else {}
        if self.known is not seen:  # some words that this batch needs have just gone
            found.update((w, seen[w]) for ws in split if ws for w in ws
                         if w in seen and w not in found)
        seen = self.known
        out = []
        for t, ws in zip(batch, split):
            if ws:
                own = [found.get(w) or seen[w] for w in ws] if found else \
                    list(map(seen.__getitem__, ws))
                if all([o[2] for o in own]):
                    out.append((b"".join([o[0] for o in own]), b"".join([o[1] for o in own])))
                    continue
            if t:
                a, b, fits = self._both([t])[0]
                out.append((a, b) if fits else (b"", b""))
            else:
                out.append((b"", b""))
        return out


def coalesce(a_sizes, b_sizes):
    """(tokens of A, tokens of B) in each group, given the byte lengths of two tilings."""
    ends = np.concatenate((np.cumsum(a_sizes), np.cumsum(b_sizes)))
    starts = ends - np.concatenate((a_sizes, b_sizes))
    side = np.zeros(len(ends), np.int8)
    side[len(a_sizes):] = 1
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    begins = np.empty(len(order), bool)
    begins[:1] = True
    begins[1:] = starts[order][1:] >= reach[:-1]
    group = np.cumsum(begins) - 1
    n = int(group[-1]) + 1 if len(group) else 0
    ordered = side[order]
    return (np.bincount(group[ordered == 0], minlength=n),
            np.bincount(group[ordered == 1], minlength=n))


def _lists(values, sizes, kind):
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


ALIGNED = "doc_id long, a array<int>, b array<int>, in_a array<int>, in_b array<int>"


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a, b, in_a, in_b): ids of both tokenizers and their numbers in each group.

    A encodes a space and the text, B (which adds a space) the text; control strings are plain
    text. One row per row of ``docs``, so repeated rows and doc_ids stay. A NULL or empty
    text, and one whose bytes A or B does not give back (a normaliser changed it), has no
    tokens and groups. Texts of any length are encoded whole. Other columns are ignored; an
    empty table gives no rows.
    """
    return _base(docs).mapInArrow(lambda batches: _aligned(batches, a_path, b_path), ALIGNED)


def _base(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))


def _aligned(batches, a_path, b_path):
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    if (a_path, b_path) not in _workers:
        _workers[a_path, b_path] = Aligner(a_path, b_path)
    own = _workers[a_path, b_path]
    for batch in batches:
        column = batch.column("text")
        for lo, hi in slices(pc.binary_length(column).to_pylist(), BATCH_BYTES):
            pairs = own.ids(column.slice(lo, hi - lo).to_pylist())
            n_a = np.array([len(a) // 4 for a, _ in pairs])
            n_b = np.array([len(b) // 4 for _, b in pairs])
            a = np.frombuffer(b"".join([a for a, _ in pairs]), "<u4")
            b = np.frombuffer(b"".join([b for _, b in pairs]), "<u4")
            in_a, in_b = coalesce(own.a_sizes[a], own.b_sizes[b])
            # a group lies in one text: the text of its first token
            text = np.repeat(np.arange(len(pairs)), n_a)
            first = np.cumsum(in_a) - in_a
            groups = np.bincount(text[first], minlength=len(pairs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), _lists(a, n_a, np.int32),
                 _lists(b, n_b, np.int32), _lists(in_a, groups, np.int32),
                 _lists(in_b, groups, np.int32)], names)


def _numbers(column):
    """(values, list sizes) of a list column."""
    return (column.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))


def pair_links(a, b, in_a, in_b, text_of_group):
    """(text, id of A, id of B, times) of the distinct links of each text."""
    links = in_a * in_b
    b_first = np.cumsum(in_b) - in_b
    parts = []
    wide = links > WIDE_LINKS
    group = np.repeat(np.arange(len(in_a)), in_a)
    narrow = ~wide[group]
    each = in_b[group][narrow]
    total = int(each.sum())
    within = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
    parts.append((np.repeat(text_of_group[group][narrow], each), np.repeat(a[narrow], each),
                  b[np.repeat(b_first[group][narrow], each) + within], np.ones(total, np.int64)))
    a_first = np.cumsum(in_a) - in_a
    for g in np.flatnonzero(wide):
        ids_a, n_a = np.unique(a[a_first[g]:a_first[g] + in_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[b_first[g]:b_first[g] + in_b[g]], return_counts=True)
        parts.append((np.full(len(ids_a) * len(ids_b), text_of_group[g]),
                      np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)),
                      np.outer(n_a, n_b).ravel()))
    text, left, right, times = (np.concatenate(p) for p in zip(*parts))
    pair = left << 32 | right
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    new = np.empty(len(pair), bool)
    new[:1] = True
    new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return text[at], pair[at], np.add.reduceat(times, at) if len(at) else times


LINKED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<long>, times array<long>")


class _Speller:
    """Ids as text, each with the mark behind it."""

    def __init__(self):
        self.size, self.table = 0, []

    def pieces(self, a, b, in_a, in_b):
        """One piece per token, in the order of ``a1,a2|b1;a3|b2,b3;``."""
        most = int(max(a.max(initial=0), b.max(initial=0)))
        if most >= self.size:
            self.size = max(2 * self.size, most + 1)
            self.table = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]
        groups = np.arange(len(in_a))
        side = np.concatenate((2 * np.repeat(groups, in_a), 2 * np.repeat(groups, in_b) + 1))
        mark = np.zeros(len(side), np.int64)
        mark[np.cumsum(in_a) - 1] = 1           # behind the last of A's tokens in a group
        mark[len(a) + np.cumsum(in_b) - 1] = 2  # behind the last of B's
        order = np.argsort(side, kind="stable")
        index = (mark * self.size + np.concatenate((a, b)))[order]
        return list(map(self.table.__getitem__, index.tolist()))


def links(aligned: DataFrame) -> DataFrame:
    """What each text's groups hold: counts, a digest of the groups, and the distinct links.

    ``pairs`` are the distinct (A id << 32 | B id) linked in the text and ``times`` how often each
    is; groups are spelled ``a1,a2|b1;a3|b2,b3`` for the digest, which is empty without
    tokens.
    """
    return aligned.mapInArrow(_linked, LINKED)


def _linked(batches):
    names = [c.split()[0] for c in LINKED.split(", ")]
    speller = _Speller()
    for batch in batches:
        a, n_a = _numbers(batch.column("a"))
        b, n_b = _numbers(batch.column("b"))
        in_a, groups = _numbers(batch.column("in_a"))
        in_b, _ = _numbers(batch.column("in_b"))
        rows = batch.num_rows
        own, pairs, times = pair_links(a, b, in_a, in_b, np.repeat(np.arange(rows), groups))
        n_links = np.bincount(own, weights=times, minlength=rows).astype(np.int64)
        pieces, digests, at = speller.pieces(a, b, in_a, in_b), [], 0
        for size in (n_a + n_b).tolist():
            spelled = "".join(pieces[at:at + size])[:-1]
            digests.append(hashlib.sha256(spelled.encode()).hexdigest() if size else "")
            at += size
        held = np.bincount(own, minlength=rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in (
                n_a, n_b, groups, n_links)), pa.array(digests, pa.string()),
             _lists(pairs, held, np.int64), _lists(times, held, np.int64)], names)


def align_and_link(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``links`` of ``align`` in one step, so that a task has one Python worker."""
    return _base(docs).mapInArrow(lambda batches: _linked(_aligned(batches, a_path, b_path)),
                                  LINKED)


def link_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of its A id has more."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"))
    counts = pin(counts)
    # one row per id of A, so never more than its vocabulary has
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return pin(counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a"))
               .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def score_links(linked: DataFrame, tier_pairs: int = TIER_PAIRS) -> DataFrame:
    """Add n_best and count_sum: links of their A id's commonest pair, and all links' counts.

    ``linked`` is a written table with a unique ``row`` (it is read twice or more).
    """
    counts = link_counts(linked)
    # the least power of two that at most tier_pairs counts reach
    levels = {r.level: r["count"] for r in counts.groupBy(
        F.floor(F.log2("n")).cast("int").alias("level")).count().collect()}
    floor, total = 64, 0
    while floor and total + levels.get(floor - 1, 0) <= tier_pairs:
        floor -= 1
        total += levels.get(floor, 0)
    each = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")) \
        .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    common = F.broadcast(counts.filter(F.col("n") >= F.lit(2.0 ** floor)))
    scored = each.join(common, "pair").groupBy("row").agg(*sums)
    if floor:
        rare = counts.filter(F.col("n") < F.lit(2.0 ** floor))
        late = each.join(common, "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
        scored = scored.unionByName(late).groupBy("row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.join(scored, "row", "left").withColumns({
        "n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)}) \
        .drop("row")


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: counts of tokens, groups and links, and how common the links are."""
    linked = pin(align_and_link(docs, a_path, b_path)
                 .withColumn("row", F.monotonically_increasing_id()))
    return score_links(linked).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                      "count_sum", "groups_sha256")
