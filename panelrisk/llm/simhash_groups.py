"""SimHash near-dedup through pigeonhole blocks (operator 7).

1. Each document gets a 64-bit fingerprint: bit b is set if it is set in over half
   of the shingle hashes. Fingerprints are reduced to distinct values, so groups of
   copies cost one row from here on.
2. The 64 bits are cut into ``b`` blocks. Two fingerprints that differ in at most k
   bits agree on at least b - k whole blocks, so they share a key for one choice of
   b - k blocks. b follows from the number of distinct fingerprints such that a key
   has more bits than that number has: chance meetings per fingerprint then stay
   constant at any corpus size. Every b is exact.
3. Within a key the distances are verified and the key's own connected groups are
   found; a group gives a star of links to its smallest member, not all its pairs.
   A key with more than ``hot_key`` fingerprints is never gathered: each of its
   fingerprints instead names every value within k/2 bits of itself, and two
   fingerprints within k bits share such a value, which only ever keeps its minimum.
   That is exact, linear in the group, and combines before the shuffle.
4. Links are joined into components by star contraction, each round written to the
   shared checkpoint folder. Nothing but counters reaches the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import packed, shuffle_width, texts, with_row_ids
from panelrisk.session import pin

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingle hashes turned into bits at a time; bounds memory for very long texts.
_BLOCK = 1 << 16


def _fingerprint(data: bytes, width: int) -> int:
    import xxhash

    words = data.translate(_LOWER).split()  # bytes.split() cuts at exactly these six characters
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < width:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = n - width + 1
    firsts, lasts = starts[:count].tolist(), ends[width - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, count, _BLOCK):
        hashes = np.array([digest(line[a:b], 42)
                           for a, b in zip(firsts[i:i + _BLOCK], lasts[i:i + _BLOCK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0,
                                                                                dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, one row per row of ``docs``."""

    def run(batches):
        for batch in batches:
            fps = [_signed(_fingerprint(v.as_buffer().to_pybytes(), shingle))
                   for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())],
                                             ["doc_id", "fp"])

    base = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(run, "doc_id long, fp long")


def _block_masks(blocks: int):
    """Masks of the blocks as unsigned integers, as even in width as can be."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def choose_blocks(distinct: int, k: int) -> int:
    """Fewest blocks whose keys (blocks - k of them together) outnumber the fingerprints."""
    need = max(1, int(distinct).bit_length())
    for blocks in range(k + 1, BITS + 1):
        if BITS * (blocks - k) // blocks >= need:
            return blocks
    return BITS


def _popcount(x):
    return np.bitwise_count(x)


def _groups_in_key(fps: np.ndarray, k: int):
    """Links (member, smallest) of the connected groups under distance <= k.

    Breadth first: what the frontier reaches leaves the open set, so a dense group is
    done in few passes and never lists its pairs. The frontier is taken in bounded
    steps to bound memory.
    """
    rest = np.unique(fps)
    links = []
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(frontier), 64):
                away = np.flatnonzero(~near)
                if not len(away):
                    break
                d = _popcount(frontier[i:i + 64, None] ^ rest[None, away])
                near[away[(d <= k).any(axis=0)]] = True
            frontier, rest = rest[near], rest[~near]
            links.append(frontier)
            links.append(np.full(len(frontier), root, np.uint64))
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(links[0::2]), np.concatenate(links[1::2])


def _links_batch(fps, bounds, k):
    """Links of consecutive groups, given by their bounds, as an Arrow batch."""
    size = np.diff(bounds)
    first = bounds[:-1][size == 2]
    a, b = fps[first], fps[first + 1]
    near = _popcount(a ^ b) <= k
    members, roots = [a[near]], [b[near]]
    for i in np.flatnonzero(size > 2):
        m, r = _groups_in_key(fps[bounds[i]:bounds[i + 1]], k)
        members.append(m)
        roots.append(r)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).view(np.int64)) for x in (members, roots)], ["fp", "to"])


def _ball(free_bits, radius):
    """All values with at most ``radius`` of the free bits set."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(free_bits, r)]
    return np.array(out, np.uint64)


def near_links(distinct: DataFrame, k: int = 4, hot_key: int = 4096) -> DataFrame:
    """(fp, to): links whose connected components are those of all pairs within k bits.

    ``distinct`` holds distinct fingerprints in ``fp`` and should be written (it is
    read three times). ``k`` must be even, as large keys are linked through both halves of it.
    """
    if k % 2:
        raise ValueError(f"an even number of bits is needed, not {k}")
    spark = distinct.sparkSession
    masks = _block_masks(choose_blocks(distinct.count(), k))
    choices = [sum(masks[i] for i in c) for c in combinations(range(len(masks)), len(masks) - k)]
    as_long = [F.lit(_signed(m)) for m in choices]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(m)
                                                         for m in as_long])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = pin(keyed.join(sizes, ["t", "key"]))

    def within(batches):
        carried = None
        for batch in batches:
            at = pa.Table.from_batches([batch])
            at = at if carried is None else pa.concat_tables([carried, at])
            t, key = at.column("t").to_numpy(), at.column("key").to_numpy()
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            if not len(cuts):
                carried = at
                continue
            carried = at.slice(int(cuts[-1]))
            yield _links_batch(at.column("fp").to_numpy().view(np.uint64)[:cuts[-1]],
                               np.concatenate(([0], cuts)), k)
        if carried is not None and len(carried):
            fps = carried.column("fp").to_numpy().view(np.uint64)
            yield _links_batch(fps, np.array([0, len(fps)]), k)

    # groups of at most hot_key rows, next to each other; many are pairs, so no call per group
    small = shared.filter(F.col("n") <= hot_key).select("t", "key", "fp") \
        .repartition(shuffle_width(spark), "t", "key").sortWithinPartitions("t", "key") \
        .mapInArrow(within, "fp long, to long")

    reach, far = k // 2, k - k // 2
    free = [[b for b in range(BITS) if not m >> b & 1] for m in choices]

    def spread(batches):
        balls = {}
        for batch in batches:
            t = batch.column("t").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for which in np.unique(t):
                if which not in balls:
                    balls[which] = _ball(free[which], far)
                ball = balls[which]
                own = fps[t == which]
                for i in range(0, len(own), 32):
                    part = own[i:i + 32]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part) * len(ball), which, np.int32)),
                         pa.array((part[:, None] ^ ball).ravel().view(np.int64)),
                         pa.array(np.repeat(part, len(ball)).view(np.int64))],
                        ["t", "mid", "fp"])

    hot = shared.filter(F.col("n") > hot_key)
    if hot.isEmpty():
        return small
    # within k bits of each other: both ends reach k/2 bits, as k is even
    mids = hot.mapInArrow(spread, "t int, mid long, fp long")
    least = mids.groupBy("t", "mid").agg(F.min("fp").alias("to"), F.max("fp").alias("most")) \
        .filter(F.col("to") < F.col("most")).select("t", "mid", "to")
    far_links = mids.join(least, ["t", "mid"]).filter(F.col("fp") != F.col("to")) \
        .select("fp", "to").distinct()
    return small.unionByName(far_links)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root): the smallest fingerprint of each linked fingerprint's component.

    Star contraction: each node hands its neighbours that are larger than itself to
    its smallest neighbour, then the smaller ones; both steps keep the components and
    the number of links does not grow. A hub's links are reduced by ``min`` before
    the shuffle and re-joined by an equi-join that Spark may split. Ends when the
    sum of the links no longer moves.
    """
    edges = pin(links.filter(F.col("fp") != F.col("to")).select(
        F.greatest("fp", "to").alias("u"), F.least("fp", "to").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")) \
            .select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"),
                                                               F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v")))
        edges = pin(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"components not settled after {rounds} rounds")


def simhash_groups(docs: DataFrame, shingle: int = 4, k: int = 4,
                   hot_key: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Words are cut at space, tab, line feed, vertical tab, form feed and return, A-Z
    lower-cased; a text with fewer words than ``shingle`` is one shingle; a text
    without words (or NULL) has fingerprint zero and is linked like any other. Rows
    that repeat a doc_id each give a row. component_id is the smallest doc_id of the
    component, the document itself included. Other columns are ignored; an empty
    table gives no rows.
    """
    marked = pin(fingerprints(docs, shingle))
    distinct = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), k, hot_key))
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "root").join(first, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, k: int = 4) -> DataFrame:
    """The first row of each group of near copies, all columns as they are.

    First is the smallest doc_id and, where rows share it, the smallest text; rows are told
    apart by a row id. Rows that repeat both doc_id and text are one document and leave one
    row; rows without a doc_id are groups of their own and stay, repeated or not. NULL, empty and
    very long texts are as in ``simhash_groups``: all texts without words are near copies of each
    other. Columns of any name are carried; an empty table gives no rows.
    """
    base, back = packed(docs)
    known, nameless = base.filter("doc_id IS NOT NULL"), base.filter("doc_id IS NULL")
    twice = known.groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        rows = known.withColumn("row", F.col("doc_id").cast("long"))
    else:
        rows = with_row_ids(known.dropDuplicates(["doc_id", "text"]), "row")
    groups = simhash_groups(rows.select(F.col("row").alias("doc_id"), "text"), shingle, k)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(
        F.col("doc_id").alias("row"))
    return back(rows.join(kept, "row", "left_semi").drop("row").unionByName(nameless))
