"""Conversation structure repair by a streamed dynamic program (operator 11).

Rows are dealt by conversation and sorted by turn inside each partition, so a
conversation is one run of a sorted stream. ``mapInPandas`` walks the stream and carries
the program's state from one Arrow batch to the next: per state of the role grammar the
least cost, the rank of its edits among the four live ones and a running digest of the
repaired text. What a row adds is one byte of backpointer per state. Beyond ``SPILL_BYTES``
these bytes go to an unnamed file on the task's own scratch disk, as a shuffle spill does;
nothing else ever reads it, and a lost executor only repeats the task. Neither texts nor rows of
a conversation are held, whatever its length.

The edits of a row are any number of inserted turns and then one of Delete, Keep and
Rerole. Such groups are a prefix code, so the order of two states' edits is known from
the ranks before and the groups added, and ties in cost go to the least string.

States of the grammar ``(s?(ua)+)?``: 0 nothing yet, 1 after the system turn, 2 after a
user turn, 3 after an assistant turn. The role of an inserted or reroled turn follows from
the state.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.tables import WHITE

#: Backpointers kept in memory before they are spilled.
SPILL_BYTES = 8 << 20

DELETE, KEEP, REROLE, INSERT = "D", "K", "R", "I"
COST = {DELETE: 2, KEEP: 0, REROLE: 1, INSERT: 5}
TRUNCATED_COST = 5
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: State behind a turn of this initial, and the role that a state asks for next.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
ACCEPTED = (0, 3)
LEGAL = frozenset(("su", "ua", "au"))

#: Groups of edits: up to two inserted turns (more lead back to the same state) and one edit.
GROUPS = [INSERT * k + letter for k in range(3) for letter in (DELETE, KEEP, REROLE)]
_CODE = {group: i for i, group in enumerate(GROUPS)}
_UNREACHED = 255


def _after_inserts(state, k):
    for _ in range(k):
        state = STEP[state, NEXT_ROLE[state][0]]
    return state


def _moves(fault, initial):
    """For each state behind a row: (state before, cost, group), the cheapest and least of each."""
    best: dict = {}
    for state, k in product(range(4), range(3)):
        at = _after_inserts(state, k)
        ends = [(DELETE, at)]
        if fault in (NONE, TRUNCATED):
            if (at, initial) in STEP:
                ends.append((KEEP, STEP[at, initial]))
            ends.append((REROLE, STEP[at, NEXT_ROLE[at][0]]))
        for letter, end in ends:
            cost = k * COST[INSERT] + COST[letter]
            if fault == TRUNCATED and letter != DELETE:
                cost += TRUNCATED_COST
            found = (cost, INSERT * k + letter)
            best[end, state] = min(best.get((end, state), found), found)
    return [[(state, *best[end, state]) for state in range(4) if (end, state) in best]
            for end in range(4)]


MOVES = {(fault, initial): _moves(fault, initial)
         for fault in (NONE, BLANK, DUPLICATE, TRUNCATED) for initial in ("s", "u", "a", "")}


class _Pointers:
    """One byte per row and state, in memory and beyond a limit in an unnamed file."""

    def __init__(self, limit):
        self.limit, self.held, self.file = limit, bytearray(), None

    def add(self, four):
        self.held += four
        if len(self.held) >= self.limit:
            if self.file is None:
                own = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS")
                self.file = tempfile.TemporaryFile(dir=own.split(",")[0] if own else None)
            self.file.write(self.held)
            self.held = bytearray()

    def back(self):
        """Blocks of whole rows, last row's block first."""
        yield self.held
        if self.file is not None:
            at = self.file.tell()
            while at:
                size = min(at, self.limit // 4 * 4 or 4)
                at -= size
                self.file.seek(at)
                yield self.file.read(size)
            self.file.close()


class Program:
    """The least-cost edits of one conversation, fed row by row."""

    def __init__(self, spill_bytes=SPILL_BYTES):
        self.pointers = _Pointers(spill_bytes)
        # state: cost, rank, digest, whether anything is in the digest
        self.live = {0: (0, 0, hashlib.sha256(), False)}

    @staticmethod
    def _written(digest, some, pieces):
        digest = digest.copy()
        for piece in pieces:
            digest.update(b"\n" + piece if some else piece)
            some = True
        return digest, some

    @staticmethod
    def _pieces(state, group, role, body):
        """Bytes of the turns that a group of edits writes."""
        out = []
        for letter in group:
            if letter == DELETE:
                continue
            if letter == KEEP:
                out.append(role + b":" + body)
                continue
            asked = NEXT_ROLE[state]
            out.append(asked.encode() + b":" + (body if letter == REROLE else b""))
            state = STEP[state, asked[0]]
        return out

    def add(self, fault, role, text):
        live, chosen = self.live, {}
        initial = role[:1]
        for end, moves in enumerate(MOVES[fault, initial if initial in ("s", "u", "a") else ""]):
            best = None
            for state, cost, group in moves:
                if state in live:
                    before = live[state]
                    found = (before[0] + cost, before[1], group, state)
                    if best is None or found < best:
                        best = found
            if best:
                chosen[end] = best
        ranks = sorted((best[1], best[2], end) for end, best in chosen.items())
        rank = {end: i for i, (_, _, end) in enumerate(ranks)}
        four, new = bytearray((_UNREACHED,) * 4), {}
        name = body = b""
        if fault in (NONE, TRUNCATED):
            name, body = role.encode(), text.encode()
        for end, (cost, _, group, state) in chosen.items():
            four[end] = state * len(GROUPS) + _CODE[group]
            digest, some = live[state][2:]
            if group != DELETE:
                digest, some = self._written(digest, some,
                                             self._pieces(state, group, name, body))
            new[end] = (cost, rank[end], digest, some)
        self.live = new
        self.pointers.add(four)

    def result(self):
        """(cost, audit, digest) of the cheapest accepted edits."""
        ends = []
        for state, (cost, rank, _, _) in self.live.items():
            for k in range(3):
                if _after_inserts(state, k) in ACCEPTED:
                    ends.append((cost + k * COST[INSERT], rank, INSERT * k, state))
        cost, _, last, state = min(ends)
        digest, some = self.live[state][2:]
        digest, _ = self._written(digest, some, self._pieces(state, last, b"", b""))
        groups = bytearray()
        for block in self.pointers.back():
            for at in range(len(block) - 4, -1, -4):
                state, code = divmod(block[at + state], len(GROUPS))
                groups.append(code)
        groups.reverse()
        return cost, "".join(map(GROUPS.__getitem__, groups)) + last, digest.hexdigest()


def _named(turns: DataFrame) -> DataFrame:
    """(conv, no_conv, turn, has_turn, role, text) without NULLs, so that pandas keeps integers."""
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _dealt(turns: DataFrame) -> DataFrame:
    """Rows by conversation: one exchange, which the window and the sorted walk share."""
    return turns.repartition("conv", "no_conv")


_ORDER = ["conv", "no_conv", "row", "has_turn", "turn", "role", "text"]

SUMMARY = ("conv_id long, turns long, gaps long, blank long, duplicate long, truncated long, "
           "illegal long, cost long, audit string, repaired_sha256 string")


class _Conversation:
    """Counts of one conversation and its program."""

    def __init__(self, conv, no_conv):
        self.key = (conv, no_conv)
        self.program = Program()
        self.turns = self.illegal = self.distinct = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = self.before = None

    def add(self, turn, has_turn, role, text, fault):
        if has_turn and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.turns += 1
        self.faults[fault] += 1
        self.program.add(fault, role, text)

    def row(self):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (None if self.key[1] else self.key[0], self.turns, min(gaps, (1 << 63) - 1),
                *self.faults[1:], self.illegal, *self.program.result())


def _frame(rows):
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])
    return out.astype({"conv_id": "Int64"})


def repair(turns: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, and its cheapest repair.

    Columns: conv_id, turns (rows), gaps (turn numbers missing between the first and the
    last), blank, duplicate and truncated (rows by their first fault), illegal (neighbours
    whose role initials are not su, ua or au), cost and audit (the edits in order: Keep,
    Delete, Rerole, Insert), repaired_sha256 (``role:text`` of the repaired turns, joined by
    line feeds). ``repaired_turns`` gives the turns themselves. Conversations of ``also`` (conv_id)
    without a row of their own are returned too, with zeros and an empty audit.

    Rows are taken by turn, role and text, NULL turns first, so ties and repeated rows have one
    order; a repeated row is a duplicate. A NULL role or text is empty. A turn whose role
    begins with none of s, u and a can be reroled or deleted only. Rows without a conv_id
    form one conversation. Texts of any length are taken whole. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = _named(turns).withColumn("row", F.lit(True))
    if also is not None:
        rows = rows.unionByName(_named(also.select(
            "conv_id", *[F.lit(None).alias(c) for c in ("turn", "role", "text")]))
            .withColumn("row", F.lit(False)))
    text = F.col("text")
    body = F.rtrim(text, F.lit(WHITE))
    # the same exchange serves this window, the sort and the walk
    seen = F.row_number().over(
        Window.partitionBy("conv", "no_conv", "row", "digest").orderBy("has_turn", "turn"))
    marked = _dealt(rows.withColumn("digest", F.unhex(F.md5(F.concat(
        F.length("role").cast("string"), F.lit(":"), "role", "text"))))) \
        .withColumn("fault", F.when(body == "", BLANK).when(seen > 1, DUPLICATE)
                    .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
                    .otherwise(NONE)).drop("digest")

    def run(frames):
        now = None
        for frame in frames:
            out = []
            for conv, no_conv, turn, has_turn, role, body, row, fault in zip(
                    *(frame[c].tolist() for c in frame.columns)):
                if now is None or now.key != (conv, no_conv):
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv, no_conv)
                if row:
                    now.add(turn, has_turn, role, body, fault)
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame([now.row()])

    return marked.sortWithinPartitions(*_ORDER).select(
        "conv", "no_conv", "turn", "has_turn", "role", "text", "row", "fault") \
        .mapInPandas(run, SUMMARY)


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that the audits of ``repair`` leave, in order.

    ``repaired`` has one audit per conversation; it goes ahead of the conversation's rows in the same
    sorted stream, so nothing else of a conversation is held. Deleted rows are not returned,
    inserted turns have an empty text.
    """
    heads = repaired.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
        F.lit(0).cast("long").alias("turn"), F.lit(False).alias("has_turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(False).alias("row"))
    rows = _dealt(_named(turns).withColumn("row", F.lit(True)).unionByName(heads))
    names = ["conv_id", "place", "role", "text", "edit"]

    def run(frames):
        key, audit, at, last, place, state = None, "", 0, 0, 0, 0
        for frame in frames:
            out = []

            def write(letter, name, text):
                nonlocal place, state
                out.append((key, place, name, text, letter))
                place, state = place + 1, STEP[state, name[0]]

            for conv, no_conv, role, text, row in zip(
                    *(frame[c].tolist() for c in ("conv", "no_conv", "role", "text", "row"))):
                if not row:
                    key, audit, at, place, state = None if no_conv else conv, text, 0, 0, 0
                    last = len(audit.rstrip(INSERT))
                else:
                    while audit[at] == INSERT:
                        write(INSERT, NEXT_ROLE[state], "")
                        at += 1
                    letter, at = audit[at], at + 1
                    if letter != DELETE:
                        write(letter, role if letter == KEEP else NEXT_ROLE[state], text)
                if at == last:
                    for _ in audit[last:]:
                        write(INSERT, NEXT_ROLE[state], "")
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    return rows.sortWithinPartitions(*_ORDER).mapInPandas(
        run, "conv_id long, place long, role string, text string, edit string")


#: What a remainder of the row's checksum does to it.
DAMAGE_KINDS = 20
DROP, EMPTY, UNENDED, TWICE, AS_USER = range(5)


def damage(conversations: DataFrame):
    """(rows, dropped): ``conversations`` with faults put in, and the ids of the rows dropped.

    The checksum of ``conv_id:turn`` decides: the row is dropped, emptied, robbed of its ``.!?``,
    repeated or given the role user. NULLs count as one space.
    """
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) \
        % DAMAGE_KINDS
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"),
                                filled("text").alias("text"), kind.alias("kind"))
    left = rows.filter(F.col("kind") != DROP).select(
        "conv_id", "turn",
        F.when(F.col("kind") == AS_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == EMPTY, "")
        .when(F.col("kind") == UNENDED, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == TWICE, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
    return left, rows.filter(F.col("kind") == DROP).select("conv_id")
