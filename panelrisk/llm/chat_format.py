"""Chat formatting with loss masks aligned through token offsets (operator 10).

A conversation is rendered as one string and encoded once, with the offsets of every
token. The turns' text spans are known from rendering and sorted; the tokens of each
span are found by binary search over the sorted offsets. The loss mask covers the
tokens of assistant texts. Control strings are tokens of their own, so a text's first and
last token never reach beyond it.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Inside
roles and texts ``<|`` becomes ``<\\|`` (and ``<\\|`` becomes ``<\\\\|``, and so on), so
they never hold a control string and can be read back.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + "\n",
                   re.DOTALL)

_tokenizers: dict = {}


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False)
                                      for t in (START, SEP, END)])
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def render(turns):
    """(string, spans): the conversation and the (start, stop) of each turn's text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        at += len(head)
        spans.append((at, at + len(body)))
        out += [head, body, END, "\n"]
        at += len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str):
    """(role, text) of each turn, read back from a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _masked(roles, spans, starts, stops, learned):
    """Token ranges [first, behind) of the learned turns by binary search on sorted offsets."""
    pick = np.array([r in learned for r in roles], bool)
    spans = np.array(spans, np.int64).reshape(-1, 2)[pick]
    full = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(stops, full[:, 0], side="right")
    behind = np.searchsorted(starts, full[:, 1], side="left")
    return np.stack((first, behind), axis=1)


SCHEMA = ("conv_id long, formatted string, ids array<int>, starts array<int>, stops array<int>, "
          "mask array<boolean>")


def format_chats(conversations: DataFrame, tokenizer_path: str,
                 learned=("assistant",)) -> DataFrame:
    """One row per conversation: formatted, ids, starts, stops (code points) and mask per token.

    Turns are taken in the order of turn, role and text (NULL turns first); a NULL role
    or text is empty; repeated rows are repeated turns; rows without a conv_id form one
    conversation. An empty text gives a turn without learned tokens. Other columns are
    ignored; an empty table gives no rows. A conversation is one string and stays in one
    task; conversations are spread by their id.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pairs = whole.select("conv_id", F.col("turns.role").alias("roles"),
                         F.col("turns.text").alias("texts"))

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()),
                            ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
                            ("stops", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                roles = part.column("roles").to_pylist()
                drawn = [render(zip(r, t)) for r, t in zip(roles, part.column("texts").to_pylist())]
                coded = tokenizer.encode_batch([s for s, _ in drawn], add_special_tokens=False)
                cols = {"conv_id": part.column("conv_id"), "formatted": [s for s, _ in drawn],
                        "ids": [], "starts": [], "stops": [], "mask": []}
                for own, (_, spans), e in zip(roles, drawn, coded):
                    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                    mask = np.zeros(len(offsets), bool)
                    for a, b in _masked(own, spans, offsets[:, 0], offsets[:, 1], learned):
                        mask[a:b] = True
                    for k, v in (("ids", np.array(e.ids, np.int32)), ("starts", offsets[:, 0]),
                                 ("stops", offsets[:, 1]), ("mask", mask)):
                        cols[k].append(v)
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return pairs.mapInArrow(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """The result of each conversation, read back from its string, offsets and mask."""
    import hashlib

    out = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = parse(text)
                plain = "".join(f"{role}\n{body}\n" for role, body in turns)
                mask = np.array(r["mask"], bool)
                edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
                loss = "".join(
                    unescape(text[r["starts"][a]:r["stops"][b - 1]])
                    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
                rows.append((r["conv_id"], len(turns), hashlib.sha256(plain.encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                     "formatted_chars"])

    return formatted.mapInArrow(run, out)
