r"""Chat formatting on the level of tokens.

A turn is   OPEN role HEAD text CLOSE   where OPEN, HEAD and CLOSE are reserved ids outside the tokenizer's
vocabulary; role and text are encoded separately, so no merge crosses a mark. As text the marks read `### `, `: ` and
` </turn>\n`; a backslash, `###` or `</turn>` in a text (and `:` in a role) gets a backslash before it, which reading
takes away again, so that a text never closes its own turn. Loss falls on the texts of the `assistant`: a turn's
segments have lengths, their prefix sums are the bounds of the mask.

Turns are encoded one by one; then the rows of a conversation are streamed in order through one task that adds token
offsets, so that a conversation of any number of turns needs the memory of one batch.

Turns go by turn, then role, then text (so ties and repeated rows have one order); a null turn comes first. A null
text or role is empty. Rows with a null conv_id are one conversation, with a null id. Extra columns are ignored. An
empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session
from .tokens import RANKS, encoding

OPEN, HEAD, CLOSE = 50257, 50258, 50259
MARKS = {OPEN: "### ", HEAD: ": ", CLOSE: " </turn>\n"}
LOSS_ROLE = "assistant"
_TEXT, _ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:")
_BACK = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def encode_turn(role: str, text: str, ranks: str = RANKS) -> tuple[list[int], int, int]:
    """A turn's ids and the bounds of its loss mask, from the prefix sums of its segments' lengths."""
    encode = encoding(ranks).encode_ordinary
    segments = [[OPEN], encode(escape(role, True)), [HEAD], encode(escape(text)), [CLOSE]]
    loss = np.array([0, 0, 0, role == LOSS_ROLE, 0], bool)
    bound = np.concatenate(([0], np.cumsum([len(s) for s in segments])))
    on = np.flatnonzero(loss)
    start, end = (int(bound[on[0]]), int(bound[on[-1] + 1])) if len(on) else (0, 0)
    return [i for s in segments for i in s], start, end


def _encoder(ranks: str):
    def run(batches):
        for batch in batches:
            got = [encode_turn(r, t, ranks) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())],
                ["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to"],
            )

    return run


def _numbered(batches):
    """Adds each turn's number and token offset; rows come by conversation."""
    conv, nth, offset, begun = None, 0, 0, False
    for batch in batches:
        n, at = [], []
        for c, size in zip(batch.column("conv_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if not begun or c != conv:
                conv, nth, offset, begun = c, 0, 0, True
            n.append(nth), at.append(offset)
            nth, offset = nth + 1, offset + size
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(at, pa.int64()), *(batch.column(x) for x in ("ids", "loss_from", "loss_to"))],
            ["conv_id", "nth", "offset", "ids", "loss_from", "loss_to"],
        )


FORMATTED = "conv_id long, nth long, offset long, ids array<int>, loss_from long, loss_to long"


def format_chats(turns: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The turns of every conversation as token ids: number, offset in the conversation, and the loss mask's bounds.

    Rows of one conversation are in one partition, in order.
    """
    session(turns)
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    coded = rows.mapInArrow(_encoder(ranks), "conv_id long, turn long, role string, text string, ids array<int>, loss_from long, loss_to long")
    coded = coded.withColumn("size", F.size("ids").cast("long"))
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "size", "ids", "loss_from", "loss_to").mapInArrow(_numbered, FORMATTED)


def segments(ids: list[int], enc) -> tuple[str, str]:
    """Role and text (still escaped) of a turn's ids."""
    if ids[0] != OPEN or ids[-1] != CLOSE:
        raise ValueError("not a turn")
    head = ids.index(HEAD)
    return enc.decode(ids[1:head], errors="strict"), enc.decode(ids[head + 1 : -1], errors="strict")


def render(ids: list[int], ranks: str = RANKS) -> str:
    """The text of a turn's ids, marks included."""
    role, text = segments(ids, encoding(ranks))
    return MARKS[OPEN] + role + MARKS[HEAD] + text + MARKS[CLOSE]


def _reader(ranks: str):
    """Reads conversations back, one turn after the other, and digests them as they come."""

    def run(batches):
        enc, out, now = encoding(ranks), [], None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
        schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
        close = lambda x: dict(zip(names, (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), *x[5:]), strict=True))
        for batch in batches:
            for x in batch.to_pylist():
                if now is None or x["nth"] == 0:
                    if now is not None:
                        out.append(close(now))
                    now = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, a, b = x["ids"], x["loss_from"], x["loss_to"]
                role, text = segments(ids, enc)
                masked = unescape(enc.decode(ids[a:b], errors="strict"))
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                now[3] += len(masked)
                now[4].update(masked.encode())
                now[5] += len(role) + len(text) + sum(map(len, MARKS.values()))
                now[6] += len(ids)
                now[7] += b - a
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            out.append(close(now))
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def digests(formatted: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Per conversation, what reading the formatted turns back gives."""
    session(formatted)
    return formatted.mapInArrow(_reader(ranks), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
