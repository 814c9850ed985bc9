"""Streams of messages and outcomes: the same results as the batch windows, kept up as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (turn,) = state.get if state.exists else (0,)
    rows = pd.concat(list(frames)).sort_values("pos", kind="stable")
    turns = turn + (rows["role"] == "user").cumsum()
    if len(rows):
        state.update((int(turns.iloc[-1]),))
    yield pd.DataFrame({"session": key[0], "pos": rows["pos"].astype("int64"), "turn": turns.astype("int64")})


def turn_stream(messages: DataFrame) -> DataFrame:
    """(session, pos, turn) of a stream of messages; the state of a session is one number.

    Messages of a session must arrive in order between batches; inside a batch any order will do.
    """
    return messages.select("session", "pos", "role").groupBy("session").applyInPandasWithState(_number, "session long, pos long, turn long", "turn long", "append", GroupStateTimeout.NoTimeout)


def _promote(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    run, best = state.get if state.exists else (0, -1)
    rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
    before = best
    for ok, event in zip(rows["passed"], rows["event_id"], strict=True):
        run = run + 1 if ok else 0
        best = int(event) if run >= 5 else best
    state.update((int(run), int(best)))
    if best != before:
        yield pd.DataFrame({"language": [key[0]], "error_code": [key[1]], "strategy": [key[2]], "event_id": [best]})


def promotion_stream(outcomes: DataFrame) -> DataFrame:
    """(language, error_code, strategy, event_id) each time a strategy passes for the fifth time in a row, or goes on to."""
    own = outcomes.select("language", "error_code", "strategy", "passed", "event_id")
    return own.groupBy("language", "error_code", "strategy").applyInPandasWithState(_promote, "language string, error_code string, strategy string, event_id long", "run long, best long", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(chunks: DataFrame, path: str, checkpoint: str):
    """Appends a stream of chunks to the store, one partition a collection."""
    return chunks.writeStream.format("parquet").partitionBy("collection").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
