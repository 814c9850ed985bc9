"""The working memory of sessions as keyed state: a task, the last statuses, corrections, searches and topics not to take up again.

A row (session, pos, ts, kind, text, turn, top) is one thing that happened; kinds are task, status, step, correction,
do_not, search and reset. Each list is bounded, so the state of a session is, too. The same operator runs over a stream
and over a table; a session's rows are taken in the order of pos, and between batches they must arrive in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How many of each are kept.
STATUSES, CORRECTIONS, TOPICS, SEARCHES = 5, 5, 3, 20
#: A search is repeated where so many earlier ones had its top result and words that overlap by more than this.
SIMILAR, OVERLAP = 3, 0.2

OUT = "session long, pos long, anchor string, searches int, similar int, expired boolean"


def _words(text: str) -> set[str]:
    return {w for w in text.lower().split() if len(w) > 2}


def _overlap(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return float(a == b)
    return len(a & b) / len(a | b)


def anchor(task: str, statuses: list[str], step: str, corrections: list[tuple[str, int]], topics: list[str]) -> str:
    """What a model is reminded of before each turn; empty without a task."""
    if not task:
        return ""
    said = [f"[TASK] {task}"]
    if statuses:
        said.append("[STATUS] " + " → ".join(f"✓ {s}" for s in statuses))
    if step:
        said.append(f"[STEP] {step}")
    if corrections:
        said.append("[CORRECTIONS]\n" + "\n".join(f'  User (turn {turn}): "{text}"' for text, turn in corrections))
    if topics:
        said.append("[DO NOT] " + ". ".join(topics) + ".")
    return "\n".join(said)


class WorkingMemory(StatefulProcessor):
    """One session: value state for its task and step, list state for what is bounded by number, a timer for its end."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.aim = handle.getValueState("aim", "task string, step string, pos long")
        self.statuses = handle.getListState("statuses", "text string")
        self.corrections = handle.getListState("corrections", "text string, turn long")
        self.topics = handle.getListState("topics", "text string")
        self.searches = handle.getListState("searches", "query string, top string")

    def _lists(self) -> dict[str, list[tuple]]:
        return {n: [tuple(x) for x in getattr(self, n).get()] for n in ("statuses", "corrections", "topics", "searches")}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("pos", kind="stable")
        task, step, _ = self.aim.get() if self.aim.exists() else ("", "", -1)
        now, before, out = self._lists(), self._lists(), []
        for r in own.itertuples(index=False):
            text, similar = r.text or "", None
            if r.kind == "task":
                task, step, now["statuses"], now["topics"] = text, "", [], []
            elif r.kind == "reset":
                task, step, now = "", "", {n: [] for n in now}
            elif r.kind == "status":
                now["statuses"] = [*now["statuses"], (text,)][-STATUSES:]
            elif r.kind == "step":
                step = text
            elif r.kind == "correction":
                now["corrections"] = [*now["corrections"], (text, int(r.turn))][-CORRECTIONS:]
            elif r.kind == "do_not":
                now["topics"] = [*(t for t in now["topics"] if t != (text,)), (text,)][-TOPICS:]
            elif r.kind == "search":
                # asked before it is recorded
                similar = sum(top == r.top and _overlap(_words(query), _words(text)) > OVERLAP for query, top in now["searches"])
                now["searches"] = [*now["searches"], (text, r.top)][-SEARCHES:]
            block = anchor(task, [s for (s,) in now["statuses"]], step, now["corrections"], [t for (t,) in now["topics"]])
            out.append((key[0], int(r.pos), block, len(now["searches"]), similar, False))
        self.aim.update((task, step, int(own["pos"].iloc[-1])))
        for name, items in now.items():
            if items != before[name]:
                getattr(self, name).put(items) if items else getattr(self, name).clear()
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(pd.Timestamp(own["ts"].max()).value // 1_000_000) + self.idle_ms)
        frame = pd.DataFrame(out, columns=["session", "pos", "anchor", "searches", "similar", "expired"])
        yield frame.astype({"similar": "Int32", "searches": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A session that was idle for long says what it was about, and is forgotten."""
        task, step, pos = self.aim.get()
        now = self._lists()
        block = anchor(task, [s for (s,) in now["statuses"]], step, now["corrections"], [t for (t,) in now["topics"]])
        for name in ("aim", *now):
            getattr(self, name).clear()
        frame = pd.DataFrame({"session": [key[0]], "pos": [pos], "anchor": [block], "searches": [len(now["searches"])], "similar": [None], "expired": [True]})
        yield frame.astype({"similar": "Int32", "searches": "int32"})

    def close(self) -> None:
        pass


def working_memory(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(session, pos, anchor, searches, similar, expired) after each row: the anchor block, the number of searches kept, and for a search how many of them it repeats.

    With `idle_ms` a session ends that long after its last ts (rows need a watermark on ts): a row with `expired` tells
    its last anchor, and its state goes. Null texts are empty. State is kept by RocksDB: set
    spark.sql.streaming.stateStore.providerClass for streams (`use_rocksdb`).
    """
    # over a table, too, tasks ask the session's coordinator of state stores, which this starts
    _ = rows.sparkSession.streams
    own = rows.select("session", "pos", "ts", "kind", "text", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("top").cast("string").alias("top"))
    return own.groupBy("session").transformWithStateInPandas(WorkingMemory(idle_ms), OUT, "Append", "None" if idle_ms is None else "EventTime")


def use_rocksdb(spark) -> None:
    """State with lists and timers needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def repetition_warning(similar: Column, same: Column) -> Column:
    """What is said about a search that repeats earlier ones; null where it doesn't."""
    head = F.concat(F.lit("\n⚠ You have searched "), same.cast("string"), F.lit(" similar queries with the same results. The answer is in the results above. Move on to the next step. Do NOT search for this topic again."))
    return F.when(similar >= SIMILAR, head)


def tool_events(rows: DataFrame) -> DataFrame:
    """Statuses and steps (session, pos, ts, kind, text, turn, top) that results of tools (session, pos, ts, tool, file, result) stand for.

    Tools that are not known, and commands whose result says neither, stand for nothing.
    """
    text = F.coalesce("result", F.lit(""))
    bad, good = text.rlike("(?i)error|fail|❌|blocked"), text.rlike("(?i)✓|✅|success|written|created|applied")
    name = F.regexp_extract(F.coalesce("file", F.lit("")), r"([^/\\]*)$", 1)
    count = F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*error", 1), F.lit(""))
    broken = (F.coalesce(count.cast("decimal(38,0)"), F.lit(0)) > 0) | text.rlike("(?i)fail|❌|blocked")
    either = lambda no, yes: F.when(bad, no).otherwise(yes)
    status = (
        F.when(F.col("tool") == "write_file", either(F.concat(F.lit("Failed to write "), name), F.concat(name, F.lit(" written"))))
        .when(F.col("tool") == "edit_file", either(F.concat(F.lit("Failed to edit "), name), F.concat(name, F.lit(" edited"))))
        .when(F.col("tool") == "run_bash", F.when(bad, "Command failed").when(good, "Command succeeded"))
        .when(F.col("tool") == "build_and_test", F.when(broken, F.when(count.isNull(), "Build failed").otherwise(F.concat(F.lit("Build: "), count, F.lit(" errors")))).otherwise("Build succeeded"))
        .when(F.col("tool") == "start_server", either(F.lit("Server failed to start"), F.lit("Server started")))
        .when(F.col("tool") == "test_endpoint", either(F.lit("Endpoint test failed"), F.lit("Endpoint test passed")))
    )
    step = F.when(F.col("tool") == "build_and_test", F.when(broken, "Fix the build errors").otherwise("Verify the changes work correctly"))
    events = F.filter(F.array(F.struct(F.lit("status").alias("kind"), status.alias("text"), F.lit(0).alias("k")), F.struct(F.lit("step").alias("kind"), step.alias("text"), F.lit(1).alias("k"))), lambda e: e["text"].isNotNull())
    out = rows.select("session", "pos", "ts", F.explode(events).alias("e"))
    # a result that stands for two keeps its place: the step comes right after the status
    return out.select("session", (F.col("pos") * 2 + F.col("e.k")).alias("pos"), "ts", "e.kind", "e.text", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("top"))
