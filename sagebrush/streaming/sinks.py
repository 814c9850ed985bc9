"""Sinks that take each row once: outcomes with the promotions that follow from them, and extractions with a breaker.

A micro-batch is one version of the target, which also names the batch (see `sources.snapshots`). A batch that comes
again, after a failure anywhere, finds its number there and changes nothing; one that was killed has left no version.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..sources.scratch import stored
from ..sources.snapshots import BORN, SEGMENT, Conflict, Manifest, Snapshots
from .memory import _overlap, _words

KEYS = ["language", "error_code", "strategy"]
#: Passes in a row after which a strategy is promoted.
RUN = 5


class _Done(Exception):
    pass


class OutcomeSink:
    """Outcomes (event_id, ts, language, error_code, strategy, passed, others), and by strategy the passes in a row up to now."""

    def __init__(self, spark: SparkSession, path: str, run: int = RUN) -> None:
        self.spark, self.tables, self.run = spark, Snapshots(spark, path), run

    def outcomes(self) -> DataFrame:
        return self.tables.read("outcomes").drop(SEGMENT, BORN)

    def promotions(self) -> DataFrame:
        """(language, error_code, strategy): of a code's strategies that ever passed so often in a row, the one that did so last. None is ever taken back."""
        ever = self.tables.read("runs").where("best is not null")
        return ever.groupBy("language", "error_code").agg(F.max_by("strategy", "best").alias("strategy"))

    def _runs(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """(keys, passes, best) after a batch: passes in a row up to its end, and the last outcome that made a run long enough.

        Only counts of earlier batches are read, one row a strategy.
        """
        order = Window.partitionBy(*KEYS).orderBy("ts", "event_id")
        fails = rows.withColumn("part", F.sum((~F.col("passed")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        old = self.tables.read("runs", m).select(*KEYS, F.col("passes").alias("before"), F.col("best").alias("old")) if m.segments("runs") else None
        inside = F.sum(F.col("passed").cast("int")).over(Window.partitionBy(*KEYS, "part").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        both = fails.join(old, KEYS, "full") if old is not None else fails.withColumn("before", F.lit(None).cast("long")).withColumn("old", F.lit(None).cast("struct<ts:timestamp,event_id:long>"))
        # a run goes on from the batch before until the first failure
        long = F.when(F.col("part").isNull(), F.col("before")).otherwise(inside + F.when(F.col("part") == 0, F.coalesce("before", F.lit(0))).otherwise(0))
        both = both.withColumn("long", long)
        at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
        out = both.groupBy(*KEYS).agg(F.coalesce(F.max_by("long", at), F.max("before")).cast("long").alias("passes"), F.max(F.when(F.col("long") >= self.run, F.when(F.col("event_id").isNotNull(), at))).alias("new"), F.max("old").alias("old"))
        return out.select(*KEYS, "passes", F.coalesce("new", "old").alias("best"))

    def take(self, rows: DataFrame, batch: int, source: str = "stream") -> bool:
        """Takes a batch of a source in; False where it has been taken before. Batches of a source come in order."""
        m = self.tables.manifest()
        if m.notes.get("batches", {}).get(source, -1) >= batch:
            return False
        rows = stored(rows, "batch")
        written = {"outcomes": (self.tables.write(rows, "outcomes"), rows.schema)}
        runs = self._runs(rows.where("passed is not null"), m)
        written["runs"] = (self.tables.write(runs, "runs"), runs.schema)

        def change(now: Manifest) -> Manifest:
            done = now.notes.get("batches", {})
            if done.get(source, -1) >= batch:
                raise _Done
            if now.segments("runs") != m.segments("runs"):
                raise Conflict("another source has been taken in meanwhile")
            now = replace(now.without("runs"), notes=now.notes | {"batches": done | {source: batch}})
            for table, (name, schema) in written.items():
                now = now.with_segment(table, name, schema)
            return now

        try:
            self.tables.commit(f"batch {batch} of {source}", change)
        except _Done:
            return False
        return True

    def start(self, stream: DataFrame, checkpoint: str, source: str = "stream"):
        """Runs a stream of outcomes into the sink until all that is there has been taken."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.take(rows, batch, source) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- extractions -----------------------------------------------------------------------------------------------------

#: Failures in a row after which a session asks no more; accepted memories that a new one is compared with.
FAILURES, RECENT, MOST_ALIKE, LEAST_LENGTH = 3, 20, 0.6, 10
EXTRACTED = "session long, pos long, nth int, type string, content string, scope string"


class ExtractionQueue(StatefulProcessor):
    """One session: failures in a row as a value, what was accepted last as a list."""

    def __init__(self, kinds: tuple[str, ...]) -> None:
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n int")
        self.recent = handle.getListState("recent", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("pos", kind="stable")
        failed = self.failures.get()[0] if self.failures.exists() else 0
        recent, out = [c for (c,) in self.recent.get()], []
        for pos, answered, items in zip(own["pos"], own["answered"], own["items"], strict=True):
            if failed >= FAILURES:
                break
            failed = 0 if answered else failed + 1
            known = [_words(c) for c in recent]
            # those of one answer are compared with earlier ones, not with each other
            good = [(n, x) for n, x in enumerate(items if items is not None else []) if x["type"] in self.kinds and len(x["content"]) >= LEAST_LENGTH and all(_overlap(_words(x["content"]), k) <= MOST_ALIKE for k in known)]
            recent = [*recent, *(x["content"] for _, x in good)][-RECENT:]
            out += [(key[0], int(pos), n, x["type"], x["content"], x["scope"]) for n, x in good]
        self.failures.update((failed,))
        if recent:
            self.recent.put([(c,) for c in recent])
        yield pd.DataFrame(out, columns=["session", "pos", "nth", "type", "content", "scope"]).astype({"session": "int64", "pos": "int64", "nth": "int32"})

    def close(self) -> None:
        pass


def extraction_queue(answers: DataFrame, kinds: tuple[str, ...], most: int = 3) -> DataFrame:
    """(session, pos, nth, type, content, scope) of memories accepted from answers (session, pos, response) to extraction prompts.

    A null response is a failed call; after three in a row a session's further answers are not looked at. An answer is a
    JSON array, fenced or not; what is none, or lacks a text, gives nothing and is no failure. Works over streams and tables.
    """
    _ = answers.sparkSession.streams
    body = F.regexp_replace(F.trim("response"), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(F.when(body.startswith("["), body), "array<struct<type:string,content:string,scope:string>>")
    items = F.transform(F.filter(F.slice(parsed, 1, most), lambda x: x["type"].isNotNull() & x["content"].isNotNull()), lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"), F.coalesce(x["scope"], F.lit("project")).alias("scope")))
    rows = answers.select("session", "pos", F.col("response").isNotNull().alias("answered"), items.alias("items"))
    return rows.groupBy("session").transformWithStateInPandas(ExtractionQueue(kinds), EXTRACTED, "Append", "None")
