"""The chunk store in versions: adding, replacing and deleting chunks, collections, migration and compaction.

Every change is one new version of the store (see `sources.snapshots`): readers see all of it or nothing, a writer that
is killed changes nothing, and older versions stay readable. A file that comes again is a set of new chunks and a
deleted path; no partition is rewritten for it. Compaction writes what counts anew and leaves the old version as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..sources.snapshots import BORN, SEGMENT, Conflict, Manifest, Snapshots, live

CHUNKS, DELETES = "chunks", "deletes"


class ChunkStore:
    """Chunks by collection; `key` names the column whose rows are replaced together (a file's path)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "path") -> None:
        self.spark, self.key, self.tables = spark, key, Snapshots(spark, path)

    # -- collections ---------------------------------------------------------------------------------------------------

    def ensure(self, *names: str) -> Manifest:
        """Makes collections, the default ones if none is named; those that are there already stay as they are."""
        own = names or tuple(T.COLLECTIONS)
        there = self.tables.manifest()
        if there.version and not set(own) - set(self.collections(there)):
            return there
        return self.tables.commit("ensure", lambda m: _noted(m, collections=sorted({*m.notes.get("collections", []), *own})))

    def collections(self, manifest: Manifest | None = None) -> list[str]:
        return list((manifest or self.tables.manifest()).notes.get("collections", []))

    def drop(self, name: str) -> Manifest:
        """Empties a collection and forgets it. No chunk is read: rows of versions before this one no longer count for it."""

        def change(m: Manifest) -> Manifest:
            return _noted(m, collections=[c for c in m.notes.get("collections", []) if c != name], dropped=m.notes.get("dropped", {}) | {name: m.version})

        return self.tables.commit(f"drop {name}", change)

    # -- rows ----------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None, internal: bool = False) -> DataFrame:
        """The chunks of a version, by default the latest."""
        m = self.tables.manifest(version)
        if CHUNKS not in m.schemas:
            raise ValueError(f"{self.tables.path} has no chunks yet")
        rows = self.tables.read(CHUNKS, m)
        for name, born in m.notes.get("dropped", {}).items():
            if any(v < born for v in m.segments(CHUNKS).values()):
                rows = rows.where(~((F.col("collection") == name) & (F.col(BORN) < born)) | F.col("collection").isNull())
        oldest = min(m.segments(CHUNKS).values(), default=0)
        newer = {n for n, v in m.segments(DELETES).items() if v > oldest}
        if newer:
            rows = live(rows, self.tables.read(DELETES, m, newer), self.key)
        return rows if internal else rows.drop(SEGMENT, BORN)

    def _write(self, chunks: DataFrame) -> str:
        # one folder a collection; a large collection is split by its size, small ones share tasks
        return self.tables.write(chunks.hint("rebalance", "collection"), CHUNKS, ("collection",))

    def add(self, chunks: DataFrame) -> Manifest:
        """Adds chunks (collection, the key, other columns); a column that the store has not had is null in older rows."""
        name = self._write(chunks)
        return self.tables.commit("add", lambda m: _collections_of(m.with_segment(CHUNKS, name, chunks.schema), self.tables, name))

    def replace(self, chunks: DataFrame, keys: DataFrame | None = None) -> Manifest:
        """Adds chunks in place of all that the store has of their keys, and of `keys` (a column of them) if given, in one version."""
        name = self._write(chunks)
        every = (keys if keys is not None else chunks).select(self.key).distinct()
        gone = self.tables.write(every, DELETES)
        return self.tables.commit("replace", lambda m: _collections_of(m.with_segment(CHUNKS, name, chunks.schema).with_segment(DELETES, gone, every.schema), self.tables, name))

    def delete(self, keys: DataFrame) -> Manifest:
        """Deletes the rows of keys."""
        every = keys.select(self.key).distinct()
        gone = self.tables.write(every, DELETES)
        return self.tables.commit("delete", lambda m: m.with_segment(DELETES, gone, every.schema))

    def delete_named(self, words: str) -> DataFrame:
        """Deletes the documents whose title or book holds all the words; gives (collection, n) of the chunks deleted."""
        own = [w for w in words.lower().split() if w]
        holds = lambda c: F.forall(F.array(*map(F.lit, own)), lambda w: F.array_contains(X.token_set(F.coalesce(c, F.lit(""))), w))
        if not own:
            raise ValueError("no words to delete by")
        base = self.tables.manifest()
        hit = self.read(base.version).where(holds("doc_title") | holds("book_id"))
        counts = hit.groupBy("collection").agg(F.count("*").alias("n")).collect()  # as many as there are collections
        self.delete(hit)
        return self.spark.createDataFrame([tuple(r) for r in counts], "collection string, n long")

    # -- whole versions ------------------------------------------------------------------------------------------------

    def rewrite(self, operation: str = "compact", change: Callable[[DataFrame], DataFrame] | None = None) -> Manifest:
        """Writes what counts, changed if asked, as one segment. Chunks that other writers add meanwhile stay; deletes meanwhile are a `Conflict`."""
        base = self.tables.manifest()
        rows = self.read(base.version)
        rows = change(rows) if change else rows
        name, old = self._write(rows), set(base.segments(CHUNKS))

        def publish(m: Manifest) -> Manifest:
            if set(base.segments(DELETES)) != set(m.segments(DELETES)) or base.notes.get("dropped") != m.notes.get("dropped") or not old <= set(m.segments(CHUNKS)):
                raise Conflict("rows were deleted or rewritten meanwhile")
            left = m.without(CHUNKS, old)
            if not left.segments(CHUNKS):
                left = _noted(left.without(DELETES), dropped={})
                if change:
                    left = replace(left, schemas={k: v for k, v in left.schemas.items() if k != CHUNKS})
            # born when its base was: what was deleted later than that still counts for it
            return _collections_of(left.with_segment(CHUNKS, name, rows.schema, base.version), self.tables, name)

        return self.tables.commit(operation, publish)

    def compact(self, most_segments: int = 16) -> Manifest | None:
        """Rewrites the store once it has more segments than that."""
        m = self.tables.manifest()
        return self.rewrite() if len(m.segments(CHUNKS)) + len(m.segments(DELETES)) > most_segments else None

    def migrate(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Takes all collections to a new form (other columns, other vectors) in one version; gives (collection, before, after, state).

        A collection without chunks is skipped. Counts that differ are told and change nothing: the old version is there.
        """
        before = self.tables.manifest()
        after = self.rewrite("migrate", change)
        counts = lambda v, name: self.read(v).groupBy("collection").agg(F.count("*").alias(name))
        every = self.spark.createDataFrame([(c,) for c in self.collections(after)], "collection string")
        own = every.join(counts(before.version, "before"), "collection", "left").join(counts(after.version, "after"), "collection", "left").fillna(0, ["before", "after"])
        state = F.when(F.col("before") == 0, "skipped").when(F.col("before") == F.col("after"), "migrated").otherwise("mismatch")
        return own.select("collection", "before", "after", state.alias("state"))

    def restore(self, version: int) -> Manifest:
        """Makes an older version the latest again."""
        old = self.tables.manifest(version)
        return self.tables.commit(f"restore {version}", lambda m: replace(old, version=m.version, operation=m.operation, at=m.at))


def chunk_id(*columns: Column) -> Column:
    """An id of a chunk from what it is, in the form of a UUID: the same chunk has the same one whenever it is stored."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("\1")) for c in columns]), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def _noted(m: Manifest, **notes) -> Manifest:
    return replace(m, notes=m.notes | notes)


def _collections_of(m: Manifest, tables: Snapshots, segment: str) -> Manifest:
    """With the collections of a segment, which are the names of its folders."""
    from urllib.parse import unquote

    found = (n.split("=", 1)[1] for n in tables._names(f"{tables.path}/{CHUNKS}/{SEGMENT}={segment}") if n.startswith("collection="))
    own = {unquote(n) for n in found} - {"__HIVE_DEFAULT_PARTITION__"}
    return _noted(m, collections=sorted({*m.notes.get("collections", []), *own}))
