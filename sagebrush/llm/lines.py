"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference tables.

A line's key is the line without white space at both ends, A-Z lower-cased; keys shorter than `least_chars` count for
nothing. `refs` holds each (key, doc_id) once, `counts` each key's number of documents and largest doc_id, `filters`
one cuckoo filter per shard with the keys that are in `least_docs` documents or more. Lines are first held against
their shard's filter; only those that pass meet the exact table. Inserting documents adds references, deleting them
takes theirs away; counts of the keys touched are made anew, and filters get or lose the keys that cross the limit.

Each step writes what it changes only: new references, the counts of the keys touched, the ids that went. Tables are
read as what was there and what came since; after `MOST_STEPS` steps they are written anew. `save` and `load` keep an
index for other sessions.

A null or empty text is one empty line. Rows with a null doc_id own no key and lose no line. Repeated rows of a
document count once and lose the same lines. Of documents that tie for nothing but their id, the largest id keeps a
line. Very long texts are read whole, in one row each. Other columns of the input pass through unread, unless their
names begin with `_ld_` or are those of the two counts that `apply` adds (n_lines and n_dropped, unless named
otherwise), which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WHITE_CHARS, ascii_lower, mix, session, stored

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys that a shard's filter should hold at most; 16-bit fingerprints, four to a bucket.
SHARD_KEYS, SLOTS, LOAD = 50_000, 4, 0.85
#: Copies of a filter among which the rows of its shard are dealt, so that a very common line is no hot task.
SALTS = 16
#: Lines that are held against one copy of a filter, at most by average.
PART_LINES = 500_000
#: Steps of an index after which its tables are written anew.
MOST_STEPS = 8
FILTER = "shard int, log2 int, cells binary, spill array<bigint>, items long"


class Cuckoo:
    """A cuckoo filter over 64-bit keys. Keys that find no room after `KICKS` moves are kept whole in `spill`."""

    KICKS = 200

    def __init__(self, log2: int, cells: bytes | None = None, spill=(), items: int = 0):
        self.log2, self.mask, self.items = log2, (1 << log2) - 1, items
        self.cells = np.zeros((1 << log2, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()
        self.spill = {int(x) & (2**64 - 1) for x in spill}

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        return Cuckoo(max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))))

    def _places(self, keys: np.ndarray):
        h = mix(keys, 41)
        mark = (h >> U64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & U64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._step(mark)

    def _step(self, mark):
        return (mix(np.asarray(mark, np.uint64), 43) & U64(self.mask)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for key, mark, one, two in zip(keys, *self._places(keys), strict=True):
            self._add(int(key), mark, int(one), int(two))
        self.items += len(keys)

    def _add(self, key: int, mark, one: int, two: int) -> None:
        for at in (one, two):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return
        moves, at = [], one
        for k in range(self.KICKS):
            slot = (k * 7 + at) % SLOTS
            moves.append((at, slot, self.cells[at, slot]))
            mark, self.cells[at, slot] = self.cells[at, slot], mark
            at ^= int(self._step(np.array([mark]))[0])
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return
        for at, slot, old in reversed(moves):
            self.cells[at, slot] = old
        self.spill.add(key & (2**64 - 1))

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that were added."""
        for key, mark, one, two in zip(keys, *self._places(keys), strict=True):
            if (whole := int(key) & (2**64 - 1)) in self.spill:
                self.spill.remove(whole)
                continue
            for at in (int(one), int(two)):
                have = np.flatnonzero(self.cells[at] == mark)
                if len(have):
                    self.cells[at, have[0]] = 0
                    break
        self.items -= len(keys)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        found = (self.cells[one] == mark[:, None]).any(axis=1) | (self.cells[two] == mark[:, None]).any(axis=1)
        return found | np.isin(keys, np.array(list(self.spill), np.uint64)) if self.spill else found

    def row(self, shard: int) -> dict:
        return {"shard": shard, "log2": self.log2, "cells": self.cells.tobytes(), "spill": np.array(sorted(self.spill), np.uint64).view(np.int64).tolist(), "items": self.items}


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _filled(batches):
    """Rows sorted by shard: its filter or its size first (turn 0), then keys to add (1) and to remove (2)."""
    own, shard, out = None, None, []
    schema = pa.schema([("shard", pa.int32()), ("log2", pa.int32()), ("cells", pa.binary()), ("spill", pa.list_(pa.int64())), ("items", pa.int64())])
    for batch in batches:
        rows = batch.to_pylist()
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and (rows[j]["shard"], rows[j]["turn"]) == (rows[i]["shard"], rows[i]["turn"]):
                j += 1
            if rows[i]["shard"] != shard:
                if own is not None:
                    out.append(own.row(shard))
                shard, own = rows[i]["shard"], None
            if rows[i]["turn"] == 0:
                x = rows[i]
                own = Cuckoo(x["log2"], x["cells"], x["spill"], x["items"]) if x["cells"] is not None else Cuckoo.sized(x["items"])
            else:
                keys = np.array([x["key"] for x in rows[i:j]], np.int64).view(np.uint64)
                own.add(keys) if rows[i]["turn"] == 1 else own.remove(keys)
            i = j
    if own is not None:
        out.append(own.row(shard))
    yield pa.RecordBatch.from_pylist(out, schema)


def _probed(batches):
    """Rows sorted by part: a filter first, then the lines dealt to this copy of it; gives those that it may hold."""
    own, part = None, None
    for batch in batches:
        parts, cells = batch.column("part"), batch.column("cells")
        keep = np.zeros(batch.num_rows, bool)
        number = parts.to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))).tolist() + [batch.num_rows] if batch.num_rows else [0]
        keys = _unsigned(batch.column("k1").fill_null(0)) if batch.num_rows else None
        for a, b in zip(bounds, bounds[1:], strict=False):
            if number[a] != part:
                own, part = None, number[a]
            if cells[a].is_valid:
                own = Cuckoo(batch.column("log2")[a].as_py(), cells[a].as_py(), batch.column("spill")[a].as_py())
                a += 1
            if own is not None and a < b:
                keep[a:b] = own.has(keys[a:b])
        yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(keep)) for x in ("doc", "mark", "pos", "k1", "k2")], ["doc", "mark", "pos", "k1", "k2"])


@dataclass
class LineIndex:
    """The state after some inserts and deletions; each step gives a new one and leaves the old one as it was."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS
    least_chars: int = LEAST_CHARS
    #: References at most, and steps since the tables were written whole.
    n_refs: int = 0
    steps: int = 0

    @staticmethod
    def of(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shards: int | None = None) -> LineIndex:
        """The index of a first set of documents; by default as many shards as its repeated keys fill."""
        session(docs)
        refs = stored(_refs(docs, least_chars), "refs")
        counts = stored(_counted(refs), "counts")
        often = counts.where(F.col("n_docs") >= least_docs)
        shards = shards or max(4, -(-often.count() // SHARD_KEYS))
        return LineIndex(refs, counts, _build(often, shards), shards, least_docs, least_chars, refs.count())

    def save(self, folder: str) -> None:
        """Writes the index whole to a folder that must not exist."""
        for name in ("refs", "counts", "filters"):
            getattr(self, name).write.parquet(f"{folder}/{name}")
        state = [(self.shards, self.least_docs, self.least_chars, self.n_refs)]
        self.refs.sparkSession.createDataFrame(state, "shards int, least_docs int, least_chars int, n_refs long").coalesce(1).write.parquet(f"{folder}/state")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LineIndex:
        refs, counts, filters, state = (spark.read.parquet(f"{folder}/{name}") for name in ("refs", "counts", "filters", "state"))
        session(refs)
        x = state.first()
        return LineIndex(refs, counts, filters, x.shards, x.least_docs, x.least_chars, x.n_refs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; references that are there already count once."""
        new = stored(_refs(docs, self.least_chars).join(self.refs, ["k1", "k2", "doc"], "left_anti"), "refs")
        touched = stored(new.select("k1", "k2").distinct(), "touched")
        return self._after(self.refs.unionByName(new), touched, self.n_refs + new.count())

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Takes away documents by id."""
        gone = stored(ids.select(F.col(id_col).cast("long").alias("doc")).distinct(), "gone")
        touched = stored(self.refs.join(gone, "doc", "left_semi").select("k1", "k2").distinct(), "touched")
        return self._after(self.refs.join(gone, "doc", "left_anti"), touched, self.n_refs)

    def _after(self, refs: DataFrame, touched: DataFrame, n_refs: int) -> LineIndex:
        anew = stored(_counted(refs.join(touched, ["k1", "k2"], "left_semi")), "counts")
        counts, steps = self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(anew), self.steps + 1
        if steps >= MOST_STEPS:
            refs, counts, steps = stored(refs, "refs"), stored(counts, "counts"), 0
            n_refs = refs.count()
        was = self.counts.where(F.col("n_docs") >= self.least_docs).join(touched, ["k1", "k2"], "left_semi").select("k1", "k2")
        now = anew.where(F.col("n_docs") >= self.least_docs).select("k1", "k2")
        turn = lambda df, n: df.select(_shard(self.shards).alias("shard"), F.lit(n).alias("turn"), F.col("k1").alias("key"))
        change = turn(now.exceptAll(was), 1).unionByName(turn(was.exceptAll(now), 2))
        old = self.filters.select("*", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("key"))
        # a shard that gets too full is built anew from the exact table
        need = counts.where(F.col("n_docs") >= self.least_docs).groupBy(_shard(self.shards).alias("shard")).agg(F.count("*").alias("need"))
        full = old.join(need, "shard").where(F.col("need") > (F.lit(SLOTS * 0.95) * F.pow(F.lit(2.0), F.col("log2")))).select("shard")
        full = stored(full, "full")
        kept = _fill(old.join(full, "shard", "left_anti"), change.join(full, "shard", "left_anti"))
        often = counts.where(F.col("n_docs") >= self.least_docs)
        fresh = _build(often.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").drop("shard"), self.shards, only=full)
        return LineIndex(refs, counts, stored(kept.unionByName(fresh), "filters"), self.shards, self.least_docs, self.least_chars, n_refs, steps)

    def salts(self, spark: SparkSession) -> int:
        """Copies of each filter, so that lines are held against them in as many tasks as they need, however few the shards."""
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return max(SALTS, -(-cores // self.shards), -(-self.n_refs // (self.shards * PART_LINES)))

    def dropped(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, mark, pos) of the lines to drop: repeated ones, save in the largest document that holds them."""
        lines, salts = _lines(docs, self.least_chars, id_col, text_col), self.salts(session(docs))
        part = F.pmod(F.xxhash64("doc"), F.lit(salts)) + _shard(self.shards) * salts
        none = lambda kind: F.lit(None).cast(kind)
        rows = lines.select(part.cast("int").alias("part"), F.lit(1).alias("turn"), "doc", "mark", "pos", "k1", "k2", none("int").alias("log2"), none("binary").alias("cells"), none("array<bigint>").alias("spill"))
        copies = self.filters.select(F.explode(F.sequence(F.col("shard") * salts, F.col("shard") * salts + salts - 1)).alias("part"), F.lit(0).alias("turn"), none("long").alias("doc"), none("long").alias("mark"), none("int").alias("pos"), none("long").alias("k1"), none("long").alias("k2"), "log2", "cells", "spill")
        dealt = rows.unionByName(copies).repartition("part").sortWithinPartitions("part", "turn")
        maybe = dealt.mapInArrow(_probed, "doc long, mark long, pos int, k1 long, k2 long")
        often = self.counts.where(F.col("n_docs") >= self.least_docs)
        return maybe.join(often, ["k1", "k2"]).where("doc <> max_doc").select("doc", "mark", "pos")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """docs with the repeated lines taken out of the text, and the two counts: lines before, and lines dropped.

        A null text stays null; it counts as one line.
        """
        drop = self.dropped(docs, id_col, text_col).groupBy(F.col("doc").alias("_ld_doc"), F.col("mark").alias("_ld_mark"))
        drop = drop.agg(F.array_sort(F.collect_set("pos")).alias("_ld_at"))
        own = docs.withColumn("_ld_id", F.col(id_col).cast("long")).withColumn("_ld_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
        own = own.join(drop, (F.col("_ld_id") == F.col("_ld_doc")) & (F.col("_ld_hash") == F.col("_ld_mark")), "left")
        lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
        at = F.col("_ld_at")
        before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))
        mask = F.concat(
            F.array_join(F.zip_with(at, before, lambda a, b: F.concat(F.repeat(F.lit("1"), a - b - 1), F.lit("0"))), ""),
            F.repeat(F.lit("1"), F.size(lines) - F.element_at(at, -1) - 1),
        )
        left = F.filter(F.zip_with(lines, F.split(mask, ""), lambda x, m: F.when(m == "1", x)), lambda x: x.isNotNull())
        text = F.when(at.isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
        n_dropped = F.when(at.isNull(), 0).otherwise(F.size(at)).cast("long")
        own = own.withColumns({text_col: text, counts[0]: F.size(lines).cast("long"), counts[1]: n_dropped})
        return own.drop("_ld_id", "_ld_hash", "_ld_doc", "_ld_mark", "_ld_at")


def _shard(shards: int):
    return F.pmod("k2", F.lit(shards)).cast("int")


def _key_of(line):
    return ascii_lower(F.btrim(line, F.lit(WHITE_CHARS)))


def _keys(text, least_chars: int):
    """For each line, a 128-bit hash of its key; null where the key is short."""
    two = lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit("line"), k).alias("k2"))
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _key_of)
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, two(k)))


def _refs(docs: DataFrame, least_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.explode(_keys(F.col(text_col), least_chars)).alias("k"))
    return rows.where("k is not null").select("k.k1", "k.k2", "doc").distinct()


def _lines(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(_keys(text, least_chars)).alias("pos", "k"))
    return rows.where("k is not null").select("doc", "mark", "pos", "k.k1", "k.k2")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))


def _fill(first: DataFrame, change: DataFrame) -> DataFrame:
    rows = first.unionByName(change, allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard", "turn").mapInArrow(_filled, FILTER)


def _build(often: DataFrame, shards: int, only: DataFrame | None = None) -> DataFrame:
    """One filter for each shard (of `only`, if given), sized for its keys."""
    keys = often.select(_shard(shards).alias("shard"), F.lit(1).alias("turn"), F.col("k1").alias("key"))
    all_shards = only if only is not None else often.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    sizes = all_shards.join(keys.groupBy("shard").agg(F.count("*").alias("items")), "shard", "left").select("shard", F.coalesce("items", F.lit(0)).alias("size"))
    none = lambda kind: F.lit(None).cast(kind)
    first = sizes.select("shard", F.lit(0).alias("turn"), none("long").alias("key"), none("int").alias("log2"), none("binary").alias("cells"), none("array<bigint>").alias("spill"), F.col("size").cast("long").alias("items"))
    return stored(_fill(first, keys), "filters")


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Indexes the documents and takes their repeated lines out: docs with a new text and the two counts."""
    return LineIndex.of(docs, least_docs, least_chars).apply(docs, counts=counts)
