"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of the MD5 of their id, are cut into blocks of `block_rows`. With weight w of all weights
W, block j of a source is released at slot floor(j * W / w) and due at slot ceil((j + 1) * W / w). In each slot the
released block with the earliest deadline goes (ties: by source), so at any slot a source has had less than one block
more or less than its weight gives it. Weights are taken as the exact fractions that they are, at every size; nothing
is rounded.

When a source has no block left for its turn, the others start anew from that slot by their weights among themselves,
with the same bound from there on. Rows up to the first such slot are `in_target`: there the mix has all its target
weights. Every slot has a block; no row is dropped or repeated.

The driver works out one entry for each block, holds `PIECE` of them at most and writes them to a table in the shared
folder, which is joined to the rows; its time grows with the blocks (three seconds a million, without the writing), so
at 1e10 rows and more a caller takes larger blocks. Positions within a source come from a range partitioning and one count for each
partition and source, so that no source, however large, is in one task.

The sources are listed on the driver, as their weights are. A null source is a source of its own. A null doc_id is
ordered as an empty one. Rows that repeat an id, or have none, each have a place of their own. Texts, however long or
empty, are not looked at. An empty table gives an empty result. Other columns pass through; of the columns added,
`mix_slot`, `mix_pos` and `in_target` replace columns of those names.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed, scratch, stored

BLOCK_ROWS = 64
#: Entries of the schedule that the driver holds, at most.
PIECE = 500_000
#: Rows of a partition of the range partitioning, at most.
PART_ROWS = 2_000_000


def turns(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, slot, in_target) of all blocks: earliest deadline first among those that are released."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    names = sorted(exact, key=lambda x: (x is not None, x or ""))
    share = [int(exact[s] * scale) for s in names]
    has, done = [blocks.get(s, 0) for s in names], [0] * len(names)
    left, slot, target = set(range(len(names))), 0, True
    while left and any(has[k] > done[k] for k in left):
        start, whole, base = slot, sum(share[k] for k in left), list(done)
        waiting, ready = [(0, k) for k in sorted(left)], []
        while True:
            while waiting and waiting[0][0] <= slot - start:
                k = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[k] - base[k] + 1) * whole // share[k]), k))
            k = heapq.heappop(ready)[1]
            if done[k] == has[k]:
                break
            yield names[k], done[k], slot, target
            done[k], slot = done[k] + 1, slot + 1
            heapq.heappush(waiting, ((done[k] - base[k]) * whole // share[k], k))
        left.remove(k)
        target = False


def positions(docs: DataFrame, total: int, id_col: str = "doc_id", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """(doc, src, row, rank): the place of each row in its source, from 0, by the MD5 of the id; row is key_col or null."""
    row = F.col(key_col) if key_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("src"), row.alias("row"))
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary")))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    by = ("src", "key", "doc", "row")
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = stored(rows.select("doc", "src", "row", F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", 33)
    # one row for each partition and source: at most as many as partitions and sources together
    counts = rows.groupBy("src", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    r, o = rows.withColumn("part", part).alias("r"), before.alias("o")
    found = r.join(o, F.expr("r.src <=> o.src and r.part = o.part"))
    return found.select("r.doc", "r.src", "r.row", (F.col("r.at") - F.col("o.first") + F.col("o.base")).alias("rank"))


def source_counts(docs: DataFrame, source_col: str = "source") -> dict:
    """Rows of each source."""
    return {r[0]: r[1] for r in docs.groupBy(F.col(source_col).alias("src")).agg(F.count("*").alias("n")).collect()}


def weights_by_power(counts: dict, power: float = 0.5) -> dict:
    """Target weights from the row counts of the sources raised to a power (temperature sampling), in whole 2^-20ths."""
    return {s: math.floor(n**power * 2**20) for s, n in counts.items()}


def schedule(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """(doc, src, row, mix_slot, mix_pos, in_target): the slot of a row's block and its place in the block."""
    counts = source_counts(docs, source_col)
    weights = weights if weights is not None else weights_by_power(counts)
    if missing := [s for s in counts if not weights.get(s)]:
        raise ValueError(f"sources without a weight: {missing[:10]}")
    slots = _written(docs.sparkSession, turns(weights, {s: -(-n // block_rows) for s, n in counts.items()})).alias("t")
    rank = positions(docs, sum(counts.values()), id_col, source_col, key_col)
    rows = rank.withColumn("block", F.floor(F.col("rank") / block_rows)).alias("r")
    rows = rows.join(slots, F.expr("r.src <=> t.src and r.block = t.block"))
    return rows.select("r.doc", "r.src", "r.row", F.col("slot").alias("mix_slot"), (F.col("rank") % block_rows).alias("mix_pos"), "in_target")


def _written(spark: SparkSession, entries: Iterator[tuple]) -> DataFrame:
    """The entries of a schedule as a table in the shared folder, written piece by piece."""
    schema = pa.schema([("src", pa.string()), ("block", pa.int64()), ("slot", pa.int64()), ("in_target", pa.bool_())])
    path, wanted = scratch(spark, "slots"), "src string, block long, slot long, in_target boolean"
    while piece := list(itertools.islice(entries, PIECE)):
        columns = [pa.array(x, f.type) for x, f in zip(zip(*piece, strict=True), schema, strict=True)]
        spark.createDataFrame(pa.table(columns, schema=schema)).write.mode("append").parquet(path)
    return spark.read.schema(wanted).parquet(path)


def mixed(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with mix_slot, mix_pos and in_target, in the order of the mix."""
    rows = keyed(docs.drop("mix_slot", "mix_pos", "in_target"), "_row_key", id_col)
    plan = schedule(rows, weights, block_rows, id_col, source_col, "_row_key")
    plan = plan.select(F.col("row").alias("_row_key"), "mix_slot", "mix_pos", "in_target")
    return rows.join(plan, "_row_key").drop("_row_key").orderBy("mix_slot", "mix_pos")
