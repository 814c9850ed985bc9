"""Nearest vectors for many queries at once: exactly, or by an index of cells and codes with an exact last step.

A search names, for each query, the groups it asks (collections, or cells of an index). Tasks read vectors once a block of
queries, score each batch against the queries that ask its group, and keep the best so far of each pair asked; what a
task gives is at most the limit for each pair. Blocks of queries are stored one after the other, so the driver and a
task hold one block, whatever the number of queries.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import scratch
from .search import TIE

#: Queries whose vectors a task holds at once.
QUERY_BLOCK = 1000
#: Vectors scored at once.
ROWS = 4096
#: Sampled vectors for each cell that cells are learned from, and rounds of learning.
SAMPLE_PER_CELL, ROUNDS = 32, 12
#: Most cells where their number isn't given; with their sample they are what the driver holds.
MOST_CELLS = 4096
#: Indexed vectors by which the number of cells to read is measured, and the share of their exact nearest that those cells must hold.
TUNED, HELD = 200, 0.97
#: Cells that a search reads at least where their number isn't given.
PROBES = 16
#: Folders that cells are dealt to; a search reads those of its cells only.
PARTS = 64

HITS = "query_id long, collection string, id long, score double"


class _Best:
    """The best rows of each pair asked so far: higher scores first, then smaller ids."""

    def __init__(self, limit: int) -> None:
        self.limit, self.kept = limit, {}

    def add(self, pair, ids: np.ndarray, scores: np.ndarray) -> None:
        have = self.kept.get(pair)
        if have is not None:
            if len(have[0]) == self.limit:
                on = scores >= have[1][-1]
                if not on.any():
                    return
                ids, scores = ids[on], scores[on]
            ids, scores = np.concatenate((have[0], ids)), np.concatenate((have[1], scores))
        if len(ids) > 4 * self.limit:
            on = scores >= np.partition(scores, len(scores) - self.limit)[len(scores) - self.limit]
            ids, scores = ids[on], scores[on]
        at = np.lexsort((ids, -scores))[: self.limit]
        self.kept[pair] = ids[at], scores[at]


def _unit(a: np.ndarray) -> np.ndarray:
    size = np.sqrt((a**2).sum(axis=1))
    return a / np.where(size == 0, 1, size)[:, None]


def _matrix(column, dim: int | None = None) -> np.ndarray:
    """The vectors of an Arrow column; all must be equally long."""
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = dim or (len(flat) // n if n else 0)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors have {sorted(set(lengths.tolist()) | {dim})} entries; all must have the same number")
    return flat.reshape(n, dim)


def _by_name(column) -> list[tuple[str, np.ndarray]]:
    """The values of an Arrow string column with the rows of each; rows of null are in none."""
    coded = column.dictionary_encode()
    at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return [(name, np.flatnonzero(at == k)) for k, name in enumerate(coded.dictionary.to_pylist())]


def _blocks(queries: DataFrame, size: int):
    """Blocks of (query_id, vector, rest) rows, one at a time at the driver."""
    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def gathered(spark: SparkSession, parts, schema, tag: str) -> DataFrame:
    """The rows of several jobs as one table, each written before the next one is planned."""
    path = scratch(spark, tag)
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The best of each query and collection; Spark cuts each task's rows to the limit before it shuffles them."""
    nth = F.row_number().over(Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= limit)


def exact_hits(vectors: DataFrame, queries: DataFrame, limit: int, marked: str | None = None) -> DataFrame:
    """(query_id, collection, id, score, rank) of the nearest vectors (id, collection, embedding) of each (query_id, collection, vector), by cosine.

    Where `marked` names a boolean column of both, queries that have it see marked vectors only. Null vectors are like
    nothing; a vector of zeros has a score of 0. All vectors must have the same number of entries. Rows that repeat an id
    count once each.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    own = F.coalesce(F.col(marked), F.lit(False)) if marked else F.lit(False)
    rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "collection", F.col("embedding").cast("array<double>").alias("v"), own.alias("m"))
    asked = queries.where("vector is not null").groupBy("query_id").agg(F.first("vector").alias("vector"), F.first(own).alias("m"), F.collect_set("collection").alias("asks"))

    def run(block):
        ids, unit = [r.query_id for r in block], _unit(np.array([r.vector for r in block], np.float64))
        only, by = np.array([r.m for r in block], bool), defaultdict(list)
        for k, r in enumerate(block):
            for c in r.asks:
                by[c].append(k)

        def near(batches):
            best = _Best(limit)
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    b = whole.slice(start, ROWS)
                    at = {c: k for c, k in _by_name(b.column(1)) if c in by}
                    if not at:
                        continue
                    key, v, m = b.column(0).to_numpy(), _unit(_matrix(b.column(2), unit.shape[1])), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
                    for c, k in at.items():
                        scores = np.round(v[k] @ unit[by[c]].T, TIE)
                        for j, q in enumerate(by[c]):
                            on = k if not only[q] else k[m[k]]
                            best.add((q, c), key[on], scores[:, j] if not only[q] else scores[m[k], j])
            out = [(ids[q], c, i, s) for (q, c), (i, s) in best.kept.items()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([o[0] for o in out], [len(o[2]) for o in out]) if out else [], pa.int64()), pa.array([o[1] for o in out for _ in o[2]], pa.string()),
                pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()), pa.array(np.concatenate([o[3] for o in out]) if out else [], pa.float64()),
            ], ["query_id", "collection", "id", "score"])

        return rows.mapInArrow(near, HITS)

    return ranked(gathered(spark, map(run, _blocks(asked, QUERY_BLOCK)), HITS, "near"), limit)


# -- the index -------------------------------------------------------------------------------------------------------


def learned_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres of cells by spherical k-means over unit vectors; an empty cell takes the vector that is worst served."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        scores = sample @ centres.T
        own, best = scores.argmax(axis=1), scores.max(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        total[empty] = sample[np.argsort(best)[: len(empty)]]
        centres = _unit(total)
    return centres


@dataclass
class VectorIndex:
    """Vectors by cell: cells (cell, centre) and rows (part, cell, collection, id, code, embedding).

    `code` has a byte for each entry of the unit vector (its entries are scaled by the index's widest one). A search
    reads the codes of the nearest cells, and the whole vectors of the rows that it may give.
    """

    spark: SparkSession
    path: str
    measured: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, seed: int = 1) -> VectorIndex:
        """Builds and writes the index of vectors (id, collection, embedding); null vectors have no place in it.

        Cells (by default the root of the number of vectors) are learned from a sample of at most `SAMPLE_PER_CELL` vectors
        each; every vector is indexed. Cells are dealt to `PARTS` folders and sorted within, so that a search reads the
        folders and the row groups of its cells.
        """
        import pyarrow as pa

        spark = vectors.sparkSession
        index = VectorIndex(spark, path or scratch(spark, "vectors"))
        rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "collection", F.col("embedding").cast("array<float>").alias("embedding"))
        n = rows.count()
        cells = cells or min(MOST_CELLS, max(1, math.isqrt(n)))
        most = cells * SAMPLE_PER_CELL
        drawn = rows.select("embedding") if n <= most else rows.select("embedding").orderBy(F.xxhash64("id", F.lit(seed))).limit(most)
        sample = _unit(np.array([r[0] for r in drawn.collect()], np.float64)) if n else np.zeros((1, 1))
        centres = learned_cells(sample, cells, seed=seed)
        widest = float(np.abs(sample).max()) or 1.0

        def place(batches):
            for b in batches:
                if b.num_rows:
                    v = _unit(_matrix(b.column(2), centres.shape[1]))
                    cell = (v @ centres.T).argmax(axis=1).astype(np.int32)
                    code = np.clip(np.rint(v / widest * 127), -127, 127).astype(np.int8)
                    flat = [code[k].tobytes() for k in range(len(code))]
                    yield pa.RecordBatch.from_arrays([pa.array(cell % PARTS, pa.int32()), pa.array(cell), b.column(1), b.column(0), pa.array(flat, pa.binary()), b.column(2)], ["part", "cell", "collection", "id", "code", "embedding"])

        placed = rows.mapInArrow(place, "part int, cell int, collection string, id long, code binary, embedding array<float>")
        placed.hint("rebalance", "part").sortWithinPartitions("part", "cell", "id").write.mode("errorifexists").partitionBy("part").parquet(f"{index.path}/rows")
        spark.createDataFrame([(k, [float(x) for x in c], widest) for k, c in enumerate(centres)], "cell int, centre array<double>, widest double").coalesce(1).write.parquet(f"{index.path}/cells")
        return index

    def rows(self) -> DataFrame:
        # an empty index has no file to read a schema from
        return self.spark.read.schema("cell int, collection string, id long, code binary, embedding array<float>, part int").parquet(f"{self.path}/rows")

    def probes_for(self, limit: int) -> int:
        """How many of its nearest cells a search reads, so that they hold nearly all of what exact search finds.

        Measured against exact search for a sample of `TUNED` indexed vectors: where vectors lie in clusters a few cells do,
        where they don't it can be most of them.
        """
        if limit not in self.measured:
            spark = self.spark
            drawn = self.rows().select(F.col("id").alias("query_id"), "collection", F.col("embedding").cast("array<double>").alias("vector"))
            drawn = drawn.orderBy(F.xxhash64("query_id", F.lit(2)), "collection").limit(TUNED).collect()
            asked = spark.createDataFrame(drawn, "query_id long, collection string, vector array<double>")
            cells = self.rows().select("id", "collection", "cell")
            found = exact_hits(self.rows(), asked, limit).join(cells, ["id", "collection"]).select("query_id", "cell").collect()  # the limit for each drawn
            if not found:
                return PROBES
            centres = np.array([r.centre for r in spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()])
            nearness = dict(zip((r.query_id for r in drawn), _unit(np.array([r.vector for r in drawn], np.float64)) @ centres.T))
            place = sorted(int((nearness[r.query_id] >= nearness[r.query_id][r.cell]).sum()) for r in found)
            self.measured[limit] = max(PROBES, place[math.ceil(HELD * len(place)) - 1])
        return self.measured[limit]

    def search(self, queries: DataFrame, limit: int, probes: int | None = None, widen: int = 4, where: Column | None = None) -> DataFrame:
        """(query_id, collection, id, score, rank) of the nearest vectors of each (query_id, collection, vector), among those of the `probes` nearest cells.

        Without a number of probes it is `probes_for` the limit. The best `widen` times the limit by codes are scored exactly. `probes` of all cells, and `widen` of 0, is the exact
        search of what `where` lets through.
        """
        import pyarrow as pa

        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        centres, widest = np.array([r.centre for r in cells]), cells[0].widest
        if widen == 0:
            return exact_hits(self.rows() if where is None else self.rows().where(where), queries, limit)
        probes = self.probes_for(limit) if probes is None else probes
        asked = queries.where("vector is not null").groupBy("query_id").agg(F.first("vector").alias("vector"), F.collect_set("collection").alias("asks"))
        most = limit * widen

        def run(block):
            ids, unit = [r.query_id for r in block], _unit(np.array([r.vector for r in block], np.float64))
            k = min(probes, len(centres))
            wanted = np.argpartition(-(unit @ centres.T), k - 1, axis=1)[:, :k]
            by_cell, asks = defaultdict(list), [set(r.asks) for r in block]
            for q, own in enumerate(wanted):
                for c in own.tolist():
                    by_cell[c].append(q)
            rows = self.rows() if where is None else self.rows().where(where)
            rows = rows.where(F.col("part").isin(sorted({c % PARTS for c in by_cell})) & F.col("cell").isin(sorted(by_cell)))

            def near(batches):
                best = _Best(most)
                for whole in batches:
                    for start in range(0, whole.num_rows, ROWS):
                        b = whole.slice(start, ROWS)
                        cell, key, names = b.column(0).to_numpy(), b.column(2).to_numpy(), _by_name(b.column(1))
                        code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int8).reshape(b.num_rows, -1).astype(np.float32)
                        for c in np.unique(cell).tolist():
                            at = np.flatnonzero(cell == c)
                            scores = code[at] @ unit[by_cell[c]].T.astype(np.float32)
                            for name, rows_of in names:
                                on = np.flatnonzero(np.isin(at, rows_of, assume_unique=True))
                                for j, q in enumerate(by_cell[c]):
                                    if name in asks[q]:
                                        best.add((q, name), key[at[on]], scores[on, j])
                out = [(ids[q], c, i, s) for (q, c), (i, s) in best.kept.items()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([o[0] for o in out], [len(o[2]) for o in out]) if out else [], pa.int64()), pa.array([o[1] for o in out for _ in o[2]], pa.string()),
                    pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()), pa.array(np.concatenate([o[3] for o in out]).astype(float) if out else [], pa.float64()),
                ], ["query_id", "collection", "id", "score"])

            return rows.select("cell", "collection", "id", "code").mapInArrow(near, HITS)

        found = ranked(gathered(self.spark, map(run, _blocks(asked, QUERY_BLOCK)), HITS, "coded"), most)
        # whole vectors of the candidates only: at most `most` for each query and collection
        full = found.select("query_id", "collection", "id").join(self.rows().select("id", "collection", "embedding"), ["id", "collection"])
        full = full.join(asked.select("query_id", "vector"), "query_id")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        size = lambda a: F.when(dot(a, a) == 0, 1.0).otherwise(F.sqrt(dot(a, a)))
        e, v = F.col("embedding"), F.col("vector")
        score = F.round(dot(e, v) / (size(e) * size(v)), TIE)
        return ranked(full.select("query_id", "collection", "id", score.alias("score")), limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact nearest that were found, over all queries and collections."""
    keys = ["query_id", "collection", "id"]
    both = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
