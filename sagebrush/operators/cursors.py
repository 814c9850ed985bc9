"""Pages of a sorted table, each by a token of the one before; a page reads the files that it lies in, and no others.

The table is written once in its order, by ranges, as a version of its own (see `sources.snapshots`), beside the number of
rows of each file. A token is a version and a place, so pages stay what they are while newer versions come; rows with
equal keys, and equal rows, have places of their own.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.snapshots import SEGMENT, Snapshots

TABLE = "sorted"


class SortedTable:
    """A table in the order of some columns, to be read page by page."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.tables = spark, Snapshots(spark, path)

    def write(self, rows: DataFrame, *order: Column | str) -> int:
        """Writes a version of the table in the given order, and gives its number."""
        name = self.tables.write(rows.orderBy(*order), TABLE)
        own = self.spark.read.schema(rows.schema).parquet(f"{self.tables.path}/{TABLE}/{SEGMENT}={name}")
        # one row a file; files are numbered in the order of the ranges
        sizes = sorted(own.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect())
        files = [(r.file, r.n) for r in sizes if r.n]

        def change(m):
            new = m.without(TABLE).with_segment(TABLE, name, rows.schema)
            return type(new)(**{**new.__dict__, "schemas": new.schemas | {TABLE: rows.schema.json()}, "notes": new.notes | {"files": files}})

        return self.tables.commit("sort", change).version

    def page(self, size: int = 50, token: str | None = None, where: Column | None = None) -> tuple[DataFrame, str | None]:
        """(rows, token): the next rows in order, with their place as `_place`, and the token to go on with; None after the last.

        With `where` a page has the next rows that meet it; files are read, twice as many each time, until there are enough.
        """
        if size < 1:
            raise ValueError("a page has one row at least")
        version, start = map(int, token.split(":")) if token else (self.tables.manifest().version, 0)
        m = self.tables.manifest(version)
        files = m.notes.get("files", [])
        ends = list(accumulate(n for _, n in files))
        total = ends[-1] if ends else 0
        first = bisect_right(ends, start)
        last = bisect_right(ends, min(start + size, total) - 1) if start < total else first
        schema = StructType.fromJson(json.loads(m.schemas[TABLE])) if TABLE in m.schemas else None
        if schema is None:
            raise ValueError(f"{self.tables.path} has no rows yet")
        if start >= total:
            return self.spark.createDataFrame([], schema).withColumn("_place", F.lit(0).cast("long")), None
        folder = f"{self.tables.path}/{TABLE}/{SEGMENT}={next(iter(m.segments(TABLE)))}"
        while True:
            chosen = [(f, ends[k] - n) for k, (f, n) in enumerate(files)][first : last + 1]
            rows = self.spark.read.schema(schema).parquet(*(f"{folder}/{f}" for f, _ in chosen))
            # as many entries as files that are read
            begins = F.create_map(*[F.lit(x) for pair in chosen for x in pair])
            rows = rows.select("*", (begins[F.col("_metadata.file_name")] + F.col("_metadata.row_index")).alias("_place")).where(F.col("_place") >= start)
            if where is None:
                rows = rows.where(F.col("_place") < start + size)
                after = start + size
                break
            rows = rows.where(where).orderBy("_place").limit(size)
            found = rows.agg(F.count("*").alias("n"), F.max("_place").alias("at")).first()
            if found.n == size or last >= len(files) - 1:
                after = found.at + 1 if found.n == size else total
                break
            last = min(len(files) - 1, first + 2 * (last - first + 1) - 1)
        return rows.orderBy("_place"), f"{version}:{after}" if after < total else None
