"""Pages of a sorted table: joined they are the table, ties and equal rows included; a page reads its own files."""

import random

import pytest
from pyspark.sql import functions as F

from sagebrush.operators.cursors import SortedTable


def walked(table, size, **more):
    pages, token = [], None
    while True:
        rows, token = table.page(size, token, **more)
        pages.append([tuple(r)[:-1] for r in rows.collect()])
        if token is None:
            return pages


def test_pages_are_the_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(9), rng.choice(["a", "b", None])) for _ in range(300)] + [(5, "a")] * 40
    table = SortedTable(spark, f"{tmp_path}/t")
    table.write(spark.createDataFrame(rows, "k long, s string").repartition(8), "k", F.desc("s"))
    want = sorted(rows, key=lambda r: (r[0], r[1] is None, {"b": 0, "a": 1, None: 2}[r[1]]))
    for size in (1000, 64, 340):
        pages = walked(table, size)
        assert [r for p in pages for r in p] == want and all(len(p) == size for p in pages[:-1])
    only = walked(table, 25, where=F.col("s") == "b")
    assert [r for p in only for r in p] == [r for r in want if r[1] == "b"] and all(len(p) == 25 for p in only[:-1])


def test_pages_of_one_version_and_their_files(spark, tmp_path):
    table = SortedTable(spark, f"{tmp_path}/t")
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table.write(own.range(1000).withColumn("v", F.col("id") * 2), "id")
    first, token = table.page(100)
    table.write(spark.range(7).withColumn("v", F.col("id")), "id")
    # the walk goes on in its version; a new one begins in the latest
    second, _ = table.page(100, token)
    assert [r.id for r in second.collect()] == list(range(100, 200)) and table.page(100)[0].count() == 7
    files = own.read.parquet(f"{tmp_path}/t/sorted").where("id >= 0").inputFiles()
    assert len(first.inputFiles()) < len(files)
    empty = SortedTable(spark, f"{tmp_path}/e")
    empty.write(spark.range(0), "id")
    assert empty.page(5)[0].count() == 0 and empty.page(5)[1] is None
    with pytest.raises(ValueError):
        SortedTable(spark, f"{tmp_path}/none").page(5)
    with pytest.raises(ValueError):
        table.page(0)
