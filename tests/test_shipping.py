"""The package reaches the Python workers, and scratch tables the shared folder, wherever a driver was started."""

import os
import subprocess
import sys
import types

import pytest

from sagebrush.sources import scratch

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["chunk_documents"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_import_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("rows")[1]) > 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master))
        with pytest.raises(ValueError):
            scratch.shared_dir(session)


def test_scratch_tables_can_be_dropped(spark):
    table = scratch.stored(spark.range(5), "five")
    path = table._stored_at.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    scratch.drop(table)
    assert not os.path.exists(path)
