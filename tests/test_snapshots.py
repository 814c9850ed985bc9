"""Versions of tables: killed and competing writers, old versions, compaction, migration."""

import pytest
from pyspark.sql import functions as F

from sagebrush.operators.chunks import ChunkStore, chunk_id
from sagebrush.sources import snapshots
from sagebrush.sources.snapshots import Conflict, Snapshots

CHUNK = "id long, path string, collection string, doc_title string, book_id string, content string"


def rows(spark, *items):
    return spark.createDataFrame([(k, p, c, f"Title {p}", p, t) for k, p, c, t in items], CHUNK)


def seen(store, version=None):
    return sorted((r.id, r.content) for r in store.read(version).collect())


@pytest.fixture
def store(spark, tmp_path):
    out = ChunkStore(spark, f"{tmp_path}/store")
    out.add(rows(spark, (1, "a", "go", "one"), (2, "a", "go", "two"), (3, "b", "python", "three"), (4, "c", "python", "four")))
    return out


def test_changes_and_old_versions(spark, store):
    assert store.collections() == ["go", "python"] and store.ensure("rust", "go").version == 2 and store.ensure("rust").version == 2
    store.replace(rows(spark, (5, "a", "rust", "new"), (6, "d", "go", "six")))
    assert seen(store) == [(3, "three"), (4, "four"), (5, "new"), (6, "six")]
    store.delete(spark.createDataFrame([("b",), ("b",), (None,)], "path string"))
    store.add(rows(spark, (7, "b", "python", "again"), (8, None, None, "nowhere")))
    want = [(4, "four"), (5, "new"), (6, "six"), (7, "again"), (8, "nowhere")]
    assert seen(store) == want
    assert store.drop("go").version == 6 and seen(store) == [x for x in want if x[0] != 6] and store.collections() == ["python", "rust"]
    store.add(rows(spark, (9, "g", "go", "back")))
    assert (9, "back") in seen(store) and store.collections() == ["go", "python", "rust"]
    # every version reads as it was
    assert seen(store, 1) == [(1, "one"), (2, "two"), (3, "three"), (4, "four")] and seen(store, 5) == want
    now = seen(store)
    assert store.compact(50) is None and store.compact(1).operation == "compact" and seen(store) == now
    assert len(store.tables.manifest().segments("chunks")) == 1 and not store.tables.manifest().segments("deletes")
    store.replace(rows(spark, (10, "g", "go", "later")))
    assert (9, "back") not in seen(store) and (10, "later") in seen(store)
    assert seen(ChunkStore(spark, store.tables.path)) == seen(store) and store.restore(1).version == 10 and seen(store) == seen(store, 1)


def test_killed_writers_change_nothing(spark, store, monkeypatch):
    """A writer is killed between any two steps: after the first segment, after all of them, before the rename."""
    before, steps = seen(store), []
    real = {"write": Snapshots.write, "publish": Snapshots._publish}

    def dying(name, after):
        def run(self, *a, **k):
            if name == "publish":
                raise KeyboardInterrupt
            out = real[name](self, *a, **k)
            steps.append(out)
            if len(steps) >= after:
                raise KeyboardInterrupt
            return out

        return run

    for name, after in (("write", 1), ("write", 2), ("publish", 0)):
        steps.clear()
        with monkeypatch.context() as m:
            m.setattr(Snapshots, "write" if name == "write" else "_publish", dying(name, after))
            with pytest.raises(KeyboardInterrupt):
                store.replace(rows(spark, (99, "a", "go", "lost")))
        assert seen(store) == before and store.tables.versions() == [1]
    orphans = len(store.tables._names(f"{store.tables.path}/chunks")) - 1
    assert orphans == 3 and store.tables.vacuum() == 0
    assert store.tables.vacuum(older_than_s=-5) == orphans + 2 and seen(store) == before
    store.replace(rows(spark, (99, "a", "go", "kept")))
    assert (99, "kept") in seen(store)


def test_writers_at_once(spark, store, monkeypatch):
    """Another writer publishes while one is about to: both count, each change is in one version."""
    real, other = Snapshots.manifest, ChunkStore(spark, store.tables.path)
    pending = [lambda: other.replace(rows(spark, (20, "c", "go", "other")))]

    def late(self, version=None):
        out = real(self, version)
        if version is None and pending and self is store.tables:
            pending.pop()()
        return out

    monkeypatch.setattr(Snapshots, "manifest", late)
    assert store.replace(rows(spark, (21, "a", "go", "mine"))).version == 3
    assert seen(store) == [(3, "three"), (20, "other"), (21, "mine")]
    # a rewrite that would bring back what was deleted meanwhile is refused; one that misses new chunks is not
    pending.append(lambda: other.delete(spark.createDataFrame([("b",)], "path string")))
    with pytest.raises(Conflict):
        store.rewrite()
    pending.append(lambda: other.add(rows(spark, (22, "z", "go", "new"))))
    store.rewrite()
    assert seen(store) == [(20, "other"), (21, "mine"), (22, "new")]


def test_migration_and_deletion_by_words(spark, store):
    store.ensure("empty")
    out = {r.collection: (r.before, r.after, r.state) for r in store.migrate(lambda d: d.withColumn("size", F.length("content"))).collect()}
    assert out == {"go": (2, 2, "migrated"), "python": (2, 2, "migrated"), "empty": (0, 0, "skipped")}
    assert store.read().where("size = length(content)").count() == 4 and "size" not in store.read(1).columns
    gone = {r.collection: r.n for r in store.delete_named("Title A").collect()}
    assert gone == {"go": 2} and [k for k, _ in seen(store)] == [3, 4]
    with pytest.raises(ValueError):
        store.delete_named(" ")
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("x", "go", 1)], "path string, collection string, content int"))


def test_histories_and_kept_versions(spark, store):
    for k in range(5):
        store.add(rows(spark, (30 + k, "h", "go", "x")))
    assert [(r.version, r.operation, r.segments) for r in store.tables.history().where("table = 'chunks'").orderBy("version").collect()] == [(k, "add", k) for k in range(1, 7)]
    store.rewrite()
    now = seen(store)
    assert store.tables.vacuum(keep=1, older_than_s=-5) == 6 and seen(store) == now and store.tables.versions() == [7]
    with pytest.raises(ValueError):
        store.read(3)
    with pytest.raises(ValueError):
        ChunkStore(spark, store.tables.path + "-none").read()
    assert snapshots.Manifest().segments("any") == {}


def test_ids_of_chunks(spark):
    got = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), (None, 1)], "p string, n int").select(chunk_id(F.col("p"), F.col("n"))).collect()
    assert got[0] == got[2] and len({r[0] for r in got}) == 3 and all(len(r[0]) == 36 and r[0].count("-") == 4 for r in got)
