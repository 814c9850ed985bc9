"""Retrieval and ingestion against plain versions, and their edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrush import registry
from sagebrush.operators import chunks as C
from sagebrush.operators import documents as D
from sagebrush.operators import ingest as L
from sagebrush.operators import retrieval as Q
from sagebrush.operators import vectors as Y
from sagebrush.plans import inline as I
from sagebrush.sources.snapshots import Conflict

SF = "/root/testdata/sf0.001"

WORDS = [f"word{k}" for k in range(60)]
CHUNK = "id long, content string, collection string, doc_title string, section_path string, chunk_type string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    kinds = ["detail", "structural", "summary"]
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 30))), ["python", "go", "general"][k % 3], f"Book {k % 4}", f"Book > Part {k % 5}", kinds[k % 7 % 3]) for k in range(90)]
    rows += [(90, None, "go", "Book 1", None, None), (91, "", "rust", None, "", "detail")]
    vectors = [(k, c, [rng.gauss(0, 1) for _ in range(4)]) for k, _, c, *_ in rows if k % 2 == 0] + [(91, "rust", None)]
    queries = [(1, "how to word1 word2", None, [1.0, 0.0, 0.5, 0.0]), (2, "word3 word3 word9", "Go", [0.0, 1.0, 0.0, 0.2]), (3, "how many chapters are there word5", None, None), (4, "", None, [0.0, 0.0, 0.0, 0.0]), (5, "nothing known", None, None)]
    return (
        rows, vectors, queries,
        spark.createDataFrame(rows, CHUNK), spark.createDataFrame(vectors, "id long, collection string, embedding array<double>"), spark.createDataFrame(queries, "query_id long, query string, label string, vector array<double>"),
    )


def plain_sparse(rows, query, collection):
    tokens = lambda t: [w for w in (t or "").lower().split() if 2 <= len(w) <= 50]
    docs = {i: tokens(t) for i, t, c, *_ in rows if c == collection}
    n, total = len(docs), sum(map(len, docs.values()))
    average = total / n if total else 1.0
    df = Counter(w for d in docs.values() for w in set(d))
    norm = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))
    own, out = Counter(tokens(query)), {}
    for i, d in docs.items():
        tf = Counter(d)
        s = sum((math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)) ** 2 * norm(tf[w], len(d)) * norm(k, len(tokens(query))) for w, k in own.items() if tf[w])
        if round(s, 9) > 0:
            out[i] = round(s, 9)
    return sorted(out, key=lambda i: (-out[i], i)), out


def plain_dense(vectors, vector, collection):
    def cosine(a, b):
        x, y = (math.sqrt(sum(t * t for t in v)) or 1 for v in (a, b))
        return round(sum(s * t for s, t in zip(a, b, strict=True)) / x / y, 9)

    score = {i: cosine(v, vector) for i, c, v in vectors if c == collection and v is not None} if vector is not None else {}
    return sorted(score, key=lambda i: (-score[i], i))


def plain_fused(lists, limit):
    there = [x for x in lists if x]
    score, first = Counter(), {}
    for at, own in enumerate(lists):
        for rank, i in enumerate(own[: max(3 * limit, 20)], 1):
            score[i] += 1 / (60 + rank)
            first.setdefault(i, (at, rank))
    score = {i: round(s / (len(there) / 61), 12) for i, s in score.items()}
    return [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], first[i]))][:limit]


def plain_hits(corpus, forced, expansions=()):
    rows, vectors, queries = corpus[:3]
    out = {}
    for q, text, _, vector in queries:
        structural = "chapters" in text
        keep = lambda x: [r for r in x if not structural or r[5] == "structural"]

        def search(words, v, limit):
            for place, c in enumerate(forced):
                ids = {r[0] for r in keep(rows)}
                sparse, _ = plain_sparse(rows, words, c)
                lists = [[i for i in plain_dense(vectors, v, c) if i in ids], [i for i in sparse if i in ids]]
                yield from ((i, s, place, rank) for rank, (i, s) in enumerate(plain_fused(lists, limit)))

        own = [(i, s, 0, p, r) for i, s, p, r in search(text, vector, 20)]
        own.sort(key=lambda x: (-x[1], x[3], x[4]))
        if sum(s > 0.6 for _, s, *_ in own) < 3:
            structural = False
            for e, n, words, v in expansions:
                if e == q:
                    own += [(i, s, n, p, r) for i, s, p, r in search(words, v, 10)]
        seen, first = set(), []
        for x in own:
            if x[0] not in seen:
                seen.add(x[0])
                first.append(x)
        first.sort(key=lambda x: (-x[1], x[2], x[3], x[4]))
        out[q] = [(i, round(s, 9)) for i, s, *_ in first[:20]]
    return out


def test_hits_equal_plain_loops(spark, corpus, tmp_path):
    *_, chunks, vectors, queries = corpus
    Q.SparseIndex(spark, f"{tmp_path}/index").insert(chunks)
    forced = ["go", "python", "rust", "nothing"]
    want = plain_hits(corpus, forced)
    more = [(1, 1, "word7 word8", [0.1, 0.2, 0.3, 0.4]), (3, 1, "word11", None), (5, 1, "word1 word2 word3", None), (5, 2, "word4", [1.0, 1.0, 0.0, 0.0])]
    expansions = spark.createDataFrame(more, "query_id long, n int, query string, vector array<double>")
    for given, expected in ((None, want), (expansions, plain_hits(corpus, forced, more))):
        got = {}
        for r in Q.hits(Q.SparseIndex(spark, f"{tmp_path}/index"), vectors, chunks, queries, forced=forced, expansions=given).orderBy("query_id", "nth").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
        assert got == {q: x for q, x in expected.items() if x}


def test_contexts_and_filters(spark, corpus):
    *_, chunks, vectors, queries = corpus
    index = Q.SparseIndex(spark).insert(chunks)
    found = Q.hits(index, vectors, chunks, queries, forced=["go", "python"])
    shown = {r.query_id: r for r in Q.contexts(found, chunks, queries, Q.overlap_rerank, least=0.0).collect()}
    assert set(shown) == {r[0] for r in found.select("query_id").distinct().collect()} and all(1 <= r.n <= 5 and r.formatted for r in shown.values())
    only = Q.hits(index, vectors, chunks, queries, forced=["go", "python"], where=F.col("chunk_type") == "summary")
    kinds = only.where("query_id <> 3").join(chunks, "id").select("chunk_type").distinct().collect()
    assert [r[0] for r in kinds] == ["summary"]
    assert Q.hits(index, vectors, chunks, queries.limit(0)).count() == 0
    memories = spark.createDataFrame([("memory", "user", "p"), ("memory", "user", "q"), ("detail", "user", "p")], "chunk_type string, scope string, project string")
    assert memories.where(Q.memory_filter("user", "p")).count() == 1 and memories.where(Q.memory_filter()).count() == 2
    heads = spark.createDataFrame([("error",), ("conceptual",), ("code",)], "kind string").select(Q.prefix_of(F.col("kind"), {"general": "g", "error": "e", "code": "c", "structural": "s"})).collect()
    assert [r[0] for r in heads] == ["e", "g", "c"]


@pytest.mark.parametrize("parts", [4, 16])
def test_retrieval_is_written_whole(spark, tmp_path, parts):
    """Results of all three queries as files, in sessions with few and with many shuffle partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", parts)
    rows = {}
    for name in ("retrieval_contexts", "retrieval_hits", "retrieval_rows"):
        registry.queries()[name](own, SF).write.parquet(f"{tmp_path}/{name}")
        rows[name] = spark.read.parquet(f"{tmp_path}/{name}").count()
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert rows["retrieval_contexts"] <= asked and rows["retrieval_hits"] == rows["retrieval_rows"] > asked


def plain_scores(docs, query):
    tokens = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if 2 <= len(w) <= 50]
    own, out = Counter(tokens(query)), {}
    for c in {c for _, c in docs.values()}:
        part = {i: tokens(t) for i, (t, name) in docs.items() if name == c}
        n, average = len(part), (sum(map(len, part.values())) / len(part)) or 1.0
        df = Counter(w for d in part.values() for w in set(d))
        norm = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))
        for i, d in part.items():
            tf = Counter(d)
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) ** 2 * norm(tf[w], len(d)) * norm(k, sum(own.values())) for w, k in own.items() if tf[w])
            if round(s, 9) > 0:
                out[c, i] = round(s, 9)
    return out


def test_a_growing_index_equals_one_made_anew(spark, tmp_path):
    """Random inserts, replacements, deletes and merges: scores and counts are those of the chunks that are there."""
    rng = random.Random(8)
    index, docs = Q.SparseIndex(spark, f"{tmp_path}/grown"), {}
    make = lambda rows: spark.createDataFrame([(i, t, c) for i, (t, c) in rows.items()], "id long, content string, collection string")
    asked = spark.createDataFrame([(1, c, "word1 word2 word2 word59") for c in ("go", "rust", "none")], "query_id long, collection string, query string")
    text = lambda: rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randrange(1, 25)))]) if rng.random() < 0.2 else " ".join(rng.choices(WORDS, k=rng.randrange(1, 25)))
    versions = {}
    for step, kind in enumerate(["insert", "insert", "replace", "delete", "merge", "replace", "insert", "delete", "delete"]):
        if kind == "insert":
            new = {step * 100 + k: (text(), rng.choice(["go", "rust"])) for k in range(30)}
            index.insert(make(new))
            docs |= new
        elif kind == "replace":
            new = {i: (text(), rng.choice(["go", "rust"])) for i in [*rng.sample(sorted(docs), 12), step * 100 + 99]}
            index.replace(make(new))
            docs |= new
        elif kind == "delete":
            gone = [*rng.sample(sorted(docs), 10), 12345]
            index.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0]]], "id long"))
            docs = {i: x for i, x in docs.items() if i not in gone}
        else:
            assert index.compact(2) and not index.compact(2)
        versions[index.tables.manifest().version] = dict(docs)
        if step in (3, 4, 8):
            got = {(r.collection, r.id): r.score for r in index.search(asked, 1000).collect()}
            want = plain_scores(docs, "word1 word2 word2 word59")
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
            assert {r.collection: r.n_docs for r in index.stats().collect()} == dict(Counter(c for _, c in docs.values()))
    assert index.delete(spark.createDataFrame([(i,) for i in docs], "id long")).search(asked, 5).count() == 0
    assert index.stats().count() == 0
    # an old version of the counts is still there
    first = index.tables.manifest(2)
    assert sum(r.n_docs for r in index.stats(first).collect()) == 60


def test_two_deletes_at_once_are_refused(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, "word1 word2", "go") for k in range(6)], "id long, content string, collection string")
    index, other = (Q.SparseIndex(spark, f"{tmp_path}/both") for _ in range(2))
    index.insert(rows)
    real = Q.SparseIndex._gone

    def late(self, ids, base):
        out = real(self, ids, base)
        if self is index:
            other.delete(rows.where("id = 1").select("id"))
        return out

    monkeypatch.setattr(Q.SparseIndex, "_gone", late)
    with pytest.raises(Conflict):
        index.delete(rows.where("id < 3").select("id"))
    assert index.stats().first().n_docs == 5


# -- vectors ---------------------------------------------------------------------------------------------------------


def test_nearest_vectors_equal_plain_sort(spark, monkeypatch):
    """Ties, zeros, nulls, repeated ids, several blocks of queries and batches; groups not asked give nothing."""
    rng = random.Random(4)
    monkeypatch.setattr(Y, "QUERY_BLOCK", 3)
    monkeypatch.setattr(Y, "ROWS", 16)
    rows = [(k, rng.choice(["a", "b", None]), [float(rng.randrange(-2, 3)) for _ in range(3)] if k % 11 else None, k % 3 == 0) for k in range(200)] + [(5, "a", [1.0, 0.0, 0.0], True)]
    asked = [(q, c, None if q == 4 else [float(rng.randrange(-2, 3)) for _ in range(3)], q % 2 == 0) for q in range(8) for c in ("a", "b", "c") if (q + ord(c)) % 3]
    asked = [(q, c, next(v for p, _, v, _ in asked if p == q), o) for q, c, _, o in asked]
    vectors = spark.createDataFrame(rows, "id long, collection string, embedding array<float>, only boolean")
    queries = spark.createDataFrame(asked, "query_id long, collection string, vector array<double>, only boolean")
    for marked in (None, "only"):
        want = {}
        for q, c, v, only in asked:
            def cosine(a):
                size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in v))
                return round(sum(x * y for x, y in zip(a, v)) / size, 9) if size else 0.0
            if v is not None:
                own = sorted(((-cosine(e), i) for i, k, e, m in rows if k == c and e is not None and (m or not (marked and only))))
                want[q, c] = [(i, -s) for s, i in own[:7]]
        got = {}
        for r in Y.exact_hits(vectors, queries, 7, marked).orderBy("query_id", "collection", "rank").collect():
            got.setdefault((r.query_id, r.collection), []).append((r.id, r.score))
        near = lambda a, b: [i for i, _ in a] == [i for i, _ in b] and all(abs(x - y) < 1e-8 for (_, x), (_, y) in zip(a, b))
        assert got.keys() == {k for k, x in want.items() if x} and all(near(got[k], want[k]) for k in got)
    with pytest.raises(Exception, match="all must have the same number"):
        Y.exact_hits(spark.createDataFrame([(1, "a", [1.0, 2.0], True), (2, "a", [1.0], True)], vectors.schema), queries, 3).collect()
    assert Y.exact_hits(vectors.limit(0), queries, 3).count() == Y.exact_hits(vectors, queries.limit(0), 3).count() == 0


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(k, "ab"[k % 2], (centres[k % 12] + 0.5 * rng.normal(size=16)).tolist()) for k in range(1500)] + [(9000, "a", None)]
    vectors = spark.createDataFrame(rows, "id long, collection string, embedding array<double>")
    asked = vectors.where("id % 50 = 0 and embedding is not null").select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("collection"), F.col("embedding").alias("vector"))
    index = Y.VectorIndex.build(vectors, f"{tmp_path}/v", 30)
    assert index.rows().count() == 1500
    exact = Y.exact_hits(vectors.select("id", "collection", F.col("embedding").cast("array<float>").alias("embedding")), asked, 10)
    found = Y.VectorIndex(spark, f"{tmp_path}/v").search(asked, 10, probes=8)
    assert Y.recall(found, exact).first().recall >= 0.9
    # all cells: nothing is lost but what codes confuse beyond four times the limit; none of the cells' rows are scored twice
    every = index.search(asked, 10, probes=30)
    assert Y.recall(every, exact).first().recall > 0.99 and every.groupBy("query_id", "collection", "id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, index.search(asked, 10, widen=0).collect())) == sorted(map(tuple, exact.collect()))
    only = index.search(asked, 10, where=F.col("id") < 300)
    assert only.where("id >= 300").count() == 0 and only.count() > 0


def test_vector_index_reads_as_many_cells_as_it_takes(spark, tmp_path):
    """Vectors without clusters: the nearest are spread over many cells."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(k, "a", rng.normal(size=48).tolist()) for k in range(3000)], "id long, collection string, embedding array<double>")
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "collection", F.col("embedding").alias("vector"))
    index = Y.VectorIndex.build(vectors, f"{tmp_path}/v")
    exact = Y.exact_hits(vectors, asked, 10)
    assert Y.recall(index.search(asked, 10), exact).first().recall >= 0.9 > Y.recall(index.search(asked, 10, probes=16), exact).first().recall
    empty = Y.VectorIndex.build(vectors.limit(0), f"{tmp_path}/empty")
    assert empty.search(asked.limit(0), 10).count() == 0


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([("alpha beta",), ("beta alpha",), ("",), (None,), ("gamma",)], "t string").select(Q.hashed_vector(F.col("t"), 16)).collect()
    a, b, c, d, e = (r[0] for r in rows)
    assert a == b and c == d == [0.0] * 16 and len(e) == 16
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and sum(x != 0 for x in e) == 1


def test_ingest_and_store(spark, tmp_path):
    store, files = f"{tmp_path}/store", I.DOC_FILES.df(spark)
    done = {r.path: r for r in L.ingest(files, store, None, 64, 8).collect()}
    assert done["lost.md"].error == "no content" and done["book.pdf"].error and not done["book.pdf"].indexed
    assert done["docs/guide.md"].chunks_stored > 10 and done["src/a.py"].chunks_stored == 2 and done["empty.md"].chunks_stored == 0
    read = lambda: C.ChunkStore(spark, store).read()
    back = read()
    n = back.count()
    assert n == sum(r.chunks_stored for r in done.values())
    guide = back.where("path = 'docs/guide.md'")
    assert {r[0] for r in guide.select("chunk_type").distinct().collect()} == {"detail", "summary"} and guide.where("chapter = 'Guide' and section = 'Setup'").count() > 5
    # a file that comes again takes the place of what was stored of it
    assert L.totals(L.ingest(files, store, None, 64, 8)).first()[:] == (6, 2, n)
    assert read().count() == n and read().select("id").distinct().count() == n
    L.ingest_text(spark, "more.md", "# More\n\nSome words.", store, "personal")
    assert read().where("collection = 'personal'").count() == 1
    C.ChunkStore(spark, store).drop("personal")
    assert read().count() == n
    # a file that is empty now has no chunks any more
    L.ingest(spark.createDataFrame([("src/a.py", "")], "path string, content string"), store)
    assert read().where("path = 'src/a.py'").count() <= 1


def test_ingest_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nwords")
    (tmp_path / "in" / "b.py").write_text("import os\n\ndef f():\n    pass\n")
    out = {r.path.rsplit("/", 1)[1]: (r.format, r.chunks_stored) for r in L.ingest_folder(spark, str(tmp_path / "in"), f"{tmp_path}/store").collect()}
    assert out == {"a.md": ("markdown", 1), "b.py": ("code", 1)}


def test_code_pieces(spark):
    got = {(r.path, r.name): r for r in D.split_code(I.CODE_FILES.df(spark)).collect()}
    assert got["src/a.py", "f"].content == "import os\nfrom x import y\n\ndef f(x):\n    return x" and got["src/a.py", "A"].type == "class"
    assert got["c.go", "Box"].type == "struct" and got["b.py", "b.py"].type == "file" and got["b.py", "b.py"].content == "x = 1"
    assert ("l.py", "l.py") in got and got["f.rs", "run"].content.startswith("use std::io;\n\npub async fn run")


def test_pages_are_parsed_few_at_a_time(spark):
    # batches are short whatever the session had, and a batch that comes is taken in slices
    import pyarrow as pa

    from sagebrush.sources import web as W

    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(name, 10_000)
        pages = spark.range(600).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id, '</p>') AS html")
        assert {(r.page_id, r.text) for r in W.cleaned_pages(pages).collect()} == {(k, str(k)) for k in range(600)}
        assert int(spark.conf.get(name)) == W.ARROW_ROWS
        spark.conf.set(name, 100)
        W.short(pages)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
    rows = pa.RecordBatch.from_arrays([pa.array(range(70))], ["n"])
    assert [b.num_rows for b in W.small([rows])] == [32, 32, 6]


def test_order_texts_are_made_once_in_tasks_of_bounded_size(spark, monkeypatch):
    from sagebrush.operators import documents as D
    from sagebrush.plans import derived as O

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(O, "TASK_ROWS", 100)
    docs = O.order_texts(spark, sf)
    assert docs.rdd.getNumPartitions() == -(-n // 100)
    # section paths read the table once and shuffle it once
    plan = D.section_paths(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange ") == 1


def test_forms_are_looked_for_only_where_what_they_need_is(spark):
    from sagebrush.operators import errors as E

    said = ["error: Unable to RESOLVE module 'x'", "INVARIANT Violation: x", "native Module abc cannot be null", "could NOT connect to development server", "Could not determine the Dependencies of task 'x'", "BUILD failed", "signing Requires a development team", "all is well", None]
    got = {(r.id, r.code) for r in E.parsed(spark.createDataFrame(list(enumerate(said)), "id long, raw string"), "reactnative").collect()}
    assert got == set(enumerate("RN_MODULE_RESOLVE RN_INVARIANT RN_NATIVE_NULL RN_DEV_SERVER RN_GRADLE RN_XCODE RN_XCODE".split()))
    assert all(f.needs for f in E.LANGUAGES["reactnative"].extra)


def test_scores_do_not_hang_on_the_order_of_postings(spark, tmp_path, monkeypatch):
    """Postings read forwards and backwards give the same scores to the last bit, so that equal texts tie wherever they are."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS, k=30)), "go") for k in range(60)]
    index = Q.SparseIndex(spark, f"{tmp_path}/order").insert(spark.createDataFrame(rows, "id long, content string, collection string").coalesce(1))
    asked = spark.createDataFrame([(1, "go", " ".join(WORDS))], "query_id long, collection string, query string")
    monkeypatch.setattr(Q.S, "TIE", 15)
    read, got = index.tables.read, []
    for way in (F.asc, F.desc):
        path = f"{tmp_path}/{way.__name__}"
        read(index.POSTINGS).coalesce(1).sortWithinPartitions(way("term")).write.parquet(path)
        monkeypatch.setattr(index.tables, "read", lambda t, m=None, path=path: spark.read.parquet(path) if t == index.POSTINGS else read(t, m))
        got.append({r.id: r.score for r in index.search(asked, 100).collect()})
    assert len(got[0]) == 60 and got[0] == got[1]
