"""Queries of this engine by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ship
from .functions import cases as C
from .functions import tables as T
from .functions import text as X
from .operators import candidates as A
from .operators import chunks as B
from .operators import documents as D
from .operators import errors as E
from .operators import fixes as H
from .operators import graph as G
from .operators import ingest as L
from .operators import memory as M
from .operators import patterns as PT
from .operators import retrieval as Q
from .operators import search as S
from .operators import session as V
from .operators import similar as SP
from .operators import skeletons as N
from .operators import store as K
from .operators import structure as U
from .operators import vectors as Y
from .operators import versions as R
from .operators.cursors import SortedTable
from .plans import derived as O
from .plans import inline as I
from .sources import code as P
from .sources import web as W
from .sources.scratch import scratch, stamp, stored
from .sources.tables import table
from .streaming import memory as Z
from .streaming import sinks as J

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        @functools.wraps(f)
        def shipped(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[name or f.__name__] = shipped
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def any_word(column: str, words: list[str]) -> str:
    return " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words)


def case(column: str, rules, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_word(column, ws)} THEN '{n}'" for n, ws in rules) + f" ELSE {default} END"


# -- search ----------------------------------------------------------------------------------------------------------

QUERY = "that the thand ion and tion"
_TERMS = list(dict.fromkeys(QUERY.split()))
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: length(x) BETWEEN 2 AND 50)"
_BM25 = f"""
tk AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
st AS (SELECT count(*) AS n, CASE WHEN sum(len(t)) = 0 THEN 1.0 ELSE sum(len(t))::DOUBLE / count(*) END AS av FROM tk),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT doc_id, term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av)) AS tn FROM tf JOIN df USING (term), st),
qt AS (SELECT unnest({_TERMS}) AS term),
sp AS (SELECT doc_id AS id, round(sum(idf * tn * idf * (2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {len(QUERY.split())} / av)))), 9) AS score FROM wt JOIN qt USING (term), st GROUP BY doc_id)
"""
_DENSE = """
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
dn AS (SELECT vec_id AS id, label, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS score FROM embeddings, qv)
"""


def _all_in_one(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("all").alias("collection"))


def _one(spark, text: str, vector: list[float] | None = None) -> DataFrame:
    """One query of the collection of all documents."""
    return spark.createDataFrame([(1, "all", text, vector)], "query_id long, collection string, query string, vector array<double>")


_INDEXES: dict[tuple, Q.SparseIndex] = {}


def _index(spark, sf_dir, kind: str) -> Q.SparseIndex:
    """The stored sparse index of a table of documents as it is now (its size and time are looked at), made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = Q.SparseIndex(spark).insert(_all_in_one(spark, sf_dir) if kind == "all" else _indexed(spark, sf_dir))
    return _INDEXES[key]


def _vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"""WITH {_BM25}, {_DENSE},
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM dn QUALIFY r <= 60),
b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM sp WHERE score > 0 QUALIFY r <= 60),
u AS (SELECT id, r, 0 AS l FROM a UNION ALL SELECT id, r, 1 FROM b),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) / ((SELECT count(DISTINCT l) FROM u) / 61.0::DOUBLE) AS score, min(l * 1000 + r) AS p FROM u GROUP BY id)
SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, p LIMIT 20""")
def hybrid_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("collection"), "embedding")
    out = Q.hybrid_hits(_index(spark, sf_dir, "all"), vectors, _one(spark, QUERY, _vector(spark, sf_dir)), 20)
    return out.select("id", r6("score").alias("score"))


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term")
def bm25_vocab(spark, sf_dir):
    return S.vocabulary(table(spark, sf_dir, "documents"))


@query(f"WITH {_BM25} SELECT n AS n_docs, CAST((SELECT sum(len(t)) FROM tk) AS BIGINT) AS n_tokens, round(av, 6) AS avg_len FROM st")
def bm25_corpus_stats(spark, sf_dir):
    return S.corpus_stats(table(spark, sf_dir, "documents")).withColumn("avg_len", r6("avg_len"))


@query(f"WITH {_BM25} SELECT doc_id, term, round(idf * tn, 6) AS weight FROM wt")
def bm25_weights(spark, sf_dir):
    return S.weights(table(spark, sf_dir, "documents")).withColumn("weight", r6("weight"))


@query(f"WITH {_BM25} SELECT doc_id, term, round(idf * tn, 6) AS weight FROM wt")
def bm25_weights_all(spark, sf_dir):
    """The rows of bm25_weights, which had a cut at a weight of 9 for two rounds."""
    return S.weights(table(spark, sf_dir, "documents")).withColumn("weight", r6("weight"))


@query(f"WITH {_BM25} SELECT id AS doc_id, round(score, 6) AS score FROM sp WHERE score > 0 ORDER BY sp.score DESC, id LIMIT 20")
def bm25_search(spark, sf_dir):
    """The best 20 documents by the stored index; the first search of a session builds it."""
    return _index(spark, sf_dir, "all").search(_one(spark, QUERY), 20).select(F.col("id").alias("doc_id"), r6("score").alias("score"))


_GROWN = _BM25.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' that the tion' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0)", 1)


def _grown(spark, sf_dir):
    """An index made in five steps: documents in two parts, a tenth of them with longer texts, a ninth taken out, and segments merged."""
    docs = _all_in_one(spark, sf_dir)
    index = Q.SparseIndex(spark).insert(docs.where("id % 4 <> 0")).insert(docs.where("id % 4 = 0"))
    return index.replace(docs.where("id % 10 = 0").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" that the tion")))).delete(docs.where("id % 9 = 0"))


@query(f"WITH {_GROWN} SELECT id AS doc_id, round(score, 6) AS score, false AS merged FROM sp WHERE score > 0 UNION ALL SELECT id, round(score, 6), true FROM sp WHERE score > 0")
def sparse_index_grown(spark, sf_dir):
    """All scores after inserts, replacements and deletes, before and after segments are merged: those of an index made anew."""
    index, n = _grown(spark, sf_dir), 1 << 30
    before = stored(index.search(_one(spark, QUERY), n), "scores")
    index.compact(1)
    both = ((before, False), (index.search(_one(spark, QUERY), n), True))
    rows = [d.select(F.col("id").alias("doc_id"), r6("score").alias("score"), F.lit(k).alias("merged")) for d, k in both]
    return rows[0].union(rows[1])


@query(f"WITH {_GROWN} SELECT 'all' AS collection, n AS n_docs, CAST((SELECT sum(len(t)) FROM tk) AS BIGINT) AS n_tokens, round(av, 6) AS avg_len FROM st")
def sparse_index_stats(spark, sf_dir):
    return _grown(spark, sf_dir).stats().withColumn("avg_len", r6("avg_len"))


@query(f"WITH {_DENSE} SELECT id AS vec_id, round(score, 6) AS score FROM dn ORDER BY dn.score DESC, id LIMIT 20")
def dense_topk(spark, sf_dir):
    return S.dense_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20).withColumn("score", r6("score"))


@query("SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, true AS enough FROM embeddings")
def vector_index_recall(spark, sf_dir):
    """Recall at 10 of the index of cells and codes against exact search, for each fiftieth vector against all: whether it is 0.9 or more."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("collection"), "embedding")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "collection", F.col("embedding").cast("array<double>").alias("vector"))
    found = Y.VectorIndex.build(rows).search(asked, 10)
    return Y.recall(found, Y.exact_hits(rows, asked, 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS score FROM embeddings, q)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def vector_nearest(spark, sf_dir):
    """The ten nearest vectors of each fiftieth vector, exactly."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("collection"), "embedding")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "collection", F.col("embedding").cast("array<double>").alias("vector"))
    return Y.exact_hits(rows, asked, 10).select("query_id", "id", "rank", r6("score").alias("score"))


@query(f"WITH {_DENSE} SELECT id AS vec_id, round(score, 6) AS score FROM dn WHERE label = 1 ORDER BY dn.score DESC, id LIMIT 20")
def dense_topk_filtered(spark, sf_dir):
    return S.dense_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20, {"label": 1}).withColumn("score", r6("score"))


@query(f"WITH {_DENSE}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM dn QUALIFY r <= 20) SELECT id, round(1.0::DOUBLE / (60 + r) * 61, 6) AS score FROM a")
def rrf_single_list(spark, sf_dir):
    one = S.dense_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20).withColumnRenamed("vec_id", "id")
    return S.fused([one], 20).withColumn("score", r6("score"))


@query("SELECT vec_id, len(v) AS n, round(list_sum(v), 5) AS total FROM (SELECT vec_id, list_resize(embedding::DOUBLE[], 80, 0.0::DOUBLE) AS v FROM embeddings)")
def vector_resize(spark, sf_dir):
    v = X.resized(F.col("embedding"), 80)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda e: abs(e::DOUBLE))) AS m FROM embeddings)
SELECT vec_id, CAST(list_sum(list_transform(v, lambda e: CAST(round(e / m * 127) AS BIGINT))) AS BIGINT) AS checksum FROM x""")
def scalar_quantise(spark, sf_dir):
    m = F.array_max(F.transform("embedding", lambda e: F.abs(e.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", m.alias("m"))
    q = F.zip_with("embedding", F.array_repeat("m", F.size("embedding")), lambda e, m: F.round(e.cast("double") / m * 127).cast("long"))
    return rows.select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


_BOOST = " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{w}') THEN 1 ELSE 0 END" for w in QUERY.split() if len(w) > 2)
_N_BOOST = len([w for w in QUERY.split() if len(w) > 2])


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT doc_id AS id, 0.3::DOUBLE + ({_BOOST})::DOUBLE / {_N_BOOST} * 0.3::DOUBLE AS s FROM documents) WHERE s >= 0.5::DOUBLE")
def term_boost_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(0.3).alias("score"))
    return S.boosted(rows, QUERY).select("id", r6("score").alias("score"))


@query("""WITH s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE least(len(a.w), len(b.w)) >= 0.79::DOUBLE * greatest(len(a.w), len(b.w)) AND len(a.w) > 0 AND len(b.w) > 0)
SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS similarity FROM p WHERE i::DOUBLE / (na + nb - i) > 0.8::DOUBLE""")
def near_duplicate_pairs(spark, sf_dir):
    return SP.similar_pairs(table(spark, sf_dir, "documents"), 0.8, []).withColumn("similarity", r6("similarity"))


@query("""WITH s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE least(len(a.w), len(b.w)) >= 0.79::DOUBLE * greatest(len(a.w), len(b.w)) AND len(a.w) > 0 AND len(b.w) > 0)
SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS similarity FROM p WHERE i::DOUBLE / (na + nb - i) > 0.8::DOUBLE""")
def near_duplicate_pairs_all(spark, sf_dir):
    """The rows of near_duplicate_pairs, which looked within equal lang and source only for two rounds."""
    return SP.similar_pairs(table(spark, sf_dir, "documents"), 0.8, []).withColumn("similarity", r6("similarity"))


@query()
def greedy_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = S.sparse_search(docs, QUERY.split(), 20).withColumn("pos", F.row_number().over(__import__("pyspark").sql.Window.orderBy(F.desc("score"), "doc_id")))
    rows = hits.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").select(F.lit(1).alias("query_id"), "pos", "score", F.col("doc_id").alias("id"), "content")
    return S.deduped(rows).select("slot", "id", r6("score").alias("score"))


@query(f"WITH {_DENSE}, t AS (SELECT score FROM dn ORDER BY score DESC, id LIMIT 20) SELECT count(*) FILTER (score > 0.6) AS strong, count(*) FILTER (score > 0.6) < 3 AS weak FROM t")
def weak_result_gate(spark, sf_dir):
    top = S.dense_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20)
    return top.agg(F.count_if(F.col("score") > 0.6).alias("strong")).withColumn("weak", F.col("strong") < 3)


# -- planning --------------------------------------------------------------------------------------------------------


def _duck(p: str) -> str:
    return p.replace("'", "''")


_CLASS = "CASE " + " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"regexp_matches(query, '{_duck(p)}')" for p in ps), n) for n, ps in T.QUERY_CLASSES) + " ELSE 'general' END"


@query(f"SELECT id, {_CLASS} AS type FROM {I.QUERIES.sql()}")
def query_classification(spark, sf_dir):
    return I.QUERIES.df(spark).select("id", X.query_class(F.col("query")).alias("type"))


@query(f"SELECT conv_id, turn, {_CLASS.replace('query', 'text')} AS type FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def conversation_classes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", X.query_class(F.col("text")).alias("type"))


_EXACT = "CASE lower(trim(label)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TECH_LABELS.items()) + " END"
_PART = "CASE " + " ".join(f"WHEN contains(lower(trim(label)), '{k}') OR contains('{k}', lower(trim(label))) THEN '{v}'" for k, v in T.TECH_LABELS.items()) + " END"
_TECH = f"CASE WHEN coalesce(label, '') = '' THEN {case('lower(query)', T.TECH)} ELSE coalesce({_EXACT}, {_PART}, {case('lower(query)', T.TECH)}) END"


@query(f"SELECT id, {_TECH} AS tech FROM {I.QUERIES.sql()}")
def detect_tech(spark, sf_dir):
    return I.QUERIES.df(spark).select("id", X.tech_of(F.col("query"), F.col("label")).alias("tech"))


@query(f"""WITH q AS (SELECT id, {_CLASS} AS k, {_TECH} AS t FROM {I.QUERIES.sql()})
SELECT id, array_to_string(CASE WHEN k = 'error' THEN CASE WHEN t IS NULL THEN ['fix_recipes', 'general'] ELSE ['fix_recipes', t, 'general'] END
  WHEN t IS NULL THEN {T.CONTENT} WHEN k IN ('scope', 'code_examples', 'structural') THEN list_concat([t], list_filter({T.CONTENT}, lambda x: x <> t)) ELSE [t, 'general'] END, ',') AS collections FROM q""")
def query_routing(spark, sf_dir):
    q = I.QUERIES.df(spark)
    return q.select("id", F.array_join(X.collections_for(X.query_class(F.col("query")), X.tech_of(F.col("query"), F.col("label"))), ",").alias("collections"))


@query(f"SELECT id, trim(regexp_extract(query, '{_duck(T.BOOK_HINT)}', 1)) AS book FROM {I.QUERIES.sql()}")
def book_hint(spark, sf_dir):
    return I.QUERIES.df(spark).select("id", F.trim(F.regexp_extract("query", T.BOOK_HINT, 1)).alias("book"))


_EXT = r"lower(regexp_extract(path, '[^/\\.][^/\\]*(\.[^./\\]*)$', 1))"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " END"
_LANG_ROUTE = f"CASE {_LANG} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_ROUTES.items()) + " ELSE 'general' END"


@query(f"SELECT id, {_LANG} AS language, {case('lower(path)', T.FRAMEWORKS)} AS framework, {case('lower(path)', T.ROUTES, _LANG_ROUTE)} AS collection FROM {I.PATHS.sql()}")
def language_framework(spark, sf_dir):
    p = F.col("path")
    return I.PATHS.df(spark).select("id", X.language_of(p).alias("language"), X.framework_of(p).alias("framework"), X.collection_of(p, X.language_of(p)).alias("collection"))


@query(f"""SELECT id, CASE WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} IN ('.html', '.htm') THEN 'html' WHEN {_EXT} IN ('.md', '.mdx') THEN 'markdown' WHEN {_EXT} IN ('.txt', '.rst') THEN 'text'
WHEN {_EXT} IN ({", ".join(f"'{k}'" for k in T.CODE_FILES)}) THEN 'code' WHEN starts_with(content, '<!DOCTYPE') OR starts_with(content, '<html') THEN 'html'
WHEN regexp_matches(content, '^#{{1,3}}\\s') THEN 'markdown' ELSE 'text' END AS format FROM {I.PATHS.sql()}""")
def format_detection(spark, sf_dir):
    return I.PATHS.df(spark).select("id", X.format_of(F.col("path"), F.col("content")).alias("format"))


# -- documents -------------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-zA-Z0-9_]*') AS w FROM documents))),
c AS (SELECT doc_id, w AS word, count(*) AS n, min(i) AS f FROM w WHERE length(w) > 2 AND w NOT IN ({", ".join(f"'{s}'" for s in sorted(set(T.STOP_WORDS)))}) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank, word, n FROM c QUALIFY rank <= 10""")
def keywords_top10(spark, sf_dir):
    return D.keywords(table(spark, sf_dir, "documents"))


_DOC_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(substr(text, 1, 500), '{_duck(p)}') THEN '{n}'" for n, p in T.DOC_TYPES) + " ELSE 'reference' END"
_FENCES = "floor((length(text) - length(replace(text, '```', ''))) / 6.0::DOUBLE)"


@query(f"""WITH x AS (SELECT doc_id, text, least({_FENCES} * 10 / len(string_split(text, chr(10))), 1.0) AS s FROM {I.MARKDOWN.sql()})
SELECT doc_id, CASE WHEN s > 0.5 THEN 'code' WHEN s > 0.1 THEN 'mixed' ELSE 'prose' END AS content_type, {_DOC_TYPE} AS doc_type FROM x""")
def content_and_doc_type(spark, sf_dir):
    return I.MARKDOWN.df(spark).select("doc_id", X.content_type(F.col("text")).alias("content_type"), X.doc_type(F.col("text")).alias("doc_type"))


@query(f"SELECT doc_id, {_DOC_TYPE} AS doc_type FROM documents WHERE text IS NOT NULL")
def document_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.doc_type(F.col("text")).alias("doc_type"))


_MARKS = r"[{}()\[\];:,.<>=+\-*/&|!@#$%^~`]"


@query(f"""WITH x AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w, length(text) - length(regexp_replace(text, '{_MARKS}', '', 'g')) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(CASE WHEN p > w * 0.3::DOUBLE THEN ceil(ceil(w / 0.75::DOUBLE) * 1.3::DOUBLE) ELSE ceil(w / 0.75::DOUBLE) END AS BIGINT) AS tokens FROM x""")
def chunk_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.chunk_tokens(F.col("text")).cast("long").alias("tokens"))


_MSG_MARKS = r"[{}()\[\]:;=<>!&|+\-*/\\@#$%^~`]"


def _msg_tokens(c: str) -> str:
    n = f"length({c})"
    marks = f"({n} - length(regexp_replace({c}, '{_MSG_MARKS}', '', 'g')))::DOUBLE / {n}"
    return f"CAST(CASE WHEN {n} = 0 THEN 0 ELSE ceil({n} / CASE WHEN {marks} > 0.08::DOUBLE THEN 3.0::DOUBLE ELSE 3.8::DOUBLE END) END AS BIGINT)"


@query(f"SELECT conv_id, turn, {_msg_tokens('text')} AS tokens FROM conversations WHERE text IS NOT NULL")
def session_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", X.message_tokens(F.col("text")).cast("long").alias("tokens"))


_LINES = f"""
l AS (SELECT doc_id, title AS doc_title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM {I.MARKDOWN.sql()}),
f AS (SELECT *, starts_with(trim(line), '```') OR coalesce(sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM l),
t AS (SELECT doc_id, pos, length(regexp_extract(trim(line), '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(trim(line), '^#{{1,6}}\\s+(.+)$', 1)) AS title FROM f WHERE NOT fenced AND regexp_matches(trim(line), '^#{{1,6}}\\s+.+$'))
"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, level, title FROM t")
def toc_from_headings(spark, sf_dir):
    return D.contents(I.MARKDOWN.df(spark))


@query(f"""WITH {_LINES}, c AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM t)
SELECT doc_id, CAST(no AS BIGINT) AS chapter_no, arg_min(title, pos) AS chapter, count(*) - 1 AS n_sections, coalesce(string_agg(title, ' | ' ORDER BY pos) FILTER (level > 1), '') AS sections FROM c WHERE no > 0 GROUP BY doc_id, no""")
def chapter_map(spark, sf_dir):
    return D.chapters(D.contents(I.MARKDOWN.df(spark)))


_OPEN = ", ".join(f"(SELECT h.title FROM t h WHERE h.doc_id = f.doc_id AND h.level = {k} AND h.pos <= f.pos AND NOT EXISTS (SELECT 1 FROM t o WHERE o.doc_id = f.doc_id AND o.level < {k} AND o.pos > h.pos AND o.pos <= f.pos) ORDER BY h.pos DESC LIMIT 1)" for k in range(1, 7))


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, concat_ws(' > ', doc_title, {_OPEN}) AS section_path FROM f WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.doc_id = f.doc_id AND x.pos = f.pos)")
def section_paths(spark, sf_dir):
    return D.section_paths(I.MARKDOWN.df(spark))


# the same over the texts of all orders
_ORDERS = _LINES.replace(I.MARKDOWN.sql(), O.ORDER_TEXTS)


@query(f"WITH {_ORDERS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, level, title FROM t")
def order_contents(spark, sf_dir):
    return D.contents(O.order_texts(spark, sf_dir))


@query(f"""WITH {_ORDERS}, c AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM t)
SELECT doc_id, CAST(no AS BIGINT) AS chapter_no, arg_min(title, pos) AS chapter, count(*) - 1 AS n_sections, coalesce(string_agg(title, ' | ' ORDER BY pos) FILTER (level > 1), '') AS sections FROM c WHERE no > 0 GROUP BY doc_id, no""")
def order_chapters(spark, sf_dir):
    return D.chapters(D.contents(O.order_texts(spark, sf_dir)))


_AT = ", ".join(f"max(pos) FILTER (level = {k}) OVER w AS a{k}, arg_max(heading, pos) FILTER (level = {k}) OVER w AS h{k}" for k in (1, 2, 3))


@query(f"""WITH {_ORDERS}, x AS (SELECT f.doc_id, f.doc_title, f.pos, t.level, t.title AS heading FROM f LEFT JOIN t ON t.doc_id = f.doc_id AND t.pos = f.pos),
o AS (SELECT *, {_AT} FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, concat_ws(' > ', doc_title, h1, CASE WHEN a2 > coalesce(a1, -1) THEN h2 END, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN h3 END) AS section_path FROM o WHERE level IS NULL""")
def order_section_paths(spark, sf_dir):
    return D.section_paths(O.order_texts(spark, sf_dir))


@query(f"""WITH {_ORDERS}, c AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM t),
g AS (SELECT doc_id, CAST(no AS BIGINT) AS nth, arg_min(title, pos) AS chapter, count(*) - 1 AS n, string_agg(repeat('  ', level - 2) || '- ' || title, chr(10) ORDER BY pos) FILTER (level > 1) AS s FROM c WHERE no > 0 GROUP BY doc_id, no),
o AS (SELECT doc_id, count(*) AS k, string_agg(nth || '. ' || chapter || CASE n WHEN 0 THEN '' WHEN 1 THEN ' — 1 section' ELSE ' — ' || n || ' sections' END, chr(10) ORDER BY nth) AS l FROM g GROUP BY doc_id)
SELECT doc_id, 0::BIGINT AS nth, 'overview' AS kind, md5('Document: ' || title || chr(10) || 'This document contains ' || k || CASE k WHEN 1 THEN ' chapter:' ELSE ' chapters:' END || chr(10) || chr(10) || l) AS digest FROM o JOIN {O.ORDER_TEXTS} USING (doc_id)
UNION ALL SELECT doc_id, nth, 'chapter', md5('Chapter: ' || chapter || CASE WHEN n > 0 THEN chr(10) || chr(10) || 'Sections:' || chr(10) || s ELSE '' END) FROM g""")
def order_structure(spark, sf_dir):
    docs = O.order_texts(spark, sf_dir)
    return U.structural_chunks(D.contents(docs), docs).select("doc_id", "nth", "kind", F.md5("content").alias("digest"))


@query(f"""WITH b AS {I.BOOKMARKS.sql()}, h AS {I.TOC.sql()}, u AS (SELECT 0 AS part, * FROM b UNION ALL SELECT 1, * FROM h WHERE lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM b))
SELECT row_number() OVER (ORDER BY part, pos) AS nth, level, title FROM u""")
def merge_toc(spark, sf_dir):
    return D.merged_contents(I.BOOKMARKS.df(spark), I.TOC.df(spark))


@query()
def chunk_documents(spark, sf_dir):
    return D.chunked(table(spark, sf_dir, "documents"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))


_CODE_EXT = r"coalesce(CASE lower(regexp_extract(path, '[^/\\.][^/\\]*(\.[^./\\]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CODE_LANGUAGES.items()) + " END, 'javascript')"
_BY_CODE = lambda f: "CASE language " + " ".join(f"WHEN '{k}' THEN {f(ps)}" for k, ps in T.DEFINITIONS.items()) + " END"
_ANY = lambda ps: D._any_of(ps).replace("'", "''")


@query(f"""WITH x AS (SELECT path, coalesce(content, '') AS content, {_CODE_EXT} AS language FROM {I.CODE_FILES.sql()}),
l AS (SELECT *, string_split(content, chr(10)) AS lines FROM x),
k AS (SELECT *, array_to_string(list_transform(lines, lambda y: CASE WHEN regexp_matches(trim(y), '{T.IMPORT_LINE}') THEN 'i' WHEN trim(y) = '' THEN 'b' ELSE 'o' END), '') AS kinds FROM l),
h AS (SELECT *, coalesce(array_to_string(list_filter(lines[greatest(instr(kinds, 'i'), 1):greatest(instr(kinds, 'i'), 1) + length(regexp_extract(kinds, 'i[ib]*')) - 1], lambda y: regexp_matches(trim(y), '{T.IMPORT_LINE}')), chr(10)), '') AS header FROM k),
m AS (SELECT path, language, header, content, string_split({_BY_CODE(lambda ps: f"regexp_replace(content, '(?m)^(?:{_ANY(ps)})', chr(1) || '\\0', 'g')")}, chr(1)) AS pieces FROM h),
p AS (SELECT path, language, header, generate_subscripts(pieces[2:], 1) - 1 AS nth, unnest(pieces[2:]) AS piece FROM m),
t AS (SELECT *, {_BY_CODE(lambda ps: f"regexp_extract(piece, '^(?:{_ANY(ps)})')")} AS head FROM p)
SELECT path, CAST(nth AS BIGINT) AS nth, {_BY_CODE(lambda ps: "coalesce(" + ", ".join("nullif(regexp_extract(piece, '^{}', 1), '')".format(q.replace("'", "''")) for q in ps) + ")")} AS name,
  CASE WHEN contains(head, 'class') THEN 'class' WHEN contains(head, 'struct') THEN 'struct' ELSE 'function' END AS type, CASE WHEN header <> '' THEN header || chr(10) || chr(10) ELSE '' END || regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS content FROM t
UNION ALL SELECT path, 0, regexp_extract(path, '([^/]*)$', 1), 'file', content FROM m WHERE len(pieces) < 2""")
def split_code(spark, sf_dir):
    return D.split_code(I.CODE_FILES.df(spark))


@query(f"""WITH x AS (SELECT 'x' || path AS id, path, coalesce(content, '') AS content, content IS NULL AS gone FROM {I.DOC_FILES.sql()})
SELECT path, CASE WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} IN ('.html', '.htm') THEN 'html' WHEN {_EXT} IN ('.md', '.mdx') THEN 'markdown' WHEN {_EXT} IN ('.txt', '.rst') THEN 'text' ELSE 'code' END AS format,
  CASE WHEN gone OR {_EXT} = '.pdf' THEN NULL ELSE {case('lower(path)', T.ROUTES, _LANG_ROUTE)} END AS collection, NOT gone AND {_EXT} <> '.pdf' AS indexed, CASE WHEN gone THEN 'no content' WHEN {_EXT} = '.pdf' THEN 'no reader for pdf' END AS error FROM x""")
def ingest_outcomes(spark, sf_dir):
    rows = L.detected(I.DOC_FILES.df(spark))
    return L.outcome(rows, L.chunks(rows, 64, 8)).drop("chunks_stored")


@query()
def ingest_chunks(spark, sf_dir):
    return L.chunks(L.detected(I.DOC_FILES.df(spark)), 64, 8)


@query()
def ingest_pages(spark, sf_dir):
    """Every page as a file: how many chunks it gives."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    rows = L.detected(pages)
    return L.outcome(rows, L.chunks(rows))


@query()
def sanitize_headings(spark, sf_dir):
    rows = spark.createDataFrame([(1, "**Databas e Design**"), (2, "# `ﬁle` oﬃce"), (3, "re que s t handling"), (4, None)], "id long, line string")
    return rows.select("id", D.clean_headings(F.col("line")).alias("heading"))


@query()
def classify_headings(spark, sf_dir):
    return I.HEADINGS.df(spark).select("id", X.heading_class(F.col("line")).alias("c")).select("id", "c.is_heading", F.round("c.confidence", 2).alias("confidence"), "c.reason")


_CHUNKS = "c AS (SELECT doc_id AS id, coalesce(text, '') AS content, CASE lang WHEN 'en' THEN 'general' WHEN 'de' THEN 'python' WHEN 'fr' THEN 'nodejs' WHEN 'es' THEN 'go' ELSE lang END AS collection, 'Book ' || source AS doc_title, source AS book_id, lang AS chapter, 'Root > ' || source || ' > ' || lang AS section_path, CAST(doc_id AS BIGINT) AS chunk_index FROM documents)"


def _chunks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = F.create_map(*[F.lit(x) for kv in {"en": "general", "de": "python", "fr": "nodejs", "es": "go"}.items() for x in kv])
    return d.select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce(names[F.col("lang")], "lang").alias("collection"), F.concat(F.lit("Book "), "source").alias("doc_title"),
        F.col("source").alias("book_id"), F.col("lang").alias("chapter"), F.concat(F.lit("Root > "), "source", F.lit(" > "), "lang").alias("section_path"), F.col("doc_id").alias("chunk_index"),
    )


@query(f"""WITH {_CHUNKS}, p AS (SELECT *, list_extract(regexp_split_to_array(trim(coalesce(lag(content) OVER (PARTITION BY book_id ORDER BY chunk_index), '')), '[.!?]\\s+'), -1) AS s FROM c)
SELECT id, md5('[' || doc_title || ' > ' || section_path || CASE WHEN length(s) > 20 AND length(s) < 200 THEN ' (continues from: ' || s || ')' ELSE '' END || ']' || chr(10) || chr(10) || content) AS digest FROM p""")
def enrich_fast(spark, sf_dir):
    rows = D.enriched(_chunks(spark, sf_dir))
    return rows.select(F.col("chunk_index").alias("id"), F.md5("enriched").alias("digest"))


_SUM = "substr(string_agg(substr(content, 1, 8000), chr(10) || chr(10) ORDER BY id), 1, 8000)"


@query(f"""WITH {_CHUNKS}, s AS (SELECT 'section' AS kind, section_path AS path, count(*) AS n, {_SUM} AS t FROM c GROUP BY section_path HAVING count(*) >= 3 UNION ALL SELECT 'chapter', 'Root > ' || book_id, count(*), {_SUM} FROM c GROUP BY book_id HAVING count(*) >= 5),
w AS (SELECT *, regexp_split_to_array(trim(t), '\\s+') AS w FROM s) SELECT kind, path, n, md5(CASE WHEN len(w) > 200 THEN array_to_string(w[1:200], ' ') || '...' ELSE array_to_string(w, ' ') END) AS digest FROM w WHERE path IS NOT NULL""")
def section_chapter_summaries(spark, sf_dir):
    return K.group_summaries(_chunks(spark, sf_dir)).select("kind", F.col("group_path").alias("path"), "n", F.md5("summary").alias("digest"))


@query()
def clean_html(spark, sf_dir):
    return W.cleaned_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "title", "text")


@query()
def html_code_blocks(spark, sf_dir):
    return W.cleaned_pages(table(spark, sf_dir, "pages"), 12000).select("page_id", F.size("code_blocks").cast("long").alias("n"))


@query()
def url_documents(spark, sf_dir):
    return W.page_document(W.cleaned_pages(table(spark, sf_dir, "pages"), 12000))


@query()
def normalised_headings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.over(F.col("text"), U.marked_headings).alias("text"))


@query()
def cleaned_documents(spark, sf_dir):
    return I.MARKDOWN.df(spark).select("doc_id", U.over(F.col("text"), U.clean_document).alias("text"))


@query()
def text_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.text_title(F.col("text")).alias("title"), U.over(F.col("text"), U.text_markdown).alias("text"))


@query(f"""WITH {_LINES}, c AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM t),
g AS (SELECT doc_id, CAST(no AS BIGINT) AS nth, arg_min(title, pos) AS chapter, count(*) - 1 AS n, string_agg(repeat('  ', level - 2) || '- ' || title, chr(10) ORDER BY pos) FILTER (level > 1) AS s FROM c WHERE no > 0 GROUP BY doc_id, no),
o AS (SELECT doc_id, count(*) AS k, string_agg(nth || '. ' || chapter || CASE n WHEN 0 THEN '' WHEN 1 THEN ' — 1 section' ELSE ' — ' || n || ' sections' END, chr(10) ORDER BY nth) AS l FROM g GROUP BY doc_id)
SELECT doc_id, 0::BIGINT AS nth, 'overview' AS kind, '' AS chapter, 'Document: ' || title || chr(10) || 'This document contains ' || k || CASE k WHEN 1 THEN ' chapter:' ELSE ' chapters:' END || chr(10) || chr(10) || l AS content FROM o JOIN {I.MARKDOWN.sql()} USING (doc_id)
UNION ALL SELECT doc_id, nth, 'chapter', chapter, 'Chapter: ' || chapter || CASE WHEN n > 0 THEN chr(10) || chr(10) || 'Sections:' || chr(10) || s ELSE '' END FROM g""")
def structural_chunks(spark, sf_dir):
    docs = I.MARKDOWN.df(spark)
    return U.structural_chunks(D.contents(docs), docs)


@query()
def enclosing_functions(spark, sf_dir):
    places = I.FAULTS.df(spark)
    languages = places.select("file", "language").distinct()
    return U.enclosing_functions(places.join(I.TEXTS.df(spark).select("file"), "file", "left_semi"), I.TEXTS.df(spark).join(languages, "file"))


# -- store and scopes ------------------------------------------------------------------------------------------------


@query(f"WITH {_CHUNKS} SELECT id, collection FROM c WHERE book_id = 'src3' AND collection = 'general' ORDER BY chunk_index, id LIMIT 200")
def scroll_keyword(spark, sf_dir):
    return K.scroll(_chunks(spark, sf_dir), [{"key": "book_id", "value": "src3"}, {"key": "collection", "value": "general"}], 200, "chunk_index").select("id", "collection")


@query(f"WITH {_CHUNKS} SELECT id, book_id FROM c WHERE list_contains(regexp_split_to_array(lower(content), '[^a-z0-9]+'), 'that') AND list_contains(regexp_split_to_array(lower(content), '[^a-z0-9]+'), 'tion') ORDER BY id LIMIT 200")
def text_match(spark, sf_dir):
    return K.scroll(_chunks(spark, sf_dir), [{"key": "content", "text": "That, tion"}]).select("id", "book_id")


@query(f"WITH {_CHUNKS} SELECT collection, count(*) AS n FROM c WHERE NOT (book_id = 'src3') GROUP BY collection")
def delete_or_filter(spark, sf_dir):
    return K.deleted(_chunks(spark, sf_dir), "src3").groupBy("collection").agg(F.count("*").alias("n"))


@query(f"WITH {_CHUNKS}, n AS (SELECT unnest({T.COLLECTIONS}) AS collection) SELECT coalesce(n.collection, k.collection) AS collection, coalesce(k.n, 0) AS n FROM n FULL JOIN (SELECT collection, count(*) AS n FROM c GROUP BY collection) k ON k.collection = n.collection")
def collection_stats(spark, sf_dir):
    return K.collection_stats(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT doc_title, arg_min(book_id, id) AS book_id, array_to_string(list_sort(list_distinct(list(collection))), ',') AS collections, count(*) AS n FROM c GROUP BY doc_title")
def sources(spark, sf_dir):
    return K.sources(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT doc_title, arg_min(book_id, id) AS book_id, min(id) AS first_id FROM c GROUP BY doc_title")
def books(spark, sf_dir):
    return K.books(_chunks(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY coalesce(n_chars, 0), doc_id) - 1 AS place, (count(*) OVER () + 7) // 8 AS size FROM documents)
SELECT CAST(place // size AS INTEGER) AS page, doc_id, place FROM r""")
def document_pages(spark, sf_dir):
    """All documents by length, walked in eight pages by the token of the page before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0).cast("long")).alias("n"))
    walk, size, out, token = SortedTable(spark, scratch(spark, "pages")), -(-rows.count() // 8) or 1, [], None
    walk.write(rows, "n", "doc_id")
    for page in range(8):
        got, token = walk.page(size, token)
        out.append(got.select(F.lit(page).alias("page"), "doc_id", F.col("_place").alias("place")))
        if token is None:
            break
    return functools.reduce(DataFrame.union, out)


_CHANGED = f"""{_CHUNKS}, n AS (SELECT id, content || ' (new)' AS content, 'rust' AS collection FROM c WHERE id % 3 = 0),
u AS (SELECT id, content, collection FROM c WHERE id % 3 <> 0 UNION ALL SELECT * FROM n)"""


@query(f"""WITH {_CHANGED} SELECT 1 AS version, id, collection, md5(content) AS digest FROM c
UNION ALL SELECT 4, id, collection, md5(content) FROM u WHERE id % 7 <> 0 AND (collection IS NULL OR collection <> 'go')
UNION ALL SELECT 5, id, collection, md5(content) FROM u WHERE id % 7 <> 0 AND (collection IS NULL OR collection <> 'go')""")
def snapshot_chunks(spark, sf_dir):
    """A store after replacing a third of its chunks, deleting a seventh, dropping a collection and compacting; and as it was at first."""
    chunks = _chunks(spark, sf_dir).select("id", "content", "collection", "doc_title", "book_id")
    store = B.ChunkStore(spark, scratch(spark, "store"), "id")
    store.add(chunks)
    store.replace(chunks.where("id % 3 = 0").withColumn("content", F.concat("content", F.lit(" (new)"))).withColumn("collection", F.lit("rust")))
    store.delete(chunks.where("id % 7 = 0"))
    store.drop("go")
    store.rewrite()
    at = lambda v: store.read(v).select(F.lit(v).alias("version"), "id", "collection", F.md5("content").alias("digest"))
    return at(1).union(at(4)).union(at(5))


_SCOPE = f"{_BM25}, {_CHUNKS}, h AS (SELECT id, score FROM sp WHERE score > 0 ORDER BY score DESC, id LIMIT 50), sc AS (SELECT chapter, book_id, sum(score) AS s, min(c.id) AS f FROM h JOIN c ON c.id = h.id GROUP BY ALL ORDER BY s DESC, f LIMIT 1)"


@query(f"WITH {_SCOPE} SELECT chapter, book_id, round(s, 6) AS section_score FROM sc")
def scope_discovery(spark, sf_dir):
    hits = S.sparse_search(table(spark, sf_dir, "documents"), QUERY.split(), 50).withColumnRenamed("doc_id", "id")
    return K.scope(_chunks(spark, sf_dir), hits).select("chapter", "book_id", r6("section_score").alias("section_score"))


@query(f"WITH {_SCOPE}, r AS (SELECT id, row_number() OVER (ORDER BY chunk_index, id) AS nth FROM c JOIN sc USING (chapter, book_id) QUALIFY nth <= 25) SELECT id, round(1 - (nth - 1) * 0.001::DOUBLE, 6) AS score FROM r")
def scope_retrieve(spark, sf_dir):
    hits = S.sparse_search(table(spark, sf_dir, "documents"), QUERY.split(), 50).withColumnRenamed("doc_id", "id")
    chunks = _chunks(spark, sf_dir)
    return K.scope_rows(chunks, K.scope(chunks, hits)).select("id", r6("score").alias("score"))


def _found(spark, sf_dir) -> DataFrame:
    """The first 200 chunks of a chapter, as a scan of a scope gives them; each seventh stands for a summary."""
    rows = _chunks(spark, sf_dir).where("chapter = 'en'").orderBy("chunk_index", "id").limit(200)
    kind = F.when(F.col("id") % 7 == 0, "summary").otherwise("content")
    return rows.withColumns({"pos": F.row_number().over(Window.orderBy("chunk_index", "id")), "chunk_type": kind, "section_path": F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))})


_BOOKS = "SELECT doc_title, count(*) AS n, min(pos) AS first FROM f GROUP BY doc_title"


@query(f"""WITH {_CHUNKS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY chunk_index, id) AS pos FROM c WHERE chapter = 'en') WHERE pos <= 200), bk AS ({_BOOKS} ORDER BY n DESC, first LIMIT 1),
o AS (SELECT id, content, 'S' || (id % 50) AS path, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS part, row_number() OVER (PARTITION BY id % 7 = 0 ORDER BY chunk_index, pos) AS k, count(*) FILTER (id % 7 <> 0) OVER () AS n FROM f JOIN bk USING (doc_title)),
d AS (SELECT * FROM o WHERE part = 0 AND k <= 5), m AS (SELECT * FROM o WHERE part = 1 AND n > 5 AND path NOT IN (SELECT path FROM d)), u AS (SELECT * FROM d UNION ALL SELECT * FROM m), r AS (SELECT id, row_number() OVER (ORDER BY part, k) AS nth FROM u)
SELECT nth, id, round(1 - (nth - 1) * 0.001::DOUBLE, 6) AS score FROM r""")
def scope_result(spark, sf_dir):
    return K.scope_result(_found(spark, sf_dir), 5).select("nth", "id", r6("score").alias("score"))


@query(f"""WITH {_CHUNKS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY chunk_index, id) AS pos FROM c WHERE chapter = 'en') WHERE pos <= 200), b AS ({_BOOKS})
SELECT row_number() OVER (ORDER BY n DESC, first) - 1 AS nth, doc_title, n FROM b QUALIFY nth > 0""")
def scope_other_books(spark, sf_dir):
    return K.other_books(_found(spark, sf_dir))


@query()
def code_examples(spark, sf_dir):
    chunks = D.chunked(I.MARKDOWN.df(spark), F.col("title"), 16, 4)
    rows = chunks.select(F.concat_ws("/", "doc_id", "chunk_index").alias("id"), F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("doc_title"), "section_path", "chunk_index", "content")
    return K.code_examples(rows.withColumn("pos", F.row_number().over(Window.orderBy("id"))))


@query()
def context_assembly(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = S.sparse_search(docs, QUERY.split(), 20)
    top = docs.join(F.broadcast(hits), "doc_id")  # 20 rows
    pos = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    rows = top.select(F.lit(1).alias("query_id"), pos.alias("pos"), F.col("doc_id").alias("id"), "score", F.col("text").alias("content"), F.concat(F.lit("Book "), "source").alias("doc_title"), F.col("lang").alias("section"), F.lit("content").alias("chunk_type"))
    return S.assembled(rows, QUERY, 0.2)


@query(f"""WITH x AS (SELECT id, list_filter(list_transform(string_split(response, chr(10)), lambda l: trim(regexp_replace(l, '^\\d+[.)]\\s*', ''))), lambda l: length(l) > 10 AND length(l) < 200)[1:3] AS l FROM {I.ANSWERS.sql()})
SELECT id, array_to_string(list_concat(['how to sort'], l), '|') AS queries FROM x""")
def query_expansion(spark, sf_dir):
    return I.ANSWERS.df(spark).select("id", F.array_join(S.expansions(F.lit("how to sort"), F.col("response")), "|").alias("queries"))


# -- retrieval for many queries at once ------------------------------------------------------------------------------


def _asked(spark, sf_dir) -> DataFrame:
    """Test items stand for queries; the vector of the same number is a query's own."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("label"))
    return q.join(v, "query_id", "left")


def _vectors(spark, sf_dir, chunks: DataFrame) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.join(chunks.select("id", "collection"), "id")


def _indexed(spark, sf_dir) -> DataFrame:
    """Chunks whose kind is structural, a summary or a detail, by their number."""
    kind = F.when(F.col("id") % 5 == 0, "structural").when(F.col("id") % 7 == 0, "summary").otherwise("detail")
    return _chunks(spark, sf_dir).withColumn("chunk_type", kind)


_MANY = f"""{_CHUNKS}, tk AS (SELECT id, collection, {_TOKENS.format("content")} AS t FROM c),
st AS (SELECT collection, count(*) AS n, CASE WHEN sum(len(t)) = 0 THEN 1.0 ELSE sum(len(t))::DOUBLE / count(*) END AS av FROM tk GROUP BY collection),
tf AS (SELECT id, collection, term, len, count(*) AS tf FROM (SELECT id, collection, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL),
wt AS (SELECT id, tf.collection, term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av)) AS tn FROM tf JOIN df USING (collection, term) JOIN st ON st.collection = tf.collection),
qu AS (SELECT item_id AS query_id, text AS query, CAST(NULL AS VARCHAR) AS label FROM benchmark),
kq AS (SELECT query_id, query, {_CLASS} AS k, {_TECH} AS t FROM qu),
lq AS (SELECT query_id, query, k, CASE WHEN k = 'error' THEN CASE WHEN t IS NULL THEN ['fix_recipes', 'general'] ELSE ['fix_recipes', t, 'general'] END
  WHEN t IS NULL THEN {T.CONTENT} WHEN k IN ('scope', 'code_examples', 'structural') THEN list_concat([t], list_filter({T.CONTENT}, lambda x: x <> t)) ELSE [t, 'general'] END AS cs FROM kq),
aq AS (SELECT query_id, query, k, unnest(cs) AS collection, generate_subscripts(cs, 1) AS place FROM lq),
qt AS (SELECT query_id, collection, k, len, term, count(*) AS tf FROM (SELECT query_id, collection, k, len(t) AS len, unnest(t) AS term FROM (SELECT query_id, collection, k, {_TOKENS.format("query")} AS t FROM aq)) GROUP BY ALL),
sp AS (SELECT query_id, wt.collection, id, round(sum(idf * tn * idf * (qt.tf * 2.2::DOUBLE / (qt.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * qt.len / av)))), 9) AS score
  FROM qt JOIN wt ON wt.term = qt.term AND wt.collection = qt.collection JOIN st ON st.collection = qt.collection WHERE qt.k <> 'structural' OR id % 5 = 0 GROUP BY ALL)"""


@query(f"""WITH {_MANY} SELECT query_id, collection, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS r FROM sp WHERE score > 0) WHERE r <= 20""")
def sparse_index_search(spark, sf_dir):
    """The best 20 chunks of every collection for every test item, by the stored index."""
    chunks = _indexed(spark, sf_dir)
    asked = Q.routed(_asked(spark, sf_dir)).withColumn("only", F.col("kind") == "structural")
    out = _index(spark, sf_dir, "chunks").search(asked, 20, chunks.select("id", (F.col("chunk_type") == "structural").alias("only")))
    return out.select("query_id", "collection", "id", r6("score").alias("score"))


_FOUND = f"""{_MANY}, nv AS (SELECT e.vec_id, c.collection, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN c ON c.id = e.vec_id),
dn AS (SELECT aq.query_id, nv.collection, nv.vec_id AS id, round(list_dot_product(v, q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS score
  FROM aq JOIN embeddings q ON q.vec_id = aq.query_id JOIN nv ON nv.collection = aq.collection WHERE aq.k <> 'structural' OR nv.vec_id % 5 = 0),
ls AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS r, 0 AS l FROM dn UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id), 1 FROM sp WHERE score > 0),
lt AS (SELECT * FROM ls WHERE r <= 60), nl AS (SELECT query_id, collection, count(DISTINCT l) AS n FROM lt GROUP BY ALL),
fu AS (SELECT query_id, collection, id, round(sum(1.0::DOUBLE / (60 + r)) / (any_value(n) / 61.0::DOUBLE), 12) AS score, min(l * 1000 + r) AS p FROM lt JOIN nl USING (query_id, collection) GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, p) AS r FROM fu),
nt AS (SELECT tp.query_id, tp.collection, id, score, row_number() OVER (PARTITION BY tp.query_id ORDER BY score DESC, place, r) AS nth FROM tp JOIN aq ON aq.query_id = tp.query_id AND aq.collection = tp.collection WHERE r <= 20)"""


def _found_by_all(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, asked = _indexed(spark, sf_dir), _asked(spark, sf_dir)
    return Q.hits(_index(spark, sf_dir, "chunks"), _vectors(spark, sf_dir, chunks), chunks, asked), chunks, asked


@query(f"WITH {_FOUND} SELECT query_id, nth, collection, id, round(score, 6) AS score FROM nt WHERE nth <= 20")
def retrieval_hits(spark, sf_dir):
    """The best 20 chunks of all collections for every test item: routed, searched both ways, fused and merged."""
    return _found_by_all(spark, sf_dir)[0].withColumn("score", r6("score"))


@query(f"""WITH {_FOUND} SELECT query_id, nth AS rank, md5(content) AS digest, coalesce(doc_title, '?') AS source, round(score, 3) AS score, nt.collection FROM nt JOIN c ON c.id = nt.id WHERE nth <= 20""")
def retrieval_rows(spark, sf_dir):
    found, chunks, _ = _found_by_all(spark, sf_dir)
    return Q.result_rows(found, chunks).select("query_id", "rank", F.md5("text").alias("digest"), "source", "score", "collection")


@query()
def retrieval_contexts(spark, sf_dir):
    found, chunks, asked = _found_by_all(spark, sf_dir)
    return Q.contexts(found, chunks, asked, Q.overlap_rerank)


@query(f"WITH {_BM25} SELECT doc_id, term, round(idf * tn, 6) AS weight FROM wt", name="sparse_index")
def sparse_index(spark, sf_dir):
    return Q.weighted(_all_in_one(spark, sf_dir)).select(F.col("id").alias("doc_id"), "term", r6("weight").alias("weight"))


# -- sessions --------------------------------------------------------------------------------------------------------


def _messages(spark, sf_dir) -> DataFrame:
    """Assistants' rows stand for tool results."""
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), role.alias("role"), F.col("text").alias("content"))


_TURNS = f"""m AS (SELECT conv_id AS session, turn AS pos, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, coalesce(text, '') AS content FROM conversations),
tn AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS turn, {_msg_tokens("content")} + 10 AS tokens FROM m),
ag AS (SELECT *, max(turn) OVER (PARTITION BY session) - turn AS age FROM tn)"""


@query(f"WITH {_TURNS} SELECT session, pos, CAST(turn AS BIGINT) AS turn, tokens, CAST(age AS BIGINT) AS age FROM ag")
def turn_numbers(spark, sf_dir):
    return V.turns(_messages(spark, sf_dir)).select("session", "pos", "turn", "tokens", "age")


_MASK = "role = 'tool' AND age >= 1 AND NOT (regexp_matches(content, '(?i)error|fail|stderr|BLOCKED|❌') AND age < 5) AND (length(content) > 500 OR age >= 3)"


@query(f"WITH {_TURNS} SELECT session, count(*) FILTER ({_MASK}) AS masked FROM ag GROUP BY session")
def masking(spark, sf_dir):
    return V.masked(V.turns(_messages(spark, sf_dir))).groupBy("session").agg(F.count_if("masked").alias("masked"))


@query(f"""WITH {_TURNS}, u AS (SELECT session, CAST(sum(tokens) AS BIGINT) AS tokens FROM ag GROUP BY session)
SELECT session, tokens, 'small' AS tier, CASE WHEN tokens / 1500.0::DOUBLE >= 0.9 THEN 'compact' WHEN tokens / 1500.0::DOUBLE >= 0.7 THEN 'extract' WHEN tokens / 1500.0::DOUBLE >= 0.5 THEN 'summarise' WHEN tokens / 1500.0::DOUBLE >= 0.35 THEN 'mask' END AS action FROM u""")
def context_budget(spark, sf_dir):
    rows = V.turns(_messages(spark, sf_dir)).groupBy("session").agg(F.sum("tokens").alias("tokens")).withColumn("b", V.budget(F.lit(2000)))
    return rows.select("session", "tokens", "b.tier", V.compression(F.col("tokens") / F.col("b.available"), F.col("b")).alias("action"))


@query(f"WITH {_TURNS}, n AS (SELECT session, pos, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY pos) AS k FROM ag) SELECT session, pos, n <= 6 OR k = 1 OR k > n - 4 AS stays FROM n")
def compaction(spark, sf_dir):
    return V.kept_by_summary(V.turns(_messages(spark, sf_dir)), 6, 4).select("session", "pos", "stays")


@query(f"""WITH {_TURNS}, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY pos) AS k FROM ag),
g AS (SELECT *, trim(regexp_extract(content, '^[^.!?\n]*')) AS first FROM n WHERE NOT (n <= 6 OR k = 1 OR k > n - 4)),
c AS (SELECT session, count(*) AS n_trimmed, count(*) FILTER (role = 'tool' AND regexp_matches(content, '(?i)✓|✅|success')) AS successes, count(*) FILTER (role = 'tool' AND regexp_matches(content, '(?i)❌|STDERR|Error|FAIL')) AS errors,
  list(first ORDER BY pos) FILTER (role = 'assistant' AND length(content) > 20 AND length(first) > 10 AND length(first) < 200) AS s FROM g GROUP BY session)
SELECT session, n_trimmed, successes, errors, coalesce(array_to_string(s[-3:], '; '), '') AS context FROM c""")
def session_summary(spark, sf_dir):
    return V.summaries(V.kept_by_summary(V.turns(_messages(spark, sf_dir)), 6, 4))


@query("""WITH s AS (SELECT conv_id AS session, turn AS pos, lower(coalesce(text, '')) AS q, length(coalesce(text, '')) % 3 AS top, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: length(x) > 2)) AS w FROM conversations),
p AS (SELECT a.session, a.pos, count(*) AS "similar" FROM s a JOIN s b ON a.session = b.session AND b.pos < a.pos AND b.pos >= a.pos - 20 AND a.top = b.top
WHERE (len(a.w) = 0 AND len(b.w) = 0) OR len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.2::DOUBLE GROUP BY ALL)
SELECT * FROM p WHERE "similar" >= 3""")
def search_repetition(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), text.alias("query"), (F.length(text) % 3).alias("top"))
    return V.repeated_searches(rows)


_HAPPENED = """e AS (SELECT conv_id AS session, turn AS pos, CASE WHEN turn = 0 THEN 'task' WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'status' ELSE 'search' END WHEN turn % 4 = 2 THEN 'do_not' ELSE 'correction' END AS kind,
  CASE WHEN role = 'assistant' AND turn % 4 <> 1 THEN coalesce(text, '') WHEN role <> 'assistant' AND turn % 4 = 2 AND turn > 0 THEN 'topic ' || (length(coalesce(text, '')) % 2) ELSE substr(coalesce(text, ''), 1, 20) END AS text, length(coalesce(text, '')) % 3 AS top FROM conversations)"""


@query(f"""WITH {_HAPPENED}, t AS (SELECT session, arg_max(text, pos) FILTER (kind = 'task') AS task, max(pos) FILTER (kind = 'task') AS began FROM e GROUP BY session),
st AS (SELECT session, string_agg('✓ ' || text, ' → ' ORDER BY pos) AS x FROM (SELECT e.* FROM e JOIN t USING (session) WHERE kind = 'status' AND pos > began QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 5) GROUP BY session),
co AS (SELECT session, string_agg('  User (turn ' || pos || '): "' || text || '"', chr(10) ORDER BY pos) AS x FROM (SELECT * FROM e WHERE kind = 'correction' QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 5) GROUP BY session),
dn AS (SELECT session, string_agg(text, '. ' ORDER BY pos) AS x FROM (SELECT session, text, max(pos) AS pos FROM e JOIN t USING (session) WHERE kind = 'do_not' AND pos > began GROUP BY session, text QUALIFY row_number() OVER (PARTITION BY session ORDER BY max(pos) DESC) <= 3) GROUP BY session),
s AS (SELECT session, top, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2)) AS w, row_number() OVER (PARTITION BY session ORDER BY pos) AS n FROM e WHERE kind = 'search'),
r AS (SELECT a.session, count(*) AS n FROM s a JOIN s b ON a.session = b.session AND b.n < a.n AND b.n >= a.n - 20 AND a.top = b.top
  WHERE (len(a.w) = 0 AND len(b.w) = 0) OR len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.2::DOUBLE GROUP BY a.session)
SELECT t.session, CASE WHEN coalesce(task, '') = '' THEN '' ELSE '[TASK] ' || task || coalesce(chr(10) || '[STATUS] ' || st.x, '') || coalesce(chr(10) || '[CORRECTIONS]' || chr(10) || co.x, '') || coalesce(chr(10) || '[DO NOT] ' || dn.x || '.', '') END AS anchor,
  least(20, coalesce((SELECT max(n) FROM s WHERE s.session = t.session), 0)) AS searches, coalesce(r.n, 0) AS "similar"
FROM t LEFT JOIN st USING (session) LEFT JOIN co USING (session) LEFT JOIN dn USING (session) LEFT JOIN r USING (session)""")
def session_anchors(spark, sf_dir):
    """What each conversation's working memory says at its end, kept as keyed state over its turns; searches repeated on the way."""
    text, turn, said = F.coalesce("text", F.lit("")), F.col("turn"), F.col("role") == "assistant"
    kind = F.when(turn == 0, "task").when(said, F.when(turn % 4 == 1, "status").otherwise("search")).when(turn % 4 == 2, "do_not").otherwise("correction")
    own = F.when(said & (turn % 4 != 1), text).when(~said & (turn % 4 == 2) & (turn > 0), F.concat(F.lit("topic "), (F.length(text) % 2).cast("string"))).otherwise(F.substring(text, 1, 20))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), turn.alias("pos"), F.lit(None).cast("timestamp").alias("ts"), kind.alias("kind"), own.alias("text"), "turn", (F.length(text) % 3).alias("top"))
    out = Z.working_memory(rows).groupBy("session").agg(F.max_by("anchor", "pos").alias("anchor"), F.max_by("searches", "pos").cast("long").alias("searches"), F.coalesce(F.sum("similar"), F.lit(0)).alias("similar"))
    return out


@query()
def memory_quality_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("text").alias("content"), F.lit("fact").alias("kind"))
    return V.quality_gate(rows, ["fact"])


@query(f"SELECT owner, scope, key, arg_max(value, pos) AS value FROM (SELECT * REPLACE (coalesce(value, chr(0)) AS value) FROM {I.WRITES.sql()}) GROUP BY ALL HAVING arg_max(value, pos) <> chr(0)")
def memory_values(spark, sf_dir):
    return M.latest(I.WRITES.df(spark))


@query(f"""WITH v AS (SELECT owner, scope, key, arg_max(value, pos) AS value FROM (SELECT * REPLACE (coalesce(value, '') AS value) FROM {I.WRITES.sql()}) GROUP BY ALL),
r AS (SELECT owner, value, CASE {" ".join(f"WHEN scope = '{a}' AND key = '{b}' THEN {k}" for k, (a, b, _) in enumerate(M.INSTRUCTIONS))} END AS nth FROM v WHERE value <> '')
SELECT owner, string_agg('[' || {[c for *_, c in M.INSTRUCTIONS]}[nth + 1] || '] ' || value, chr(10) ORDER BY nth) AS block FROM r WHERE nth IS NOT NULL GROUP BY owner""")
def instruction_blocks(spark, sf_dir):
    return M.instructions(M.latest(I.WRITES.df(spark)))


@query(f"""SELECT CASE type WHEN 'user_pref' THEN 'user' ELSE 'project' END AS scope, CASE type WHEN 'user_pref' THEN 'user_pref_' ELSE 'fact_' END || (row_number() OVER (PARTITION BY type ORDER BY pos) - 1) AS key, content AS value
FROM {I.LEGACY.sql()} WHERE length(content) >= 10 AND NOT regexp_matches(content, '{M.GREETING}') AND type IN ('user_pref', 'project_fact')""")
def legacy_memory(spark, sf_dir):
    return M.migrated(I.LEGACY.df(spark))


@query("""WITH m AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS content, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT session, pos, content, CASE WHEN session % 3 = 0 THEN 'reset' WHEN pos < n - 1 THEN 'known' ELSE 'appended' END AS origin FROM m WHERE session % 3 <> 0 OR n > 0""")
def session_sync(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("content"))
    by = Window.partitionBy("session")
    rows = rows.withColumn("pos", (F.row_number().over(by.orderBy("turn")) - 1).cast("long")).withColumn("n", F.count("*").over(by))
    # each third session began otherwise before; of the others all rows but the last were known
    other = F.when(F.col("session") % 3 == 0, F.concat(F.lit("old "), F.coalesce("content", F.lit("")))).otherwise(F.col("content"))
    known = rows.where("pos < n - 1 or session % 3 = 0").withColumn("content", other)
    return M.synchronised(known.select("session", "pos", "content"), rows.select("session", "pos", "content"))


@query(f"""WITH l AS {I.INGESTED.sql()}, s AS (SELECT doc_id, max(pos) AS at, arg_max(event, pos) AS e FROM l WHERE event IN ('start', 'reset') GROUP BY doc_id)
SELECT s.doc_id, arg_min(l.collection, l.pos) AS collection, arg_min(l.n, l.pos) AS total_chunks, coalesce(arg_max(l.n, l.pos) FILTER (event = 'progress'), 0) AS processed, CASE WHEN bool_or(event = 'complete') THEN 'complete' ELSE 'in_progress' END AS status
FROM s JOIN l ON l.doc_id = s.doc_id AND l.pos >= s.at WHERE s.e = 'start' GROUP BY s.doc_id""")
def ingestion_status(spark, sf_dir):
    return M.ingestion_states(I.INGESTED.df(spark))


# -- outcomes --------------------------------------------------------------------------------------------------------


def _outcomes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("error_code"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("strategy"), F.concat(F.lit("l"), (F.col("user_id") % 2).cast("string")).alias("language"), (F.col("value") >= 50).alias("passed"), F.col("user_id").alias("session"), F.when(F.col("event_id") % 2 == 0, F.lit("d")).alias("diff"), F.concat(F.lit("TypeError "), "event_type").alias("message"))


_OUT = "o AS (SELECT event_id, ts, event_type AS error_code, 's' || (user_id % 3) AS strategy, 'l' || (user_id % 2) AS language, value >= 50 AS passed, user_id AS session, CASE WHEN event_id % 2 = 0 THEN 'd' END AS diff FROM events)"


@query(f"WITH {_OUT}, r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY error_code ORDER BY ts DESC, event_id DESC) <= 20) SELECT error_code, count(*) AS total, round(avg(passed::INT), 6) AS success_rate, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_seen, count(DISTINCT session) AS sessions, count(DISTINCT session) >= 3 AS systemic FROM r GROUP BY error_code")
def error_trends(spark, sf_dir):
    return V.trends(_outcomes(spark, sf_dir)).withColumn("success_rate", r6("success_rate"))


@query(f"WITH {_OUT}, r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY error_code ORDER BY ts DESC, event_id DESC) <= 20) SELECT error_code, strategy, count(*) AS failures FROM r WHERE NOT passed GROUP BY ALL HAVING count(*) >= 2")
def escalations(spark, sf_dir):
    return V.escalations(_outcomes(spark, sf_dir))


@query(f"WITH {_OUT} SELECT error_code, event_id, row_number() OVER (PARTITION BY error_code ORDER BY ts DESC, event_id DESC) AS nth FROM o QUALIFY nth <= 5")
def ring_buffers(spark, sf_dir):
    return V.ring(_outcomes(spark, sf_dir), ["error_code"], ["ts", "event_id"], 5).select("error_code", "event_id", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_OUT}, w AS (SELECT *, count(*) OVER k AS n, min(passed::INT) OVER k AS ok FROM o WINDOW k AS (PARTITION BY language, error_code, strategy ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT language, error_code, arg_max(strategy, (ts, event_id)) AS strategy FROM w WHERE n = 5 AND ok = 1 GROUP BY ALL""")
def strategy_promotion(spark, sf_dir):
    return V.promoted(_outcomes(spark, sf_dir))


@query(f"""WITH {_OUT}, w AS (SELECT *, count(*) OVER k AS n, min(passed::INT) OVER k AS ok FROM o WINDOW k AS (PARTITION BY language, error_code, strategy ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
p AS (SELECT language, error_code, arg_max(strategy, (ts, event_id)) AS strategy FROM w WHERE n = 5 AND ok = 1 GROUP BY ALL)
SELECT o.language, o.error_code, count(*) AS outcomes, any_value(p.strategy) AS strategy FROM o LEFT JOIN p USING (language, error_code) GROUP BY ALL""")
def streamed_outcomes(spark, sf_dir):
    """Outcomes that arrive in three parts, each run through the sink by a stream that goes on where it stopped: counts and promotions by code."""
    rows = _outcomes(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "language", "error_code", "strategy", "passed")
    cuts = rows.select(F.percentile_approx(F.col("ts").cast("double"), [0.3, 0.6], 1000)).first()[0] or [0.0, 0.0]
    sink, source, at = J.OutcomeSink(spark, scratch(spark, "sink")), scratch(spark, "source"), scratch(spark, "progress")
    when = F.col("ts").cast("double")
    for part in (when <= cuts[0], (when > cuts[0]) & (when <= cuts[1]), when > cuts[1]):
        rows.where(part).write.mode("append").parquet(source)
        sink.start(spark.readStream.schema(rows.schema).parquet(source), at).awaitTermination()
    n = sink.outcomes().groupBy("language", "error_code").agg(F.count("*").alias("outcomes"))
    return n.join(sink.promotions(), ["language", "error_code"], "left")


@query(f"WITH {_OUT} SELECT error_code, language, count(*) AS n, round(avg(passed::INT), 6) AS rate FROM o GROUP BY ALL")
def fix_rates(spark, sf_dir):
    return H.fix_rates(_outcomes(spark, sf_dir)).withColumn("rate", r6("rate"))


@query(f"""WITH {_OUT}, e AS (SELECT DISTINCT error_code AS code, language FROM o),
x AS (SELECT error_code, language, arg_max(event_id, (ts, event_id)) FILTER (diff IS NOT NULL) AS a, arg_max(event_id, (ts, event_id)) AS b FROM o WHERE passed GROUP BY ALL)
SELECT code || '/' || e.language AS id, coalesce(a, b) AS event_id, CASE WHEN a IS NOT NULL THEN 1 ELSE 2 END::BIGINT AS priority FROM e JOIN x ON x.error_code = e.code AND x.language = e.language""")
def similar_fix(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    errors = o.select(F.col("error_code").alias("code"), "language").distinct().select(F.concat_ws("/", "code", "language").alias("id"), "code", "language", F.lit(None).cast("string").alias("message"))
    return H.similar_fixes(errors, o)


# -- graphs ----------------------------------------------------------------------------------------------------------

_G = f"e AS (SELECT DISTINCT src, dst FROM {I.EDGES.sql()}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT src AS node, dst AS reach FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach), cy AS (SELECT a.node, min(a.reach) AS component FROM r a JOIN r b ON a.node = b.reach AND a.reach = b.node GROUP BY a.node)"


def _nodes(spark) -> DataFrame:
    e = I.EDGES.df(spark)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query(f"WITH RECURSIVE {_G} SELECT reach AS file, node AS dependent FROM r")
def transitive_dependents(spark, sf_dir):
    return G.dependents(I.EDGES.df(spark))


@query(f"WITH RECURSIVE {_G} SELECT node, component FROM cy")
def cycles(spark, sf_dir):
    return G.cycles(I.EDGES.df(spark))


_RANKS = f"""{_G}, cn AS (SELECT n.node, coalesce(cy.component, n.node) AS c FROM n LEFT JOIN cy ON cy.node = n.node), ce AS (SELECT DISTINCT a.c AS ca, b.c AS cb FROM e JOIN cn a ON a.node = e.src JOIN cn b ON b.node = e.dst WHERE a.c <> b.c),
dp AS (SELECT c, 0 AS d FROM cn UNION SELECT cb, d + 1 FROM dp JOIN ce ON ce.ca = dp.c), md AS (SELECT c, max(d) AS d FROM dp GROUP BY c),
rk AS (SELECT n.node, CAST(md.d AS BIGINT) AS depth, (SELECT count(*) FROM e WHERE src = n.node) AS n_dependencies, (SELECT count(*) FROM e WHERE dst = n.node) AS n_dependents, (SELECT count(*) FROM r WHERE reach = n.node) AS n_transitive, n.node IN (SELECT node FROM cy) AS in_cycle FROM n JOIN cn ON cn.node = n.node JOIN md ON md.c = cn.c)"""


@query(f"WITH RECURSIVE {_RANKS} SELECT *, n_dependents = 0 AS is_root, n_dependencies = 0 AS is_leaf, n_dependents >= 3 AS is_hub FROM rk")
def file_ranks(spark, sf_dir):
    return G.ranks(_nodes(spark), I.EDGES.df(spark))


_FOLLOWED = """e AS (SELECT DISTINCT src, dst FROM (SELECT lag(l_partkey) OVER w AS src, l_partkey AS dst, lag(l_discount) OVER w AS d, l_discount FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE d = l_discount AND src IS NOT NULL AND dst IS NOT NULL),
r AS (SELECT src AS node, dst AS reach FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach), n AS (SELECT p_partkey AS node FROM part),
cy AS (SELECT a.node, min(a.reach) AS component FROM r a JOIN r b ON a.node = b.reach AND a.reach = b.node GROUP BY a.node),
cn AS (SELECT n.node, coalesce(cy.component, n.node) AS c FROM n LEFT JOIN cy ON cy.node = n.node), ce AS (SELECT DISTINCT a.c AS ca, b.c AS cb FROM e JOIN cn a ON a.node = e.src JOIN cn b ON b.node = e.dst WHERE a.c <> b.c),
dp AS (SELECT DISTINCT c, 0 AS d FROM cn UNION SELECT cb, d + 1 FROM dp JOIN ce ON ce.ca = dp.c), md AS (SELECT c, max(d) AS d FROM dp GROUP BY c),
ti AS (SELECT reach AS node, count(*) AS n FROM r GROUP BY reach), oi AS (SELECT src AS node, count(*) AS n FROM e GROUP BY src), ii AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst)"""


def _followed(spark, sf_dir) -> DataFrame:
    """Parts that follow one another in an order at the same discount: a graph with one large component and many tails."""
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.lag("l_partkey").over(over).alias("src"), F.col("l_partkey").alias("dst"), F.lag("l_discount").over(over).alias("d"), "l_discount")
    return rows.where("d = l_discount and src is not null and dst is not null").select("src", "dst").distinct()


@query(f"WITH RECURSIVE {_FOLLOWED} SELECT node, component FROM cy")
def part_components(spark, sf_dir):
    """Strongly connected components of the graph of parts, by trimming and colours."""
    return G.cycles(stored(_followed(spark, sf_dir), "edges"))


@query(f"""WITH RECURSIVE {_FOLLOWED} SELECT cn.node, CAST(md.d AS BIGINT) AS depth, coalesce(oi.n, 0) AS n_dependencies, coalesce(ii.n, 0) AS n_dependents, coalesce(ti.n, 0) AS n_transitive, cy.node IS NOT NULL AS in_cycle,
  coalesce(ii.n, 0) = 0 AS is_root, coalesce(oi.n, 0) = 0 AS is_leaf, coalesce(ii.n, 0) >= 3 AS is_hub
FROM cn JOIN md ON md.c = cn.c LEFT JOIN oi ON oi.node = cn.node LEFT JOIN ii ON ii.node = cn.node LEFT JOIN ti ON ti.node = cn.node LEFT JOIN cy ON cy.node = cn.node""")
def part_ranks(spark, sf_dir):
    """Depth, degrees, reach and cycles of all parts, on the graph of components."""
    return G.ranks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), _followed(spark, sf_dir))


@query(f"WITH RECURSIVE {_RANKS} SELECT count(*) AS files, CAST(sum(n_dependencies) AS BIGINT) AS edges, count(*) FILTER (n_dependents >= 3) AS hubs, count(*) FILTER (n_dependents = 0) AS roots, count(*) FILTER (n_dependencies = 0) AS leaves, count(*) FILTER (in_cycle) AS cyclic FROM rk")
def project_summary(spark, sf_dir):
    return G.summary(_nodes(spark), I.EDGES.df(spark))


@query(f"SELECT src, dst, array_to_string(arg_max(symbols, pos), ',') AS symbols FROM {I.EDGES.sql()} GROUP BY src, dst")
def edge_symbols(spark, sf_dir):
    return G.last_edges(I.EDGES.df(spark)).withColumn("symbols", F.array_join("symbols", ","))


@query()
def resolve_imports(spark, sf_dir):
    return G.resolved(I.IMPORTS.df(spark), I.FILES.df(spark)).select("src", "raw", "dst")


@query()
def validate_imports(spark, sf_dir):
    return G.validated(I.IMPORTS.df(spark), I.FILES.df(spark), I.EXPORTS.df(spark))


@query(f"""WITH a AS {I.AFTER.sql()}, b AS {I.BEFORE.sql()}, x AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.symbols, []) AS n, coalesce(b.symbols, []) AS o FROM a FULL JOIN b ON a.file = b.file),
y AS (SELECT file, list_sort(list_filter(n, lambda s: NOT list_contains(o, s))) AS added, list_sort(list_filter(o, lambda s: NOT list_contains(n, s))) AS removed FROM x) SELECT file, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM y WHERE len(added) + len(removed) > 0""")
def import_deltas(spark, sf_dir):
    return G.export_changes(I.BEFORE.df(spark), I.AFTER.df(spark)).select("file", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"""WITH RECURSIVE e AS (SELECT src AS here, trim(split_part(s, ' as ', 1)) AS symbol, arg_min(dst, pos) AS dst FROM (SELECT src, dst, pos, unnest(symbols) AS s FROM {I.EDGES.sql()}) GROUP BY ALL),
r AS (SELECT id, file, symbol, file AS here, [file] AS seen, 0 AS k FROM {I.ERRORS.sql()} UNION ALL
  SELECT r.id, r.file, r.symbol, CASE WHEN e.dst IS NOT NULL AND NOT list_contains(seen, e.dst) THEN e.dst ELSE r.here END, CASE WHEN e.dst IS NOT NULL AND NOT list_contains(seen, e.dst) THEN list_append(seen, e.dst) ELSE seen END, k + 1 FROM r LEFT JOIN e ON e.here = r.here AND e.symbol = r.symbol WHERE k < 5)
SELECT id, file, symbol, CASE WHEN here <> file THEN here END AS origin, len(seen) - 1 AS hops FROM r WHERE k = 5""")
def root_cause_trace(spark, sf_dir):
    return G.origin_trace(I.ERRORS.df(spark), I.EDGES.df(spark))


@query()
def source_imports(spark, sf_dir):
    return P.listed(P.script_modules(I.SOURCES.df(spark)), "imports")


@query()
def source_exports(spark, sf_dir):
    return P.listed(P.script_modules(I.SOURCES.df(spark)), "exports")


@query()
def source_definitions(spark, sf_dir):
    return P.listed(P.script_modules(I.SOURCES.df(spark)), "definitions")


@query()
def python_modules(spark, sf_dir):
    return P.python_modules(I.MODULES.df(spark))


@query()
def pattern_modules(spark, sf_dir):
    imports, shown = [P.Pattern(r'^import\s+"([^"]+)"', "module", ["source"])], [P.Pattern(r"^func\s+([A-Z]\w*)", "named", ["functionName"])]
    return P.pattern_modules(I.GO.df(spark), imports, shown, [P.Pattern(r"^func\s+(\w+)", "function"), P.Pattern(r"^type\s+(\w+)\s+struct", "struct"), P.Pattern(r"(", "bad")])


# -- errors and fixes ------------------------------------------------------------------------------------------------

_RE2 = {"typescript", "go", "java", "php"}


def _parse_sql(language: str) -> str | None:
    """Languages of one form whose pattern both engines read alike."""
    own = E.LANGUAGES[language]
    if language not in _RE2:
        return None
    f, raw = own.forms[0], I.outputs(I.OUTPUTS[language]).sql()
    p = f.pattern.replace("'", "''")
    get = lambda g: f"regexp_extract_all(raw, '{p}', {g})"
    opt = lambda g, d: f"unnest({get(g)})" if g else d
    kinds = " ".join(f"WHEN regexp_matches(lower(message), '{a}') THEN '{b}'" for a, b in own.kinds)
    return f"""WITH x AS (SELECT id, generate_subscripts({get(0)}, 1) - 1 AS nth, trim({opt(f.file, "''")}) AS file, CAST({opt(f.line, "'0'")} AS INTEGER) AS line, TRY_CAST({opt(f.column, "NULL")} AS INTEGER) AS "column", {opt(f.code, f"'{f.constant}'")} AS code, trim({opt(f.message, "''")}) AS message FROM {raw})
SELECT *, CASE {kinds} ELSE 'runtime' END AS category FROM x"""


def _form_sql(f: E.Form) -> str:
    """The rows of a form as a list of structs, by the same rules as the engine's columns."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    get = lambda g: f"regexp_extract_all(raw, {q(f.pattern)}, {max(g, 0)})"
    x = lambda g: f"coalesce({get(g)}[i], '')" if g else "''"
    place, line = q(f.place), "'0'"
    if f.at:
        place, line = (f"regexp_extract_all(raw, {q(f.at)}, {g})[{1 if f.first else -1}]" for g in (1, 2))
    code = x(f.code) if f.code and not (f.constant and f.named) else "''"
    if f.coded:
        a, b = f.coded.split("%s")
        code = f"{q(a)} || upper(regexp_replace({code}, 'Error$', '')) || {q(b)}"
    said = f"trim({x(f.message)})"
    message = f"{x(f.code)} || ': ' || {said}" if f.named else f"{q(f.prefix)} || {said} || {q(f.suffix)}"
    file = "CAST(NULL AS VARCHAR)" if f.nowhere else f"trim({x(f.file)})" if f.file else f"coalesce({place}, '')"
    number = "CAST(NULL AS INTEGER)" if f.nowhere else f"coalesce(TRY_CAST({x(f.line) if f.line else line} AS INTEGER), 0)"
    row = f"""{{'file': {file}, 'line': {number}, 'column': TRY_CAST({x(f.column)} AS INTEGER), 'code': CASE WHEN {code} = '' THEN {q(f.constant)} ELSE {code} END, 'message': {message}, 'said': {said}, 'category': {q(f.category) if f.category else "CAST(NULL AS VARCHAR)"}}}"""
    rows = f"list_transform(range(1, len({get(0)}) + 1), lambda i: {row})"
    return f"CASE WHEN {place} IS NOT NULL AND TRY_CAST({line} AS INTEGER) > 0 THEN {rows}[1:1] ELSE {rows}[1:0] END" if f.at and not f.first else rows


def _all_forms_sql(language: str) -> str:
    """SQL of all forms of a language: the first that finds any, what is looked for besides, and what is looked for last."""
    own, chain = E.LANGUAGES[language], lambda fs: _form_sql(fs[0]) if len(fs) == 1 else f"CASE WHEN len({_form_sql(fs[0])}) > 0 THEN {_form_sql(fs[0])} ELSE {chain(fs[1:])} END"
    rows = chain(own.forms)
    for f in own.extra:
        rows = f"list_concat({rows}, {_form_sql(f)})"
    last = f"SELECT id, CASE WHEN len(e) > 0 THEN e ELSE {chain(own.last)} END AS e FROM a" if own.last else "SELECT id, e FROM a"
    kinds = " ".join("WHEN regexp_matches(lower(e.said), '{}') THEN '{}'".format(p.replace("'", "''"), k) for p, k in own.kinds)
    return f"""WITH a AS (SELECT id, raw, {rows} AS e FROM {I.outputs(I.OUTPUTS[language]).sql()}), b AS ({last}), x AS (SELECT id, generate_subscripts(e, 1) - 1 AS nth, unnest(e) AS e FROM b)
SELECT id, nth, e.file AS file, e.line AS line, e."column" AS "column", e.code AS code, e.message AS message, coalesce(e.category, CASE {kinds} ELSE 'runtime' END) AS category FROM x"""


_PART3 = "list_transform([1, 2, 3], lambda i: coalesce(TRY_CAST(regexp_extract(coalesce(string_split(regexp_replace(trim({0}), '^v', ''), '.')[i], ''), '^\\s*(\\d+)', 1) AS INTEGER), 0))"
_PHP_ERRORS = r"Errors:\s*(\d+)"


def _counts_sql(language: str) -> str:
    own = E.LANGUAGES[language]
    one = lambda p: "CAST(len(regexp_extract_all(raw, '{}')) AS BIGINT)".format(p[1:].replace("'", "''")) if p[0] == "#" else "TRY_CAST(regexp_extract(raw, '{}', 1) AS BIGINT)".format(p.replace("'", "''"))
    number = lambda ps: f"coalesce({', '.join(map(one, reversed(ps)))}, 0)"
    passed, failed = number(own.passed), number(own.failed)
    if language == "java":
        m = [f"TRY_CAST(regexp_extract(raw, 'Tests run:\\s*(\\d+),\\s*Failures:\\s*(\\d+),\\s*Errors:\\s*(\\d+)', {g}) AS BIGINT)" for g in (1, 2, 3)]
        passed, failed = f"coalesce({m[0]} - {m[1]} - {m[2]}, {passed} - {failed})", f"coalesce({m[1]} + {m[2]}, {failed})"
    if language == "php":
        failed = f"({failed} + {number((_PHP_ERRORS,))})"
        passed = f"greatest({passed} - {failed}, 0)"
    return f"SELECT id, {passed} AS passed, {failed} AS failed FROM {I.outputs(I.TESTS[language]).sql()}"


for _l in E.LANGUAGES:
    query(_parse_sql(_l) or _all_forms_sql(_l), f"parse_errors_{_l}")(lambda spark, sf_dir, _l=_l: E.parsed(I.outputs(I.OUTPUTS[_l]).df(spark), _l))
for _l in I.TESTS:
    query(_counts_sql(_l), f"parse_tests_{_l}")(lambda spark, sf_dir, _l=_l: E.test_counts(I.outputs(I.TESTS[_l]).df(spark), _l))


# the same parsers over logs and test results of all users
for _l in O.LOGS:
    query(O.logs_sql(_l, E.LANGUAGES[_l].kinds), f"logged_errors_{_l}")(lambda spark, sf_dir, _l=_l: E.parsed(O.logs(spark, sf_dir, _l), _l))
for _l in (*O.RUNS, "go"):
    query(O.RUNS_SQL, f"logged_tests_{_l}")(lambda spark, sf_dir, _l=_l: E.test_counts(O.runs(spark, sf_dir, _l), _l))


@query("SELECT event_id AS id, true AS crashed FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL")
def logged_crashes(spark, sf_dir):
    return E.crashed(O.logs(spark, sf_dir, "python"), "python")


@query("SELECT id, " + " OR ".join(f"regexp_matches(raw, '{p}')" for p in E.LANGUAGES["python"].crash) + f" AS crashed FROM {I.outputs(I.OUTPUTS['python']).sql()}")
def crash_detection(spark, sf_dir):
    return E.crashed(I.outputs(I.OUTPUTS["python"]).df(spark), "python")


_HINT = " ".join("WHEN regexp_matches(message, '{0}') THEN trim(regexp_extract(message, '{0}', 1))".format(p.replace("'", "''")) for p, *_ in T.HINTS)


@query(f"SELECT id, CASE {_HINT} END AS suggestion FROM {I.HINTS.sql()}")
def compiler_hints(spark, sf_dir):
    return I.HINTS.df(spark).select("id", X.hint_of(F.col("message"))["suggestion"].alias("suggestion"))


@query(f"SELECT m.id, min(r.pos) AS rule FROM {I.MESSAGES.sql()} m JOIN {I.RULES.sql()} r ON r.technology = m.technology AND regexp_matches(m.message, r.pattern) GROUP BY m.id")
def error_pattern_diagnosis(spark, sf_dir):
    return E.diagnosed(I.MESSAGES.df(spark), I.RULES.df(spark))


_PAIRS = """w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}')[1:13] AS w FROM benchmark),
p AS (SELECT item_id * 100 + i AS rule, w[i] AS a, w[i + 1] AS b FROM (SELECT item_id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM w)),
l AS (SELECT doc_id, line, lower(line) AS low FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))"""


def _pair_rules(spark, sf_dir) -> DataFrame:
    """Patterns of two words of a test item, one after the other with at most forty characters between: a dozen for each item."""
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{5,})")), 1, 13)
    own = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    one = own.where("size(w) > 1").select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    return one.select((F.col("item_id") * 100 + F.col("i")).alias("rule"), F.concat(F.lit("(?i)"), F.element_at("w", F.col("i")), F.lit(".{0,40}"), F.element_at("w", F.col("i") + 1)).alias("pattern"))


@query(f"WITH {_PAIRS} SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM l, p WHERE CASE WHEN contains(low, a) AND contains(low, b) THEN regexp_matches(line, '(?i)' || a || '.{{0,40}}' || b) ELSE false END GROUP BY rule")
def pattern_lines(spark, sf_dir):
    """Hundreds of patterns over all lines of all documents: how many lines each is found in, and the first document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("text"))
    return PT.matches(lines, _pair_rules(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT id, concat_ws(' ', language, code, substr(message, 1, 80), 'fix') AS query FROM {I.ERRORS.sql()}")
def error_search_queries(spark, sf_dir):
    return I.ERRORS.df(spark).select("id", M.search_query(F.col("language"), F.col("code"), F.col("message")).alias("query"))


@query()
def explained_errors(spark, sf_dir):
    kind = "pos long, technology string, pattern string, captures array<string>, root_cause string, prescription string, code_block string, conditions array<struct<when:string,root_cause:string,prescription:string,code_block:string>>"
    rules = [(1, "python", r"No module named (\w+)", ["module"], "{module} is missing", "pip install {module}", None, [("module equals x", "x is odd", None, "# {module}"), ("module contains x", "never", None, None)]), (2, "python", "Error", [], "an error", "look", None, [])]
    return E.explained(I.MESSAGES.df(spark), spark.createDataFrame(rules, kind))


_CLS = f"cl AS (SELECT e.*, coalesce(c.p, 0.5) AS probability, CASE WHEN c.code IS NULL THEN 'unknown' WHEN c.p > 0.5 THEN 'likely_cross_file' ELSE 'likely_local' END AS type, c.s AS strategy, c.co AS co_codes FROM {I.ERRORS.sql()} e LEFT JOIN (SELECT code, arg_max(probability, pos) AS p, arg_max(strategy, pos) AS s, arg_max(co_codes, pos) AS co FROM {I.CATALOG.sql()} GROUP BY code) c ON c.code = e.code)"


@query(f"WITH {_CLS} SELECT id, file, code, probability, type, strategy FROM cl")
def classify_errors(spark, sf_dir):
    return E.classified(I.ERRORS.df(spark), I.CATALOG.df(spark)).select("id", "file", "code", "probability", "type", "strategy")


@query(f"""WITH RECURSIVE {_RANKS}, {_CLS}, pc AS (SELECT list(DISTINCT code) AS codes FROM {I.ERRORS.sql()}), er AS (SELECT *, CASE WHEN co_codes IS NULL THEN 0 ELSE len(list_filter(co_codes, lambda c: list_contains(codes, c))) END AS co_count, origin IS NULL OR origin = file AS here FROM cl, pc),
gr AS (SELECT file, count(*) AS n_errors, min(pos) AS first, max(co_count) AS co, bool_or(probability > 0.5) AS crossed, bool_or(here) AS some_local, bool_and(here) AS all_local, list(DISTINCT origin) FILTER (NOT here) AS origins FROM er GROUP BY file),
og AS (SELECT DISTINCT origin AS file FROM {I.ERRORS.sql()} WHERE origin <> file),
ow AS (SELECT gr.*, coalesce(rk.depth, 0) AS d, coalesce(rk.n_dependents = 0, false) AS is_root, coalesce(rk.n_dependencies = 0, true) AS is_leaf, coalesce(rk.n_dependents >= 3, false) AS is_hub, coalesce(rk.n_dependents, 0) AS nd, coalesce(rk.n_transitive, 0) AS nt,
  gr.file IN (SELECT file FROM og) AS is_origin, coalesce(len(origins) = 1 AND origins[1] IN (SELECT file FROM gr), false) AS auto_resolved FROM gr LEFT JOIN rk ON rk.node = gr.file),
sc AS (SELECT *, CASE WHEN crossed THEN d * 30 ELSE 0 END - CASE WHEN co >= 2 THEN 25 ELSE 0 END - CASE WHEN is_hub AND some_local THEN 10 + least(CASE WHEN nt > 0 THEN nt ELSE nd END, 20) ELSE 0 END - CASE WHEN is_leaf AND all_local THEN 30 ELSE 0 END
  + CASE WHEN is_hub AND crossed THEN 50 ELSE 0 END + CASE WHEN n_errors > 10 THEN 15 ELSE 0 END AS score, CASE WHEN is_origin OR (is_hub AND some_local) OR co >= 2 OR (is_root AND nd > 0) THEN 'queue1' ELSE 'queue2' END AS queue FROM ow)
SELECT file, n_errors, CAST(score AS BIGINT) AS score, queue, auto_resolved, row_number() OVER (PARTITION BY queue ORDER BY score, first) AS nth FROM sc""")
def fix_order(spark, sf_dir):
    return E.fix_order(E.classified(I.ERRORS.df(spark), I.CATALOG.df(spark)), G.ranks(_nodes(spark), I.EDGES.df(spark)))


@query(f"""WITH {_CLS} SELECT file, count(*) AS n, array_to_string(list(coalesce(code, '') || ': ' || message ORDER BY pos)[1:1], chr(10)) || CASE WHEN count(*) > 1 THEN chr(10) || '... and ' || (count(*) - 1) || ' more' ELSE '' END AS shown FROM cl GROUP BY file""")
def error_reports(spark, sf_dir):
    return E.error_report(I.ERRORS.df(spark), 1)


@query(f"SELECT (SELECT count(*) FROM {I.ERRORS.sql()}) AS errors, count(*) FILTER (queue = 'queue1') AS root_cause_groups, count(*) FILTER (queue = 'queue2') AS isolated_groups, count(*) FILTER (auto_resolved) AS auto_resolvable FROM ({_SQL['fix_order']})")
def plan_stats(spark, sf_dir):
    return E.plan_stats(fix_order(spark, sf_dir), I.ERRORS.df(spark))


@query(f"""WITH c AS {I.TREE_CATALOG.sql()}, i AS (SELECT * FROM {I.TREE_IMPORTS.sql()}), e AS (SELECT e.*, c.probability AS p, c.capture, CASE WHEN regexp_matches(message, message_pattern) THEN nullif(regexp_extract(message, message_pattern, 1), '') END AS v, c.checks, c.probabilities, c.traces, c.fix_hint FROM {I.TREE_ERRORS.sql()} e LEFT JOIN c ON c.code = e.code),
s AS (SELECT file, trim(split_part(x, ' as ', 1)) AS symbol, x, dst, external, pos FROM (SELECT file, unnest(symbols) AS x, dst, external, pos FROM i)),
k AS (SELECT e.id, unnest(checks) AS ck, unnest(probabilities) AS np, unnest(traces) AS tr, generate_subscripts(checks, 1) AS nth, file, v FROM e WHERE v IS NOT NULL),
h AS (SELECT *, CASE ck WHEN 'is_imported' THEN EXISTS (SELECT 1 FROM s WHERE s.file = k.file AND s.symbol = k.v AND NOT external) WHEN 'is_local' THEN EXISTS (SELECT 1 FROM {I.TREE_NAMES.sql()} d WHERE d.file = k.file AND d.name = k.v) WHEN 'is_external' THEN EXISTS (SELECT 1 FROM s WHERE s.file = k.file AND external AND contains(s.x, k.v)) ELSE false END AS held FROM k),
w AS (SELECT id, arg_min(ck, nth) AS ck, arg_min(np, nth) AS np, arg_min(tr, nth) AS tr FROM h WHERE held GROUP BY id),
o AS (SELECT e.*, coalesce(w.np, e.p, 0.5) AS probability, coalesce(w.tr, CASE WHEN e.p IS NULL THEN 'unknown' WHEN e.p > 0.5 THEN 'likely_cross_file' ELSE 'likely_local' END) AS type,
  CASE WHEN w.ck = 'is_imported' THEN (SELECT arg_min(dst, pos) FROM s WHERE s.file = e.file AND s.symbol = e.v AND NOT external) END AS start FROM e LEFT JOIN w ON w.id = e.id)
SELECT id, file, code, coalesce(v, '') AS captured, probability, type, coalesce(CASE WHEN start IS NOT NULL THEN coalesce((SELECT arg_min(dst, pos) FROM s WHERE s.file = o.start AND s.symbol = o.v AND NOT external AND dst <> o.file), start) END,
  CASE WHEN p IS NOT NULL AND probability > 0.5 THEN (SELECT arg_min(dst, pos) FROM s WHERE s.file = o.file AND s.symbol = o.v AND NOT external AND dst IS NOT NULL) END) AS origin, fix_hint FROM o""")
def located_errors(spark, sf_dir):
    """Errors with captures, refined by what their file imports and defines, and traced along one more import at most in this example."""
    c = I.TREE_CATALOG.df(spark)
    steps = F.transform(F.arrays_zip("checks", "probabilities", "traces"), lambda x: F.struct(x["checks"].alias("check"), F.lit("symbol").alias("target"), x["probabilities"].alias("probability"), x["traces"].alias("trace")))
    c = c.select("code", "pos", "probability", "message_pattern", F.array("capture").alias("captures"), steps.alias("refinements"), "fix_hint", F.array().cast("array<string>").alias("co_codes"))
    out = E.located(I.TREE_ERRORS.df(spark), c, I.TREE_IMPORTS.df(spark), I.TREE_NAMES.df(spark))
    return out.select("id", "file", "code", F.coalesce(F.try_element_at("captures", F.lit(1))["value"], F.lit("")).alias("captured"), "probability", "type", "origin", "fix_hint")


@query(f"WITH {_OUT}, f AS (SELECT error_code, strategy, min((ts, event_id)) AS first FROM o GROUP BY ALL) SELECT error_code, array_to_string(list(strategy ORDER BY first, strategy), ',') AS strategies FROM f GROUP BY error_code")
def previous_strategies(spark, sf_dir):
    return V.previous_strategies(_outcomes(spark, sf_dir)).withColumn("strategies", F.array_join("strategies", ","))


@query(f"SELECT src AS file, array_to_string(list_sort(list_distinct(flatten(list(symbols)))), ',') AS symbols FROM {I.IMPORTS.sql()} GROUP BY src")
def exported_symbols(spark, sf_dir):
    rows = I.IMPORTS.df(spark).select(F.col("src").alias("file"), "pos", "symbols")
    return G.exported(rows).withColumn("symbols", F.array_join(F.array_sort("symbols"), ","))


@query(rf"""SELECT id, replace(path, '\', '/') AS path, substr(sha256(path), 1, 12) AS hash, floor((1000000 - id * 70000) / 60000.0::DOUBLE + 0.5)::BIGINT || 'm' AS age,
CASE WHEN regexp_matches(path, '\.(js|mjs|cjs|jsx|ts|tsx|mts|cts)$') THEN 'script' WHEN regexp_matches(path, '\.(py|go|rs|java|kt|cs|php|cpp|cc|c|h|hpp)$') THEN 'patterns' END AS analyser FROM {I.PATHS.sql()}""")
def path_accessors(spark, sf_dir):
    p = F.col("path")
    return I.PATHS.df(spark).select("id", X.normal_separators(p).alias("path"), X.short_hash(p).alias("hash"), X.age_in_minutes(F.col("id") * 70000, F.lit(1000000)).alias("age"), G.analyser_of(p).alias("analyser"))


@query(f"""SELECT id, {_PART3.format('a')} >= {_PART3.format('b')} AS enough, {_PART3.format('a')}[1] AS major, coalesce(list_filter([a, b], lambda v: NOT contains(v, '-'))[1], b) AS stable FROM {I.VERSIONS.sql()}""")
def version_accessors(spark, sf_dir):
    return I.VERSIONS.df(spark).select("id", X.satisfies_minimum(F.col("a"), F.col("b")).alias("enough"), X.major_version(F.col("a")).alias("major"), X.latest_stable(F.array("a", "b")).alias("stable"))


@query("SELECT id, coalesce(json_extract_string(a, '$.filepath'), json_extract_string(a, '$.file_path')) AS file FROM (SELECT id, CASE WHEN starts_with(args, '\"') THEN json_extract_string(args, '$') ELSE args END AS a FROM " + I.CALLS.sql() + ")")
def tool_paths(spark, sf_dir):
    return I.CALLS.df(spark).select("id", X.tool_path(F.col("args")).alias("file"))


@query(f"WITH {_TURNS} SELECT session, CAST(max(turn) AS BIGINT) AS turn, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM ag GROUP BY session")
def current_turns(spark, sf_dir):
    return V.current_turns(V.turns(_messages(spark, sf_dir)))


@query(f"""WITH {_TURNS}, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY pos) AS k FROM ag), st AS (SELECT *, n <= 10 OR k = 1 OR k > n - 8 AS stays FROM n),
g AS (SELECT session, count(*) AS c, count(*) FILTER (role = 'tool' AND regexp_matches(content, '(?i)✓|✅|success')) AS y, count(*) FILTER (role = 'tool' AND regexp_matches(content, '(?i)❌|STDERR|Error|FAIL')) AS e FROM st WHERE NOT stays GROUP BY session),
f AS (SELECT session, max(turn) AS turn, min(pos) AS first FROM ag GROUP BY session),
mm AS (SELECT session, first + 0.5::DOUBLE AS pos, 'user' AS role, '[SESSION SUMMARY — updated at turn ' || CAST(turn AS BIGINT) || ']' || chr(10) || 'Messages summarised: ' || c || CASE WHEN y > 0 THEN chr(10) || 'Successful actions: ' || y ELSE '' END || CASE WHEN e > 0 THEN chr(10) || 'Errors met: ' || e ELSE '' END || chr(10) || '[END SUMMARY]' AS content, true AS is_summary FROM g JOIN f USING (session))
SELECT session, pos, role, md5(content) AS digest, is_summary FROM (SELECT session, pos::DOUBLE AS pos, role, content, false AS is_summary FROM st WHERE stays UNION ALL SELECT * FROM mm)""")
def compressed_sessions(spark, sf_dir):
    out = V.compressed(V.turns(_messages(spark, sf_dir)))
    return out.select("session", "pos", "role", F.md5("content").alias("digest"), "is_summary")


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_sort(list_transform(embedding::DOUBLE[], lambda e: abs(e))) AS a FROM embeddings), y AS (SELECT *, a[greatest(1, ceil(len(a) * 0.99::DOUBLE)::BIGINT)] AS t FROM x)
SELECT vec_id, CAST(list_sum(list_transform(v, lambda e: greatest(-127, least(127, CAST(round(e / t * 127) AS BIGINT))))) AS BIGINT) AS checksum FROM y""")
def quantised_vectors(spark, sf_dir):
    q = F.aggregate(X.quantised(F.col("embedding")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", q.alias("checksum"))


@query(f"WITH {_CHUNKS}, n AS (SELECT unnest({T.COLLECTIONS}) AS collection), k AS (SELECT collection, count(*) AS n, count(DISTINCT doc_title) AS documents FROM c GROUP BY collection) SELECT coalesce(n.collection, k.collection) AS collection, coalesce(k.n, 0) AS n, coalesce(documents, 0) AS documents, n.collection IS NOT NULL AS is_default FROM n FULL JOIN k ON k.collection = n.collection")
def collection_info(spark, sf_dir):
    return K.collection_info(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT count(DISTINCT collection) AS collections, count(*) AS chunks, count(DISTINCT doc_title) AS documents, count(*) FILTER (contains(content, '```')) AS with_code, count(*) > 0 AS ready FROM c")
def store_status(spark, sf_dir):
    return K.store_status(_chunks(spark, sf_dir).withColumn("has_code_block", F.contains("content", F.lit("```"))))


@query(f"""WITH {_CLS} SELECT id, CASE WHEN strategy IS NULL THEN 3 WHEN probability > 0.7 AND strategy IN ({", ".join(f"'{s}'" for s in T.TIER1)}) THEN 2 WHEN strategy IN ({", ".join(f"'{s}'" for s in T.TIER1)}) THEN 1
WHEN strategy IN ({", ".join(f"'{s}'" for s in T.TIER2)}) THEN 2 ELSE 3 END AS tier FROM cl""")
def fix_tiers(spark, sf_dir):
    none = spark.createDataFrame([], "language string, error_code string")
    return H.planned(E.classified(I.ERRORS.df(spark), I.CATALOG.df(spark)), none).select("id", "tier")


@query(f"""WITH p AS (SELECT *, string_split(content, chr(10)) AS l FROM {I.PATCHES.sql()})
SELECT id, CASE WHEN kind = 'content' THEN new WHEN kind = 'insert' THEN array_to_string(list_concat(list_concat(l[1:greatest(line, 1) - 1], [new]), l[greatest(line, 1):]), chr(10))
WHEN kind = 'delete' AND line BETWEEN 1 AND len(l) THEN array_to_string(list_concat(l[1:line - 1], l[line + 1:]), chr(10))
WHEN kind = 'replace' AND line BETWEEN 1 AND len(l) THEN array_to_string(list_concat(list_concat(l[1:line - 1], [CASE WHEN contains(l[line], old) THEN concat(split_part(l[line], old, 1), new, substr(l[line], length(split_part(l[line], old, 1)) + length(old) + 1)) ELSE new END]), l[line + 1:]), chr(10)) END AS patched FROM p""")
def apply_patches(spark, sf_dir):
    p = I.PATCHES.df(spark).withColumn("line", F.col("line").cast("int"))
    return p.select("id", H.patched(F.col("content"), F.col("kind"), F.col("line"), F.col("old"), F.col("new")).alias("patched"))


@query()
def deterministic_fixes(spark, sf_dir):
    return A.certain(I.FAULTS.df(spark), I.TEXTS.df(spark), I.SYMBOLS.df(spark))


@query()
def heuristic_candidates(spark, sf_dir):
    return A.choices(I.FAULTS.df(spark), I.TEXTS.df(spark))


@query(f"""WITH b AS (SELECT file, length(replace(content, '}}', '')) - length(replace(content, '{{', '')) AS off FROM {I.TEXTS.sql()})
SELECT file, off = 0 AS passed, CASE WHEN off = 0 THEN 'basic structure valid' ELSE 'unbalanced braces: ' || off END AS evidence, CASE WHEN off = 0 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM b""")
def verified_texts(spark, sf_dir):
    return A.checked(I.TEXTS.df(spark))


_NEAR = "(SELECT coalesce(string_agg(x, ',' ORDER BY p, x), '') FROM (SELECT {1} AS x, min(pos) AS p FROM {2} v WHERE {0} = e.file GROUP BY {1} ORDER BY p, x LIMIT 5))"


@query(f"""WITH d AS (SELECT dst AS node, count(DISTINCT src) AS n FROM {I.EDGES.sql()} GROUP BY dst), a AS (SELECT src AS node FROM {I.EDGES.sql()} UNION SELECT dst FROM {I.EDGES.sql()})
SELECT e.id, CASE WHEN n > 5 THEN 'HIGH' WHEN n > 2 THEN 'MEDIUM' WHEN a.node IS NOT NULL THEN 'LOW' ELSE 'UNKNOWN' END AS risk, {_NEAR.format("src", "dst", I.EDGES.sql())} AS dependencies, {_NEAR.format("dst", "src", I.EDGES.sql())} AS dependents
FROM {I.ERRORS.sql()} e LEFT JOIN a ON a.node = e.file LEFT JOIN d ON d.node = e.file""")
def complex_context(spark, sf_dir):
    out = A.neighbourhood(I.ERRORS.df(spark), I.EDGES.df(spark), G.ranks(_nodes(spark), I.EDGES.df(spark)))
    return out.withColumns({c: F.array_join(c, ",") for c in ("dependencies", "dependents")})


@query()
def fix_recipes(spark, sf_dir):
    return A.recipes(I.RECIPES.df(spark))


@query()
def test_cases(spark, sf_dir):
    return N.cases(I.CALLABLES.df(spark), I.CLASSES.df(spark))


@query()
def test_files(spark, sf_dir):
    rows = N.cases(I.CALLABLES.df(spark), I.CLASSES.df(spark))
    return N.python_files(rows).unionByName(N.javascript_files(rows)).unionByName(N.generic_files(rows.where("language not in ('python', 'typescript')")))


_MOCK = "CASE " + " ".join("WHEN language = '{}' AND regexp_matches(lower(module), '{}') THEN '{}'".format(k, p, v.replace("'", "''")) for k, rules in C.MOCKS.items() for p, _, v in rules) + " END"
_MOCK_KIND = "CASE " + " ".join(f"WHEN language = '{k}' AND regexp_matches(lower(module), '{p}') THEN '{kind}'" for k, rules in C.MOCKS.items() for p, kind, _ in rules) + " END"


@query(f"SELECT id, language, module, {_MOCK_KIND} AS kind, {_MOCK} AS value FROM {I.NEEDS.sql()}")
def module_mocks(spark, sf_dir):
    return N.mocks(I.NEEDS.df(spark))




@query(f"SELECT id, CASE WHEN {_PART3.format('a')} > {_PART3.format('b')} THEN 1 WHEN {_PART3.format('a')} < {_PART3.format('b')} THEN -1 ELSE 0 END AS compared FROM {I.VERSIONS.sql()}")
def semver_compare(spark, sf_dir):
    a, b = X.semver(F.col("a")), X.semver(F.col("b"))
    return I.VERSIONS.df(spark).select("id", F.when(a > b, 1).when(a < b, -1).otherwise(0).alias("compared"))


@query("""WITH v AS (SELECT p_partkey AS id, 'v' || (p_partkey % 5) || '.' || (p_size % 11) || '.' || (p_partkey % 3) AS a, (p_size % 5) || '.' || (p_partkey % 11) AS b, [p_partkey % 5, p_size % 11, p_partkey % 3] AS x, [p_size % 5, p_partkey % 11, 0] AS y FROM part)
SELECT id, CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END AS compared FROM v""")
def part_versions(spark, sf_dir):
    """Versions made of the numbers of parts, in two spellings, compared."""
    n = lambda c, k: F.expr(f"cast({c} % {k} as string)")
    a, b = F.concat(F.lit("v"), n("p_partkey", 5), F.lit("."), n("p_size", 11), F.lit("."), n("p_partkey", 3)), F.concat(n("p_size", 5), F.lit("."), n("p_partkey", 11))
    x, y = X.semver(a), X.semver(b)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(x > y, 1).when(x < y, -1).otherwise(0).alias("compared"))


_NOW = 160_000_000


@query(f"""WITH c AS (SELECT registry, package, arg_max(version, ts) AS v FROM {I.CACHE.sql()} WHERE {_NOW} - ts <= 86400000 GROUP BY ALL)
SELECT w.registry, w.package, coalesce(c.v, f.version) AS version, CASE WHEN c.v IS NOT NULL THEN 'cache' WHEN f.version IS NOT NULL THEN 'fallback' ELSE 'unknown' END AS origin
FROM {I.WANTED.sql()} w LEFT JOIN c ON c.registry = w.registry AND c.package = w.package LEFT JOIN {I.SHIPPED.sql()} f ON f.registry = w.registry AND f.package = w.package""")
def version_resolution(spark, sf_dir):
    return R.resolved(I.WANTED.df(spark), I.CACHE.df(spark), I.SHIPPED.df(spark), F.lit(_NOW))


@query(f"SELECT session, topic, max(pos) AS pos FROM {I.TOPICS.sql()} GROUP BY session, topic QUALIFY row_number() OVER (PARTITION BY session ORDER BY max(pos) DESC) <= 3")
def do_not_list(spark, sf_dir):
    return V.do_not_list(I.TOPICS.df(spark))


@query()
def extraction_parse(spark, sf_dir):
    return V.extractions(I.RESPONSES.df(spark))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
