"""Retrieval for many queries at once, over a stored sparse index and vectors.

A query is classified and sent to collections; each collection gives its best chunks by BM25 and by cosine, fused by
rank; the lists are merged, weak queries take in those of their expansions, and the best of all are reranked and made
into a context. Every step is one plan over all queries. What a model does (embedding, reranking, expanding) comes in
as a function over columns or a table, and has a default that needs no model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.scratch import scratch, stored
from ..sources.snapshots import BORN, SEGMENT, Conflict, Manifest, Snapshots, live
from . import search as S
from .vectors import VectorIndex, exact_hits, gathered, ranked

#: Parts of the postings, by hash of the term, in the order of which they are sorted; a search reads those of its terms only.
BUCKETS = 64
#: Terms of queries up to which each task gets all of them.
BROADCAST = 200_000
#: What a query is headed with before it is embedded, by kind; other kinds are general (fixed kinds).
PREFIXED = ("general", "error", "code", "structural")


# -- the sparse index ------------------------------------------------------------------------------------------------


def weighted(chunks: DataFrame, text: str = "content", key: str = "id", collection: str = "collection") -> DataFrame:
    """(collection, term, id, weight, idf): the BM25 vectors of chunks, one row an entry, as a plan."""
    base = chunks.select(F.col(collection).alias("collection"), F.col(key).alias("id"), X.tokens(F.coalesce(text, F.lit(""))).alias("t"))
    tf = S.counted(base, "collection", "id")
    docs = chunks.groupBy(F.col(collection).alias("collection")).agg(F.count("*").alias("n_docs"))
    df = stored(tf.groupBy("collection", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")), "df")
    stats = _averaged(docs.join(df.groupBy("collection").agg(F.sum("n").alias("n_tokens")), "collection", "left"))
    rows = tf.join(df.drop("n"), ["collection", "term"]).join(F.broadcast(stats), "collection")  # a row a collection
    own = S.idf(F.col("n_docs"), F.col("df"))
    return rows.select("collection", "term", "id", (own * S.tf_norm(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("weight"), own.alias("idf"))


def _averaged(stats: DataFrame) -> DataFrame:
    total = F.coalesce("n_tokens", F.lit(0))
    return stats.select("collection", "n_docs", total.alias("n_tokens"), F.when(total == 0, 1.0).otherwise(total / F.col("n_docs")).alias("avg_len"))


class SparseIndex:
    """BM25 of each collection, as a store that grows: inserts and deletes are segments, weights come from merged counts.

    Postings (bucket, collection, term, id, tf, len) say how often a term is in a chunk; counts of terms (df) and of
    collections (n_docs, n_tokens) are sums over segments, those of deletes negative. A chunk's terms are kept with it,
    so that a delete reads the rows of what it deletes, not the postings. Each change is one version of the store.
    """

    POSTINGS, TERMS, STATS, CHUNKS, DELETES = "postings", "terms", "stats", "docs", "deletes"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.tables = spark, Snapshots(spark, path or scratch(spark, "index"))

    # -- changes -------------------------------------------------------------------------------------------------------

    def _write(self, docs: DataFrame, sign: int = 1) -> dict[str, tuple[str, StructType]]:
        """Segments of chunks (collection, id, len, terms) with their counts; for deletes counts alone, negative."""
        df = docs.select("collection", F.explode("terms").alias("term")).groupBy("collection", "term").agg(F.count("*").alias("df"))
        df = df.select(_bucket().alias("bucket"), "collection", "term", (F.col("df") * sign).alias("df"))
        stats = docs.groupBy("collection").agg((F.count("*") * sign).alias("n_docs"), (F.sum("len") * sign).cast("long").alias("n_tokens"))
        return {t: (self.tables.write(d, t), d.schema) for t, d in ((self.TERMS, _dealt(df)), (self.STATS, stats.coalesce(1)))}

    def _added(self, chunks: DataFrame) -> dict[str, tuple[str, StructType]]:
        tokens = chunks.select("collection", F.col("id").cast("long").alias("id"), X.tokens(F.coalesce("content", F.lit(""))).alias("t"))
        docs = tokens.select("collection", "id", F.size("t").alias("len"), F.array_distinct("t").alias("terms"))
        # sorted by id, so that a delete finds its rows by the bounds of row groups
        name = self.tables.write(docs.sortWithinPartitions("id"), self.CHUNKS)
        own = self.spark.read.schema(docs.schema).parquet(f"{self.tables.path}/{self.CHUNKS}/{SEGMENT}={name}")
        tf = S.counted(tokens, "collection", "id")
        rows = _dealt(tf.select(_bucket().alias("bucket"), "collection", "term", "id", F.col("tf").cast("int").alias("tf"), "len"))
        return self._write(own) | {self.CHUNKS: (name, docs.schema), self.POSTINGS: (self.tables.write(rows, self.POSTINGS), rows.schema)}

    def _commit(self, operation: str, parts: list[dict], base: Manifest | None) -> SparseIndex:
        def change(m: Manifest) -> Manifest:
            # what a delete takes off the counts depends on what was there
            if base is not None and (base.segments(self.CHUNKS), base.segments(self.DELETES)) != (m.segments(self.CHUNKS), m.segments(self.DELETES)):
                raise Conflict("the index was changed meanwhile")
            for part in parts:
                for table, (name, schema) in part.items():
                    m = m.with_segment(table, name, schema)
            return m

        self.tables.commit(operation, change)
        return self

    def insert(self, chunks: DataFrame) -> SparseIndex:
        """Adds chunks (id, content, collection) whose ids the index does not have."""
        return self._commit("insert", [self._added(chunks)], None)

    def _gone(self, ids: DataFrame, base: Manifest) -> dict:
        keys = ids.select(F.col("id").cast("long").alias("id")).distinct()
        hit = self._live(self.tables.read(self.CHUNKS, base), base).join(keys, "id", "left_semi")
        return self._write(stored(hit.select("collection", "id", "len", "terms"), "gone"), -1) | {self.DELETES: (self.tables.write(keys, self.DELETES), keys.schema)}

    def delete(self, ids: DataFrame) -> SparseIndex:
        """Takes out the chunks of ids (id); ids that are not there change nothing. Changes by others meanwhile are a `Conflict`."""
        base = self.tables.manifest()
        return self._commit("delete", [self._gone(ids, base)], base) if base.segments(self.CHUNKS) else self

    def replace(self, chunks: DataFrame) -> SparseIndex:
        """Adds chunks in place of those with the same ids, in one version."""
        base = self.tables.manifest()
        if not base.segments(self.CHUNKS):
            return self.insert(chunks)
        return self._commit("replace", [self._gone(chunks, base), self._added(chunks)], base)

    def compact(self, most_segments: int = 8) -> bool:
        """Merges all segments to one a table once there are more of chunks and deletes than that; scores stay as they are."""
        base = self.tables.manifest()
        if len(base.segments(self.CHUNKS)) + len(base.segments(self.DELETES)) <= most_segments:
            return False
        rows = {t: self._live(self.tables.read(t, base), base).drop(SEGMENT, BORN) for t in (self.CHUNKS, self.POSTINGS)}
        rows[self.CHUNKS] = rows[self.CHUNKS].repartitionByRange("id").sortWithinPartitions("id")
        rows[self.POSTINGS] = _dealt(rows[self.POSTINGS])
        rows[self.TERMS] = _dealt(self.tables.read(self.TERMS, base).groupBy("bucket", "collection", "term").agg(F.sum("df").alias("df")).where("df > 0"))
        rows[self.STATS] = self.tables.read(self.STATS, base).groupBy("collection").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")
        new = {t: (self.tables.write(d, t), d.schema) for t, d in rows.items()}

        def change(m: Manifest) -> Manifest:
            if base.tables != m.tables:
                raise Conflict("the index was changed meanwhile")
            for table in (*new, self.DELETES):
                m = m.without(table)
            for table, (name, schema) in new.items():
                m = m.with_segment(table, name, schema)
            return m

        self.tables.commit("compact", change)
        return True

    # -- reading -------------------------------------------------------------------------------------------------------

    def _live(self, rows: DataFrame, m: Manifest) -> DataFrame:
        return live(rows, self.tables.read(self.DELETES, m), "id") if m.segments(self.DELETES) else rows

    def stats(self, m: Manifest | None = None) -> DataFrame:
        """(collection, n_docs, n_tokens, avg_len) of the collections that have chunks."""
        sums = self.tables.read(self.STATS, m).groupBy("collection").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return _averaged(sums.where("n_docs > 0"))

    def search(self, queries: DataFrame, limit: int, flags: DataFrame | None = None) -> DataFrame:
        """(query_id, collection, id, score, rank) of the best chunks of each (query_id, collection, query).

        `flags` (id, only) holds the chunks that count, if not all do; queries with a true column `only` count those that
        have it, too. A query is weighted like a document. Postings are read from the row groups of the terms that are asked.
        """
        m = self.tables.manifest()
        marked = F.coalesce("only", F.lit(False)) if flags is not None and "only" in queries.columns else F.lit(False)
        terms = queries.select("query_id", "collection", marked.alias("only"), X.tokens(F.coalesce("query", F.lit(""))).alias("t"))
        terms = terms.select("query_id", "collection", "only", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("query_id", "collection", "only", "len", "term").agg(F.count("*").alias("n"))
        terms = stored(terms.withColumn("bucket", _bucket()), "terms")
        buckets = [r[0] for r in terms.select("bucket").distinct().collect()]  # BUCKETS at most
        asked = terms.select("bucket", "collection", "term").distinct()
        keys = ["bucket", "collection", "term"]
        df = self.tables.read(self.TERMS, m).where(F.col("bucket").isin(buckets)).join(asked, keys, "left_semi").groupBy(*keys).agg(F.sum("df").alias("df")).where("df > 0")
        stats = self.stats(m)
        own = terms.join(df, keys).join(stats, "collection").withColumn("idf", S.idf(F.col("n_docs"), F.col("df"))).withColumn("tn", S.tf_norm(F.col("n"), F.col("len"), F.col("avg_len")))
        rows = self.tables.read(self.POSTINGS, m).where(F.col("bucket").isin(buckets))
        own = own.select("query_id", *keys, "only", "idf", "tn", "avg_len")
        few = lambda d: F.broadcast(d) if terms.count() <= BROADCAST else d
        # postings of the terms go to their chunks' tasks before queries meet them: a posting is moved once, not once a query
        rows = rows.join(few(asked), keys, "left_semi")
        # deletes and flags meet only what the terms let through
        rows = self._live(rows, m).repartition("id")
        if flags is not None:
            rows = rows.join(flags.select("id", F.col("only").alias("flagged")), "id")
        hits = rows.join(few(own), keys)
        if flags is not None:
            hits = hits.where(~F.col("only") | F.col("flagged"))
        weight = F.col("idf") * S.tf_norm(F.col("tf"), F.col("len"), F.col("avg_len"))
        # equal texts have equal scores to the last bit, in whatever order their postings come
        sums = hits.groupBy("query_id", "collection", "id").agg(F.round(S.exact_sum(weight * F.col("idf") * F.col("tn")), S.TIE).alias("score")).where("score > 0")
        return ranked(sums, limit)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """Files by size, each sorted by bucket and term, so that a search reads the row groups of its terms; a bucket with a very common term is split."""
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "collection", "term")


# -- retrieval -------------------------------------------------------------------------------------------------------


def routed(queries: DataFrame, forced: list[str] | None = None) -> DataFrame:
    """queries (query_id, query, label) with kind, tech, and a row for each collection asked (place: its order)."""
    kind, tech = X.query_class(F.col("query")), X.tech_of(F.col("query"), F.col("label"))
    own = queries.withColumn("kind", kind).withColumn("tech", tech)
    every = F.array(*map(F.lit, forced)) if forced else X.collections_for(F.col("kind"), F.col("tech"))
    return own.select("*", F.posexplode(every).alias("place", "collection"))


def prefix_of(kind: Column, prefixes: dict) -> Column:
    """What a query of a kind is headed with for its embedding; kinds without one of their own are general."""
    own = F.when(kind.isin(*PREFIXED), kind).otherwise("general")
    return X.lookup(own, prefixes)


def hybrid_hits(index: SparseIndex, vectors: DataFrame, queries: DataFrame, limit: int, flags: DataFrame | None = None, near: VectorIndex | None = None) -> DataFrame:
    """(query_id, collection, id, score, rank): dense and sparse candidates of each query and collection, fused by rank.

    Three times the limit (20 at least) of each list; the score is divided by what a row that leads all non-empty lists
    gets; the dense list leads ties. `flags` is as in `SparseIndex.search`. With a vector index, queries that no flags
    bind read that instead of all vectors. Both lists are one stored table before they are fused.
    """
    most = max(3 * limit, 20)
    lists = []
    if flags is None:
        lists.append((0, near.search(queries, most) if near else exact_hits(vectors, queries, most)))
    else:
        lists.append((0, exact_hits(vectors.join(flags, "id"), queries, most, "only")))
    lists.append((1, index.search(queries, most, flags)))
    schema = "query_id long, collection string, id long, rank int, list int"
    both = gathered(queries.sparkSession, (d.select("query_id", "collection", F.col("id").cast("long").alias("id"), "rank", F.lit(k).alias("list")) for k, d in lists), schema, "candidates")
    both = both.withColumn("lists", F.size(F.collect_set("list").over(Window.partitionBy("query_id", "collection"))))
    sums = both.groupBy("query_id", "collection", "id").agg(F.sum(1 / (F.lit(S.RRF_K) + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"), F.max("lists").alias("lists"))
    sums = sums.withColumn("score", F.round(F.col("rrf") / (F.col("lists") / F.lit(S.RRF_K + 1.0)), 12))
    nth = F.row_number().over(Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "first"))
    return sums.select("query_id", "collection", "id", "score", nth.alias("rank")).where(F.col("rank") <= limit)


def hits(index: SparseIndex, vectors: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 20, forced: list[str] | None = None, expansions: DataFrame | None = None, where: Column | None = None, near: VectorIndex | None = None) -> DataFrame:
    """(query_id, nth, collection, id, score): the best 20 chunks of all collections that a query (query_id, query, label, vector) asks.

    Structural queries ask structural chunks only; `where` is a further condition on chunks (scope or project of
    memories, kinds of chunks). Queries with fewer than three scores above 0.6 take in ten hits a collection of each of
    their expansions (query_id, n, query, vector); of a chunk found more than once the first place counts.
    """
    asked = routed(queries, forced).withColumn("only", F.col("kind") == "structural")
    flags = None
    if where is not None or "chunk_type" in chunks.columns:
        only = F.coalesce(F.col("chunk_type") == "structural", F.lit(False)) if "chunk_type" in chunks.columns else F.lit(True)
        flags = (chunks if where is None else chunks.where(where)).select(F.col("id").cast("long").alias("id"), only.alias("only"))

    def found(rows: DataFrame, most: int) -> DataFrame:
        return hybrid_hits(index, vectors, rows, most, flags, near)

    first = found(asked, limit).join(asked.select("query_id", "collection", "place"), ["query_id", "collection"]).withColumn("n", F.lit(0))
    if expansions is not None:
        # read twice: to tell which queries are weak, and as their first list
        first = stored(first, "hits")
        strong = first.groupBy("query_id").agg(F.count_if(F.col("score") > 0.6).alias("strong"))
        weak = asked.drop("query", "vector").join(strong, "query_id", "left").where(F.coalesce("strong", F.lit(0)) < 3)
        # each expansion is a query of its own on the way
        own = weak.join(expansions.select("query_id", "n", "query", "vector"), "query_id")
        key = F.xxhash64("query_id", "n")
        more = own.withColumn("only", F.lit(False))
        got = found(more.withColumn("query_id", key), 10)
        back = own.select(key.alias("key"), "query_id", "n", "collection", "place").distinct()
        more = got.withColumnRenamed("query_id", "key").join(back, ["key", "collection"]).drop("key")
        every = gathered(queries.sparkSession, (first, more.select(*first.columns)), first.schema, "hits")
        # the first list counts by score and then by place, those of expansions by their order
        order = Window.partitionBy("query_id", "id").orderBy("n", F.when(F.col("n") == 0, -F.col("score")), "place", "rank")
        first = every.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "n", "place", "rank"))
    return first.withColumn("nth", nth).where("nth <= 20").select("query_id", F.col("nth").cast("long").alias("nth"), "collection", "id", "score")


def contexts(found: DataFrame, chunks: DataFrame, queries: DataFrame, rerank: Callable[[Column, Column], Column] | None = None, most: int = 5, least: float = 0.5) -> DataFrame:
    """(query_id, n, formatted): the context of each query that has hits (query_id, nth, collection, id, score)."""
    own = chunks.select("id", "content", "doc_title", F.element_at(F.split("section_path", " > "), -1).alias("section"), *(["chunk_type"] if "chunk_type" in chunks.columns else [F.lit("detail").alias("chunk_type")]))
    rows = found.join(own, "id").join(queries.select("query_id", "query"), "query_id").withColumn("pos", F.col("nth"))
    if rerank is not None:
        rows = rows.withColumn("rerank", rerank(F.col("query"), F.col("content")))
    return S.assembled(rows.drop("nth", "collection"), F.col("query"), least, most)


def result_rows(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, text, source, score, collection) as a client expects them: scores of three decimals, `?` for no source."""
    rows = found.join(chunks.select("id", "content", "doc_title"), "id", "left")
    return rows.select("query_id", F.col("nth").alias("rank"), F.coalesce("content", F.lit("")).alias("text"), F.coalesce("doc_title", F.lit("?")).alias("source"), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score"), F.coalesce("collection", F.lit("")).alias("collection"))


def memory_filter(scope: str | None = None, project: str | None = None) -> Column:
    """The condition on chunks that are memories, of a scope or a project if given."""
    out = F.col("chunk_type") == "memory"
    for name, value in (("scope", scope), ("project", project)):
        if value:
            out = out & (F.col(name) == F.lit(value))
    return out


# -- what models do, without one -------------------------------------------------------------------------------------


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A vector of a text by signed hashes of its words, of length 1; a text without words has a vector of zeros."""
    words = F.transform(X.tokens(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    place, sign = (lambda h: F.pmod(h, F.lit(dim))), (lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    start = F.array_repeat(F.lit(0.0), dim)
    # one fold over the words; a vector has few places, each word changes one
    total = F.aggregate(words, start, lambda a, h: F.transform(a, lambda x, i: F.when(i == place(h), x + sign(h)).otherwise(x)))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(total), lambda a: F.transform(a, lambda x: x / F.when(norm(a) == 0, 1.0).otherwise(norm(a))))[0]


def overlap_rerank(query: Column, content: Column) -> Column:
    """The share of a query's words that a text holds: an order where no cross-encoder is at hand."""
    own = X.token_set(F.coalesce(query, F.lit("")))
    return F.size(F.array_intersect(own, X.token_set(F.coalesce(content, F.lit(""))))) / F.greatest(F.size(own), F.lit(1))
