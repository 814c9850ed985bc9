"""BM25, exact cosine, rank fusion and what follows a search.

Corpus statistics come from the table at query time. A query needs the statistics of its own few terms only, so the
scan counts those in place: nothing is exploded, and what is aggregated is one row of sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.scratch import stored

K1, B, RRF_K = 1.2, 0.75, 60
#: Decimals of a score; what differs further on is the order of a sum, and ties go by id.
TIE = 9


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, df, tf): in how many documents a term is, and how often."""
    terms = docs.select(key, F.explode(X.tokens(F.coalesce(text, F.lit("")))).alias("term"))
    # counted by document first: the second step then counts rows
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, n_tokens, avg_len); empty documents count."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(X.tokens(F.coalesce(text, F.lit(""))))), F.lit(0)).alias("n_tokens")).withColumn(
        "avg_len", F.when((F.col("n_docs") == 0) | (F.col("n_tokens") == 0), 1.0).otherwise(F.col("n_tokens") / F.col("n_docs"))
    )


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def tf_norm(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def exact_sum(x: Column) -> Column:
    """The sum of numbers of 0 or more, the same in any order: whole units of 2^-20, and what each has left in units of 2^-62, are summed apart as long values."""
    units = F.floor(x * 2.0**20)
    rest = F.floor((x * 2.0**20 - units) * 2.0**42)
    return (F.sum(units) + F.sum(rest) / 2.0**42) / 2.0**20


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, len, term, tf) of rows (keys, t: tokens). Terms are counted in their text; only where keys are repeated, texts of one length are grouped."""
    own = rows.select(*keys, F.size("t").alias("len"), F.explode(X.term_counts(F.col("t"))).alias("x"))
    own = own.select(*keys, "len", F.col("x.term").alias("term"), F.col("x.n").cast("long").alias("tf"))
    if rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return own
    return own.groupBy(*keys, "len", "term").agg(F.sum("tf").alias("tf"))


def weights(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, term, weight) of every document: the stored form of the sparse index. Rows are shuffled once, to their terms' counts."""
    tf = counted(docs.select(F.col(key), X.tokens(F.coalesce(text, F.lit(""))).alias("t")), key)
    # stored, since it is read for the terms and for the average
    df = stored(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")), "df")
    average = F.when(F.coalesce("n_tokens", F.lit(0)) == 0, 1.0).otherwise(F.col("n_tokens") / F.col("n_docs"))
    stats = df.agg(F.sum("n").alias("n_tokens")).crossJoin(docs.agg(F.count("*").alias("n_docs"))).withColumn("avg_len", average)
    rows = tf.join(df.drop("n"), "term").crossJoin(F.broadcast(stats))  # one row
    return rows.select(key, "term", (idf(F.col("n_docs"), F.col("df")) * tf_norm(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("weight"))


def sparse_search(docs: DataFrame, query_terms: list[str], limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of the best documents: dot product of BM25 vectors; the query is weighted like a document."""
    terms = list(dict.fromkeys(query_terms))

    def count(term: str) -> Column:
        return F.size(F.filter("hits", lambda x: x == term))

    base = docs.select(F.col(key), X.tokens(F.coalesce(text, F.lit(""))).alias("t"))
    # a text is split once; its few hits are counted. No filter on the counts: pushed down, it would split texts again
    base = base.select(key, F.size("t").alias("len"), F.filter("t", lambda x: x.isin(*terms)).alias("hits"))
    base = base.select(key, "len", *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = base.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    average = F.when((F.col("n") == 0) | (F.col("total") == 0), 1.0).otherwise(F.col("total") / F.col("n"))
    rows = base.crossJoin(F.broadcast(stats)).withColumn("avg", average)  # one row of sums
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        w = F.when(F.col(f"df{i}") > 0, idf(F.col("n"), F.col(f"df{i}"))).otherwise(0.0)
        q = tf_norm(F.lit(query_terms.count(t)), F.lit(len(query_terms)), F.col("avg"))
        score = score + w * tf_norm(F.col(f"tf{i}"), F.col("len"), F.col("avg")) * w * q
    return rows.select(key, F.round(score, TIE).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def dense_search(vectors: DataFrame, query: list[float], limit: int, where: dict | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the nearest vectors by cosine, exactly; `where` holds equalities."""
    rows = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), (where or {}).items(), vectors)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(key), F.round(X.cosine(F.col(vector), q), TIE).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def fused(lists: list[DataFrame], limit: int, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists, divided by what one that leads every non-empty list gets.

    Ties go to the id that comes first when the lists are read one after the other. Lists are top-k, so ranking them
    is the work of one small task.
    """
    ranked = []
    for k, rows in enumerate(lists):
        nth = F.row_number().over(Window.orderBy(F.desc("score"), key))
        ranked.append(rows.select(key, nth.alias("rank"), F.lit(k).alias("list")))
    # counted beside the rows, not in a plan of its own: the searches run once
    every = reduce(DataFrame.unionByName, ranked).withColumn("lists", F.size(F.collect_set("list").over(Window.partitionBy())))
    sums = every.groupBy(key).agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"), F.max("lists").alias("lists"))
    out = sums.select(key, (F.col("rrf") / (F.col("lists") / F.lit(RRF_K + 1.0))).alias("score"), "first")
    return out.orderBy(F.desc("score"), "first").limit(limit).drop("first")


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 20) -> DataFrame:
    """(id, score): dense and sparse candidates (three times the limit, 20 at least), fused; dense leads ties."""
    import re

    own = [x for x in re.split("[^a-z0-9]+", query.lower()) if 2 <= len(x) <= 50]
    most = max(3 * limit, 20)
    dense = dense_search(vectors, vector, most).withColumnRenamed("vec_id", "id")
    sparse = sparse_search(docs, own, most).withColumnRenamed("doc_id", "id") if own else None
    return fused([dense] + ([sparse] if sparse is not None else []), limit)


def boosted(rows: DataFrame, query: str | Column, content: str = "content", least: float = 0.5) -> DataFrame:
    """Adds 0.3 times the share of the query's words (three characters or more) that a text contains; then the threshold."""
    query = F.lit(query) if isinstance(query, str) else query
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)
    text = F.lower(F.coalesce(content, F.lit("")))
    share = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words) * 0.3).otherwise(0.0)
    return rows.withColumn("score", F.coalesce("score", F.lit(0.0)) + share).where(F.col("score") >= least)


def deduped(rows: DataFrame, most: float = 0.8, key: str = "query_id") -> DataFrame:
    """Greedy removal of overlapping texts in the order of `pos`, per query; of two, the higher score keeps the earlier slot.

    A query has few rows (what a search returned), so each is one group; the fold runs in the JVM over a sorted array.
    """
    item = F.struct("pos", "score", "id", X.token_set(F.col("content")).alias("words"))
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    empty = F.filter("rows", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        hit = F.coalesce(F.array_min(F.filter(F.transform(kept, lambda k, i: F.when(X.jaccard(k.words, x.words) > most, i)), lambda i: i.isNotNull())), F.lit(-1))
        swapped = F.transform(kept, lambda k, i: F.when((i == hit) & (x.score > k.score), x).otherwise(k))
        return F.when(hit < 0, F.concat(kept, F.array(x))).otherwise(swapped)

    kept = own.select(key, F.posexplode(F.aggregate("rows", empty, step)).alias("slot", "x"))
    return kept.select(key, "slot", "x.id", "x.score")


def assembled(rows: DataFrame, query: str | Column, least: float = 0.5, most: int = 5, key: str = "query_id") -> DataFrame:
    """(query_id, n, formatted): the best texts that a search returned, as one context per query.

    Rows: query_id, pos, id, score, content, doc_title, section, chunk_type, and rerank where a reranker ran. Words of
    the query in content or section raise a score; texts below the threshold and overlapping ones go; the rest is
    ordered by rerank, else score, and cut at `most`. Several titles are headed each, in the order of their best text.
    Rows are what searches returned, so a query's rows are few. A query whose rows all go has no context.
    """
    ranked = rows if "rerank" in rows.columns else rows.withColumn("rerank", F.lit(None).cast("double"))
    text = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("section", F.lit("")))
    good = boosted(ranked.withColumn("searched", text), query, "searched", least).withColumn("content", F.coalesce("content", F.lit("")))
    # the kept slot may hold another row's text: its score goes along, by id
    kept = deduped(good, key=key).select(key, "slot", "id").join(good.drop("pos", "searched"), [key, "id"])
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.coalesce("rerank", "score")), "slot"))
    top = kept.withColumn("nth", nth).where(F.col("nth") <= most).withColumn("title", F.coalesce("doc_title", F.lit("Unknown")))
    first = F.min("nth").over(Window.partitionBy(key, "title"))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" > "), "section")).otherwise("")
    kind = F.when(F.col("chunk_type") == "structural", " [Structure]").otherwise("")
    tail = F.concat(F.lit("]"), kind, F.lit(" [Score: "), F.format_string("%.2f", F.col("score")), F.lit("]\n\n"), F.trim("content"))
    item = F.struct(first.alias("first"), "nth", "title", F.concat("title", section, tail).alias("body"))
    out = top.select(key, item.alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("rows"), F.count_distinct("x.title").alias("titles"))
    head = lambda r: F.when(r.nth == r.first, F.concat(F.lit('\n── From "'), r.title, F.lit('" ──\n\n---\n\n['), r.body)).otherwise(F.concat(F.lit("["), r.body))
    many = F.array_join(F.transform("rows", head), "\n\n---\n\n")
    one = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("[Source: "), r.body)), "\n\n---\n\n")
    return out.select(key, F.size("rows").cast("long").alias("n"), F.when(F.col("titles") > 1, many).otherwise(one).alias("formatted"))


def expansions(query: Column, answer: Column, most: int = 3) -> Column:
    """The query, then the lines of a model's answer (10 < length < 200, without their numbers), at most three."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\A\d+[.)]\s*", "")))
    return F.concat(F.array(query), F.slice(F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200)), 1, most))
