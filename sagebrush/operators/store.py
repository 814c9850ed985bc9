"""Scans, scopes and statistics of chunks; `chunks` has the store that holds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..functions import text as X

def collection_info(chunks: DataFrame) -> DataFrame:
    """(collection, n, documents, is_default) of the collections that have chunks, and of the defaults that have none."""
    own = chunks.groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("doc_title").alias("documents"))
    every = chunks.sparkSession.createDataFrame([(c,) for c in T.COLLECTIONS], "collection string").withColumn("d", F.lit(True))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(every, "collection", "full").select("collection", none("n"), none("documents"), F.coalesce("d", F.lit(False)).alias("is_default"))


def store_status(chunks: DataFrame) -> DataFrame:
    """One row: collections with chunks, chunks, titles, chunks with code; `ready` where there are any."""
    row = chunks.agg(F.count_distinct("collection").alias("collections"), F.count("*").alias("chunks"), F.count_distinct("doc_title").alias("documents"), F.count_if("has_code_block").alias("with_code"))
    return row.withColumn("ready", F.col("chunks") > 0)


def scroll(chunks: DataFrame, conditions: list[dict], limit: int = 200, sort_by: str | None = None) -> DataFrame:
    """Rows that meet all conditions ({key, value} for equality, {key, text} for all words), sorted, then limited."""

    def one(c):
        if "value" in c:
            return F.col(c["key"]) == F.lit(c["value"])
        words = [w for w in __import__("re").split("[^a-z0-9]+", c["text"].lower()) if w]
        own = X.token_set(F.coalesce(c["key"], F.lit("")))
        return reduce(lambda a, b: a & b, [F.array_contains(own, w) for w in words], F.lit(True))

    rows = reduce(lambda d, c: d.where(one(c)), conditions, chunks)
    return rows.orderBy(*([F.coalesce(sort_by, F.lit(0))] if sort_by else []), "id").limit(limit)


def deleted(chunks: DataFrame, words: str) -> DataFrame:
    """What is left after rows go whose title or book holds the words."""
    own = [w for w in words.lower().split() if w]
    hit = lambda c: reduce(lambda a, b: a & b, [F.array_contains(X.token_set(F.coalesce(c, F.lit(""))), w) for w in own], F.lit(True))
    return chunks.where(~(hit("doc_title") | hit("book_id")))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """(collection, n) with a row for every default collection."""
    every = chunks.sparkSession.createDataFrame([(c,) for c in T.COLLECTIONS], "collection string")
    counts = chunks.groupBy("collection").agg(F.count("*").alias("n"))
    return every.join(counts, "collection", "full").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


def sources(chunks: DataFrame) -> DataFrame:
    """(doc_title, book_id, collections, n) by title; the book of the first row."""
    return chunks.groupBy("doc_title").agg(F.min_by("book_id", "id").alias("book_id"), F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections"), F.count("*").alias("n"))


def books(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_title").agg(F.min_by("book_id", "id").alias("book_id"), F.min("id").alias("first_id"))


def scope(chunks: DataFrame, hits: DataFrame, book_hint: str | None = None) -> DataFrame:
    """The one (chapter, book) with the greatest sum of scores of hits (id, score); a title with the hint counts double."""
    boost = F.when(F.contains(F.lower("doc_title"), F.lit(book_hint.lower())), 2.0).otherwise(1.0) if book_hint else F.lit(1.0)
    sums = hits.join(chunks, "id").groupBy("chapter", "book_id").agg(F.sum(F.col("score") * boost).alias("section_score"), F.min("id").alias("first_id"))
    return sums.orderBy(F.desc("section_score"), "first_id").limit(1)


def scope_rows(chunks: DataFrame, found: DataFrame, details: int = 25) -> DataFrame:
    """The chunks of a scope in reading order, with scores that fall by a thousandth."""
    rows = chunks.join(F.broadcast(found.select("chapter", "book_id")), ["chapter", "book_id"])  # one row
    top = rows.orderBy(F.coalesce("chunk_index", F.lit(0)), "id").limit(details)
    nth = F.row_number().over(Window.orderBy(F.coalesce("chunk_index", F.lit(0)), "id"))
    return top.select("id", "chapter", "book_id", (1 - (nth - 1) * 0.001).alias("score"))


def scope_result(rows: DataFrame, details: int = 25) -> DataFrame:
    """(nth, id, content, score): what is shown of a scope, from the book that has the most of its chunks.

    Rows: id, pos (order of retrieval), doc_title, section_path, chunk_type, chunk_index, content. Chunks that are no
    summaries come in reading order; beyond `details` of them, summaries of sections that those shown don't cover
    follow. Scores fall by a thousandth. A retrieved scope is bounded by its scan, so ranking it is one small task.
    """
    own = rows.withColumn("doc_title", F.coalesce("doc_title", F.lit("Unknown"))).withColumn("at", F.coalesce("chunk_index", F.lit(0)))
    book = own.groupBy("doc_title").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    own = own.join(F.broadcast(book.select("doc_title")), "doc_title")  # one row
    own = own.withColumn("path", F.coalesce("section_path", F.lit("\0"))).withColumn("part", F.when(F.col("chunk_type") == "summary", 1).otherwise(0))
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("at", "pos"))).withColumn("n", F.sum(1 - F.col("part")).over(Window.partitionBy()))
    shown = own.where((F.col("part") == 0) & (F.col("k") <= details))
    more = own.where((F.col("part") == 1) & (F.col("n") > details)).join(shown.select("path").distinct(), "path", "left_anti")
    out = shown.select("part", "k", "id", "content").unionByName(more.select("part", "k", "id", "content"))
    nth = F.row_number().over(Window.orderBy("part", "k"))
    return out.select(nth.cast("long").alias("nth"), "id", "content", (1 - (nth - 1) * 0.001).alias("score"))


def other_books(rows: DataFrame) -> DataFrame:
    """(doc_title, n) of the books a scope was found in but for the one shown, those with the most chunks first (nth)."""
    books = rows.groupBy(F.coalesce("doc_title", F.lit("Unknown")).alias("doc_title")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    nth = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1
    return books.withColumn("nth", nth.cast("long")).where("nth > 0").select("nth", "doc_title", "n")


def code_examples(hits: DataFrame) -> DataFrame:
    """(nth, doc_title, id, shown): hits that have code, by book in the order of retrieval, each book in reading order.

    Hits: id, pos, doc_title, section_path, chunk_index, content. A chunk is headed by the last part of its path.
    """
    own = hits.where(F.contains("content", F.lit("```"))).withColumn("doc_title", F.coalesce("doc_title", F.lit("Unknown")))
    own = own.withColumn("first", F.min("pos").over(Window.partitionBy("doc_title")))
    nth = F.row_number().over(Window.orderBy("first", "doc_title", F.coalesce("chunk_index", F.lit(0)), "pos"))
    section = F.when(F.col("section_path") != "", F.concat(F.lit(" ("), F.element_at(F.split("section_path", " > "), -1), F.lit(")"))).otherwise("")
    return own.select(nth.cast("long").alias("nth"), "doc_title", "id", F.concat(section, F.lit("\n"), "content").alias("shown"))


def group_summaries(chunks: DataFrame, separator: str = " > ", most: int = 8000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Section (three levels, three chunks or more) and chapter (two levels, five or more) groups in one pass over two keys.

    Groups are those of `keys` and a path. A summary is made of the group's first `most` characters. The rows that give them are found by a running length,
    which sorts and spills; a group is never held whole.
    """
    levels = F.split("section_path", separator)
    key = lambda k: F.array_join(F.slice(levels, 1, k), separator)
    groups = F.array(F.struct(F.lit("section").alias("kind"), key(3).alias("group_path"), F.lit(3).alias("least")), F.struct(F.lit("chapter").alias("kind"), key(2).alias("group_path"), F.lit(5).alias("least")))
    both = chunks.select(*keys, "id", F.substring("content", 1, most).alias("c"), F.explode(groups).alias("g"), F.size(levels).alias("depth"))
    both = both.where("g.kind = 'chapter' or depth >= 2").select(*keys, "id", "c", "g.*")
    by = Window.partitionBy(*keys, "kind", "group_path", "least").orderBy("id")
    before = F.sum(F.length("c") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1))
    counts = both.groupBy(*keys, "kind", "group_path", "least").agg(F.count("*").alias("n")).where("n >= least")
    head = both.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    out = head.groupBy(*keys, "kind", "group_path", "least").agg(F.array_sort(F.collect_list(F.struct("id", "c"))).alias("rows")).join(counts, [*keys, "kind", "group_path", "least"])
    text = F.substring(F.array_join(F.transform("rows", lambda r: r.c), "\n\n"), 1, most)
    words = F.split(F.trim(text), r"\s+")
    short = F.when(F.size(words) > 200, F.concat(F.array_join(F.slice(words, 1, 200), " "), F.lit("..."))).otherwise(F.array_join(words, " "))
    return out.select(*keys, "kind", "group_path", "n", short.alias("summary"))
