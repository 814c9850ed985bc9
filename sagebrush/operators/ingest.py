"""Ingestion as one plan: files to chunks of a store, with a row of what became of every file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources import web as W
from ..sources.scratch import stored
from . import chunks as C
from . import documents as D
from . import store as K
from . import structure as U

COLUMNS = "path doc_title book_id collection chunk_type summary_level chunk_index total_chunks section_path chapter section content language framework content_type doc_type has_code_block".split()


def detected(files: DataFrame, collection: str | None = None) -> DataFrame:
    """files (path, content) with format, language, the collection they go to, and an error where nothing can be read."""
    path = F.col("path")
    language = X.language_of(path)
    where = F.lit(collection) if collection else X.collection_of(path, language)
    kind = X.format_of(path, F.coalesce("content", F.lit("")))
    error = F.when(F.col("content").isNull(), "no content").when(kind == "pdf", "no reader for pdf")
    return files.select("path", "content", kind.alias("format"), language.alias("language"), where.alias("collection"), error.alias("error"))


def prose(rows: DataFrame) -> DataFrame:
    """(path, language, collection, format, title, text) of files that are no code: Markdown with clean headings."""
    import pyarrow as pa

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    own = W.short(rows).where("error is null and format <> 'code'")

    def read(batches):
        for b in W.small(batches):
            got = [W.clean(x, 1 << 40)[:2] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[1] for x in got], pa.string()), pa.array([x[0] for x in got], pa.string())], ["path", "title", "text"])

    pages = own.where("format = 'html'").select("path", "content").mapInArrow(read, "path string, title string, text string")
    pages = own.where("format = 'html'").drop("content").join(pages, "path")
    texts = own.where("format <> 'html'")
    markdown = F.col("format") == "markdown"
    title = F.when(markdown, W.markdown_title(F.col("content"), name)).otherwise(W.text_title(F.col("content")))
    body = F.when(markdown, F.col("content")).otherwise(U.over(F.when(~markdown, F.col("content")), U.text_markdown))
    texts = texts.withColumn("title", title).withColumn("text", body).drop("content")
    both = texts.unionByName(pages).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), name))
    clean = lambda t: U.clean_document(U.marked_headings(t)) if t is not None else None
    return both.select("path", "language", "collection", "format", "title", U.over(F.col("text"), clean).alias("text"))


def book_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def chunks(rows: DataFrame, most: int = 512, overlap: int = 80) -> DataFrame:
    """The chunks (COLUMNS) of detected files: details, with their context in front, then summaries of sections and chapters."""
    docs = prose(rows).withColumn("doc_id", F.lit(0).cast("long"))
    keep = ("path", "language", "collection", "title")
    cut = D.chunked(docs, F.col("title"), most, overlap, keep).withColumnRenamed("content", "own")
    # of a chunk only the last sentence goes to the next one
    by = Window.partitionBy("path").orderBy("chunk_index")
    last = F.element_at(F.split(F.trim(F.coalesce("own", F.lit(""))), r"[.!?]\s+"), -1)
    cut = cut.withColumn("last", last).withColumn("before", F.lag("last", 1, "").over(by)).withColumn("total_chunks", F.count("*").over(Window.partitionBy("path")))
    more = F.when((F.length("before") > 20) & (F.length("before") < 200), F.concat(F.lit(" (continues from: "), "before", F.lit(")"))).otherwise("")
    content = F.concat(F.lit("["), F.col("title"), F.lit(" > "), F.col("section_path"), more, F.lit("]\n\n"), F.col("own"))
    parts = F.split("section_path", " > ")
    part = lambda k: D.clean_headings(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    none = lambda kind: F.lit(None).cast(kind)
    described = {"framework": X.framework_of(F.col("path")), "content_type": X.content_type(F.col("own")), "doc_type": X.doc_type(F.col("own")), "has_code_block": F.contains("own", F.lit("```"))}
    detail = cut.withColumns({"content": content, "doc_title": F.col("title"), "book_id": book_id(F.col("path")), "chunk_type": F.lit("detail"), "summary_level": none("string"), "chapter": part(1), "section": part(2), **described})
    groups = K.group_summaries(detail.withColumn("id", F.col("chunk_index")), keys=("path", "doc_title", "book_id", "collection"))
    levels, name = F.split("group_path", " > "), F.element_at(F.split("group_path", " > "), -1)
    chapter_level = F.col("kind") == "chapter"
    head = F.concat(F.when(chapter_level, "[Chapter Summary: ").otherwise("[Section Summary: "), name, F.lit("]\n\n"), "summary")
    summary = groups.withColumns({
        "content": head, "section_path": F.col("group_path"), "chunk_type": F.lit("summary"), "summary_level": F.col("kind"), "chunk_index": none("long"), "total_chunks": F.col("n"),
        "chapter": F.when(chapter_level, name).otherwise(F.coalesce(F.get(levels, F.lit(1)), F.lit(""))), "section": F.when(chapter_level, "").otherwise(name),
        "language": none("string"), "framework": none("string"), "content_type": none("string"), "doc_type": none("string"), "has_code_block": F.contains("summary", F.lit("```")),
    })
    code = D.split_code(rows.where("error is null and format = 'code'")).join(rows.select("path", "language", "collection"), "path")
    code = code.withColumns({
        "doc_title": F.regexp_extract("path", r"([^/]*)$", 1), "book_id": book_id(F.col("path")), "chunk_type": none("string"), "summary_level": none("string"), "chunk_index": F.col("nth"),
        "total_chunks": F.count("*").over(Window.partitionBy("path")), "section_path": F.col("name"), "chapter": F.lit(""), "section": F.lit(""),
        "framework": X.framework_of(F.col("path")), "content_type": X.content_type(F.col("content")), "doc_type": X.doc_type(F.col("content")), "has_code_block": F.contains("content", F.lit("```")),
    })
    return detail.select(*COLUMNS).unionByName(summary.select(*COLUMNS)).unionByName(code.select(*COLUMNS))


def outcome(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(path, format, collection, chunks_stored, indexed, error) of every file: its details and summaries, or why it has none."""
    n = made.groupBy("path").agg(F.count("*").alias("n"))
    out = rows.join(n, "path", "left")
    where = F.when(F.col("error").isNull(), F.col("collection"))
    return out.select("path", "format", where.alias("collection"), F.coalesce("n", F.lit(0)).alias("chunks_stored"), F.col("error").isNull().alias("indexed"), "error")


def ingest(files: DataFrame, store: str, collection: str | None = None, most: int = 512, overlap: int = 80) -> DataFrame:
    """Takes the chunks of files (path, content) into a chunk store and gives what became of each file.

    All of it is one new version of the store: the chunks of files that can be read, in place of what the store had of
    their paths. A call that is killed leaves the store as it was; two calls at once both count. A file's chunks are
    numbered in one sort of its path, so a file is the work of one task; files are books and sources, not corpora.
    """
    rows = detected(files, collection)
    made = stored(chunks(rows, most, overlap), "chunks")
    with_ids = made.withColumn("id", C.chunk_id(*map(F.col, ("path", "chunk_type", "summary_level", "section_path", "chunk_index", "content"))))
    C.ChunkStore(files.sparkSession, store).replace(with_ids, rows.where("error is null"))
    return outcome(rows, made)


def reindex(spark: SparkSession, folders: list[str], store: str) -> DataFrame:
    """Ingests all files of several folder trees as one version; gives one row of totals."""
    files = None
    for folder in folders:
        own = W.files(spark, folder)
        files = own if files is None else files.unionByName(own)
    return totals(ingest(files, store))


def ingest_folder(spark: SparkSession, folder: str, store: str, collection: str | None = None) -> DataFrame:
    """Ingests the readable files of a folder tree."""
    return ingest(W.files(spark, folder), store, collection)


def ingest_text(spark: SparkSession, name: str, text: str, store: str, collection: str | None = None) -> DataFrame:
    """Ingests a text that is given, under a name."""
    return ingest(spark.createDataFrame([(name, text)], "path string, content string"), store, collection)


def totals(outcomes: DataFrame) -> DataFrame:
    """One row: files indexed, failed, chunks stored."""
    return outcomes.agg(F.count_if("indexed").alias("indexed"), F.count_if(~F.col("indexed")).alias("failed"), F.coalesce(F.sum("chunks_stored"), F.lit(0)).alias("chunks_stored"))
