"""Pages and files as sources."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements and classes that are no content, and what holds it, in order (fixed values).
DROP_TAGS = "script style nav header footer iframe noscript".split()
DROP_CLASSES = "nav menu sidebar ad cookie banner".split()
MAIN_CLASSES = "content post entry".split()
#: Extensions of files that are read, and folders that are not (fixed values).
NOISE = "node_modules|__pycache__|venv|dist|build|target|vendor|coverage|out|bin|obj|tmp|logs"
FILES = r"\.(md|mdx|txt|rst|html|htm|pdf|js|mjs|cjs|ts|tsx|jsx|py|go|rs|java|kt|cs|php|rb|swift|cpp|c|h|css|sh|sql|scala|lua|dart)$"
#: Pages in an Arrow batch, and those that are Python strings at a time: a page may be megabytes.
ARROW_ROWS, PAGES = 256, 32
#: White space and line ends that are taken off a line.
BLANKS = "\t\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.whole, self.main, self.title, self.blocks = [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        drop = tag in DROP_TAGS or any(c in DROP_CLASSES for c in classes)
        main = tag in ("article", "main") or a.get("role") == "main" or any(c in MAIN_CLASSES for c in classes)
        if tag in ("pre", "code") and not any(t in ("pre", "code") for t, *_ in self.stack):
            self.blocks.append([re.search(r"(?:language|lang)-(\w+)", a.get("class") or ""), []])
        if tag not in _VOID:
            self.stack.append((tag, drop, main))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if any(t == "title" for t, *_ in self.stack):
            self.title.append(data)
            return
        if any(d for _, d, _ in self.stack):
            return
        self.whole.append(data)
        if any(m for *_, m in self.stack):
            self.main.append(data)
        if self.blocks and any(t in ("pre", "code") for t, *_ in self.stack):
            self.blocks[-1][1].append(data)


def clean(page: str | None, most: int) -> tuple[str, str, list]:
    """(text, title, code blocks of 21 to 4999 characters, ten at most) of a page; text is cut at `most`."""
    r = _Reader()
    r.feed(page or "")
    r.close()
    one = lambda parts: re.sub(r"\s+", " ", "".join(parts)).strip()
    blocks = [(m[1] if m else "", t[:2000]) for m, t in ((m, "".join(p).strip()) for m, p in r.blocks) if 20 < len(t) < 5000][:10]
    return (one(r.main) or one(r.whole))[:most], one(r.title), [{"language": a, "code": b} for a, b in blocks]


def short(df: DataFrame) -> DataFrame:
    """df, whose session is set to short Arrow batches if it has longer ones."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, ARROW_ROWS)
    return df


def small(batches, most: int = PAGES):
    """Arrow batches in slices of a few rows, so that what is made of a batch stays small however many rows Spark sends."""
    for b in batches:
        for k in range(0, b.num_rows, most):
            yield b.slice(k, most)


def cleaned_pages(pages: DataFrame, most: int = 8000) -> DataFrame:
    """(page_id, url, title, text, code_blocks) in Arrow batches."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("language", pa.string()), ("code", pa.string())]))

    def run(batches):
        for b in small(batches):
            got = [clean(x, most) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[1] for x in got], pa.string()), pa.array([x[0] for x in got], pa.string()), pa.array([x[2] for x in got], kind)], ["page_id", "url", "title", "text", "code_blocks"])

    return short(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, title string, text string, code_blocks array<struct<language:string,code:string>>")


def page_document(pages: DataFrame) -> DataFrame:
    """A Markdown document of each cleaned page: title, source, text, code examples."""
    code = F.transform("code_blocks", lambda b: F.concat(F.lit("```"), b.language, F.lit("\n"), b.code, F.lit("\n```")))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Source: "), "url"), "text", F.when(F.size(code) > 0, F.concat(F.lit("## Code Examples\n\n"), F.array_join(code, "\n\n"))))
    return pages.select("page_id", body.alias("document"))


def files(spark: SparkSession, folder: str, extensions: str = FILES) -> DataFrame:
    """(path, content) of the readable files of a folder tree; hidden files, hidden and noise folders are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # what stands behind the folder, however its URI is written
    inner = F.element_at(F.split("path", re.escape(folder.rstrip("/").rsplit(":", 1)[-1].lstrip("/")) + "/", 2), -1)
    keep = ~inner.rlike(rf"(^|/)(\.[^/]+|({NOISE})/)") & F.col("path").rlike(rf"(?i){extensions}")
    return rows.where(keep).select("path", F.decode("content", "UTF-8").alias("content"))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Fix outcomes from JSON lines; malformed lines are dropped."""
    schema = "timestamp string, errorCode string, strategy string, language string, file string, passed boolean, confidence double, duration double"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def text_title(content):
    """The first line with something on it, 100 characters at most; null where there is none."""
    line = F.substring_index(F.ltrim(content, F.lit(f"{BLANKS}\n")), "\n", 1)
    return F.nullif(F.substring(F.rtrim(line, F.lit(BLANKS)), 1, 100), F.lit(""))


def markdown_title(content, name):
    found = F.regexp_extract(content, r"(?m)^#\s+(.+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(name, r"\.md$", ""))
