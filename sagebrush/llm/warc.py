"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC files, one file a task, each record its own member. The capture index is
sorted by key (reversed host, path, query; then record id) and cut into compressed blocks; the directory keeps each
block's first key, file, offset and length. A lookup searches the directory by bisection, reads one block's range,
searches it by bisection, and reads one record's range of an archive.

Of records with equal payloads of at least `least_bytes` bytes, the one with the largest page_id is a response and the
others are revisits that name it; smaller payloads are responses.

A null html is an empty payload. A null url has the key `-`. Rows with a null page_id are responses and are named by
nobody. Repeated rows are written again and judged alike; of rows that tie for the largest page_id all are responses.
Very long payloads are written and read one record at a time. Extra columns
are ignored. An empty table gives empty archives. Files carry task and attempt in their names and are read only if
their index rows were committed, so lost executors leave nothing wrong behind.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_path, open_fs, scratch, session, stored

BLOCK_ROWS = 1000
LEAST_BYTES, TASK_BYTES = 1 << 18, 64 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, lower case, without scheme, user, default port, fragment and a leading www."""
    if not url:
        return "-"
    try:
        x = urlsplit(url.strip())
        host, port = (x.hostname or "").rstrip("."), x.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    port = f":{port}" if port and port not in (80, 443) else ""
    query = "&".join(sorted(x.query.split("&"))) if x.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(x.path or '/').lower()}{'?' + query.lower() if query else ''}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record with its HTTP head; a revisit has the head only."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean}"] if clean else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Fields of one record (uncompressed): its headers, lower case, and the payload it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(out["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record has a wrong length")
    http, _, payload = body.partition(b"\r\n\r\n")
    out["http-length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out | {"payload": payload}


def _writer(folder: str):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        at = 0
        with fs.open_output_stream(join_path(base, name), compression=None) as out:
            for batch in batches:
                rows = {"key": [], "page_id": [], "file": [], "offset": [], "length": []}
                for x in batch.to_pylist():
                    payload = x["html"] or b""
                    refers = x["last"] if x["revisit"] else None
                    data = gzip_member(record(x["url"], x["page_id"], payload, base32_sha1(payload), refers, x["revisit"]))
                    out.write(data)
                    for k, v in (("key", url_key(x["url"])), ("page_id", x["page_id"]), ("file", name), ("offset", at), ("length", len(data))):
                        rows[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return run


def _line(key: str, page_id, file: str, offset: int, length: int) -> str:
    return f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}"


def _unline(line: str) -> tuple:
    key, page_id, file, offset, length = line.split("\t")
    return key, int(page_id) if page_id else None, file, int(offset), int(length)


def _indexer(folder: str, block_rows: int):
    """Sorted rows into one file of compressed blocks a task; gives the directory."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.idx"
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        held, at, out = [], 0, {"first": [], "file": [], "offset": [], "length": [], "rows": []}
        with fs.open_output_stream(join_path(base, name), compression=None) as file:

            def flush():
                nonlocal at
                data = zlib.compress("\n".join(_line(*x) for x in held).encode(), 6)
                file.write(data)
                for k, v in (("first", held[0][0]), ("file", name), ("offset", at), ("length", len(data)), ("rows", len(held))):
                    out[k].append(v)
                at += len(data)
                held.clear()

            for batch in batches:
                for x in batch.to_pylist():
                    held.append((re.sub(r"[\t\n\r]", " ", x["key"]), x["page_id"], x["file"], x["offset"], x["length"]))
                    if len(held) == block_rows:
                        flush()
            if held:
                flush()
        yield pa.RecordBatch.from_pydict(out, pa.schema([("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("rows", pa.int64())]))

    return run


def _range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as file:
        return file.read_at(length, offset)


def _blocks_read(folder: str):
    def run(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            for x in batch.to_pylist():
                lines = zlib.decompress(_range(fs, join_path(base, x["file"]), x["offset"], x["length"])).decode().split("\n")
                rows = [dict(zip(("key", "page_id", "file", "offset", "length"), _unline(line), strict=True)) for line in lines]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return run


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def _records_read(folder: str):
    """Reads each row's range of its archive; rows come by file and offset, so a file is opened once."""

    def run(batches):
        fs, base = open_fs(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = x["file"], fs.open_input_file(join_path(base, x["file"]))
                got = parse(zlib.decompress(file.read_at(x["length"], x["offset"]), 31))
                digest, payload, kind = got["warc-payload-digest"].removeprefix("sha1:"), got["payload"], got["warc-type"]
                if kind == "response" and (base32_sha1(payload) != digest or len(payload) != got["http-length"]):
                    raise ValueError("a payload is damaged")
                page = got.get("x-page-id")
                refers = got.get("x-refers-to-page-id")
                out.append({"page_id": None if page is None else int(page), "url": got.get("warc-target-uri"), "payload_bytes": got["http-length"], "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else int(refers), "file": name, "offset": x["offset"]})
            kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64()}
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))
        if file is not None:
            file.close()

    return run


def tasks(spark: SparkSession, size: int | None) -> int:
    """Tasks that read so many bytes: two for each core, if they have `LEAST_BYTES` each, and more where they had over `TASK_BYTES`."""
    size, cores = size or 0, 2 * spark.sparkContext.defaultParallelism
    return max(1, min(cores, size // LEAST_BYTES), -(-size // TASK_BYTES))


class Archive:
    """Archives of `size` bytes and their index in the shared folder; `directory` has a row for each index block."""

    def __init__(self, folder: str, directory: DataFrame, size: int):
        self.folder, self.directory, self.size = folder, directory, size

    @staticmethod
    def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, block_rows: int = BLOCK_ROWS) -> Archive:
        spark = session(pages)
        folder = folder or scratch(spark, "warc")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
        # equal payloads: only digests and ids are shuffled; payloads meet the few digests that several pages share
        digest = rows.where("page_id is not null").where(F.length("html") >= least_bytes).groupBy(F.sha1("html").alias("sha1"))
        last = digest.agg(F.max("page_id").alias("last"), F.min("page_id").alias("least")).where("last <> least").select("sha1", "last")
        judged = rows.withColumn("sha1", F.sha1("html")).join(last, "sha1", "left")
        revisit = F.coalesce((F.col("last") != F.col("page_id")) & (F.length("html") >= least_bytes), F.lit(False))
        judged = judged.select("page_id", "url", "html", "last", revisit.alias("revisit"))
        index = stored(judged.mapInArrow(_writer(folder), INDEX), "captures")
        keys, size = index.agg(F.sum(F.length("key") + 32), F.sum("length")).first()
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks(spark, keys))
        order = index.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
        directory = stored(order.mapInArrow(_indexer(folder, block_rows), "first string, file string, offset long, length long, rows long"), "directory")
        drop(index)
        return Archive(folder, directory, size or 0)

    def captures(self) -> DataFrame:
        """All rows of the index, read block by block."""
        spark = session(self.directory)
        n = tasks(spark, self.directory.agg(F.sum("length")).first()[0])
        return self.directory.repartition(n, "file", "offset").mapInArrow(_blocks_read(self.folder), INDEX)

    def records(self, captures: DataFrame, all_bytes: int | None = None) -> DataFrame:
        """What the archives hold for some rows of the index, read by range in the order of the files.

        Ranges of files are dealt out by place, in as many tasks as the bytes of the records need (`all_bytes`, or else
        their sum): index rows are small and would all come to one task.
        """
        spark = session(captures)
        rows = captures.select("file", "offset", "length")
        if all_bytes is None:
            rows = stored(rows, "wanted")
            all_bytes = rows.agg(F.sum("length")).first()[0]
        rows = rows.repartitionByRange(tasks(spark, all_bytes), "file", "offset").sortWithinPartitions("file", "offset")
        return rows.mapInArrow(_records_read(self.folder), RECORD)

    def lookup(self, urls: list[str]) -> DataFrame:
        """Records of some URLs: bisection in the directory, then in the one block (or neighbours) that can hold a key.

        The directory's first keys are searched in blocks of rows on the executors; only the URLs, a query's own
        input, are sent to them.
        """
        keys = sorted({url_key(u) for u in urls})
        spark, folder = session(self.directory), self.folder

        def search(batches):
            fs, base = open_fs(folder)
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    a = bisect.bisect_left(keys, x["first"])
                    b = len(keys) if x["next"] is None else bisect.bisect_right(keys, x["next"])
                    if a >= b:
                        continue
                    lines = zlib.decompress(_range(fs, join_path(base, x["file"]), x["offset"], x["length"])).decode().split("\n")
                    have = [line.partition("\t")[0] for line in lines]
                    for key in keys[a:b]:
                        for k in range(bisect.bisect_left(have, key), bisect.bisect_right(have, key)):
                            out.append(dict(zip(("key", "page_id", "file", "offset", "length"), _unline(lines[k]), strict=True)))
                yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        from pyspark.sql.window import Window

        # one row for each block, a thousandth of the pages; blocks of one index file are neighbours
        ordered = self.directory.withColumn("next", F.lead("first").over(Window.partitionBy("file").orderBy("offset")))
        return self.records(ordered.select("first", "next", "file", "offset", "length").mapInArrow(search, INDEX))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives and index, then reads every record back through the index."""
    archive = Archive.write(pages, None, least_bytes)
    return archive.records(archive.captures(), archive.size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "offset")
