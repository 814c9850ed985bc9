"""Shared pieces of the training-data operators: row keys, file systems, hashing of words, components."""

from __future__ import annotations

import posixpath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..sources.scratch import drop, scratch, shared_dir, stored  # noqa: F401

#: Bytes that end a word: space and \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch. Documents vary from one word to megabytes, so batches stay short.
ARROW_ROWS = 512
#: Bytes of text hashed at once.
SLICE_BYTES = 1 << 18

U64 = np.uint64


def session(df: DataFrame) -> SparkSession:
    """The session of a DataFrame, set to short Arrow batches; its Python workers get this package."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.sparkSession


def open_fs(uri: str):
    """pyarrow's file system and path of a URI; it serves file, hdfs, s3 and gs alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def join_path(base: str, *parts: str) -> str:
    return posixpath.join(base, *parts)


def keyed(docs: DataFrame, key: str = "_row_key", id_col: str = "doc_id") -> DataFrame:
    """docs with a key of each row's own, in the order of its id, null ids last.

    The key is the id itself where ids are whole numbers, none null and none repeated. Otherwise rows are sorted by id
    (and by hash, so that many rows of one id are no hot task) and numbered.
    """
    ids = docs.groupBy(F.col(id_col).alias("_row_id")).agg(F.count("*").alias("_row_n")).where("_row_n > 1")
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    if whole and docs.where(F.col(id_col).isNull()).isEmpty() and ids.isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    mix = F.xxhash64(*[F.col(f"`{name}`") for name, kind in docs.dtypes if not kind.startswith("map")])
    return stored(docs.orderBy(F.col(id_col).asc_nulls_last(), mix).withColumn(key, F.monotonically_increasing_id()), "rows")


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


# -- words of whole texts, hashed by columns -------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FOLD = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        have[0] = 1
        have = _powers[key] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + U64(salt)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a block that begins and ends at word bounds."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_IS_WHITE[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), dtype=np.uint64, out=total[1:])
    value = (total[end] - total[start]) * _power(_BASE_INV, len(buf))[start]
    return start, end, mix(value + (end - start).astype(np.uint64))


def _long_text(data: bytes):
    """One long text, block by block; a block ends at white space, so no word is cut."""
    at, starts, ends, values = 0, [], [], []
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        while to < len(data) and not _IS_WHITE[data[to]]:
            to += 1
        s, e, v = _hash_block(data[at:to])
        starts.append(s + at), ends.append(e + at), values.append(v)
        at = to
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(values)


def hashed_words(texts: list[bytes | None]):
    """Yields, for each text in turn, starts, ends (bytes) and 64-bit hashes of its words, A-Z lower-cased."""
    i = 0
    while i < len(texts):
        if len(texts[i] or b"") > SLICE_BYTES:
            yield _long_text(texts[i])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j] or b"") <= SLICE_BYTES:
            size += len(texts[j] or b"") + 1
            j += 1
        own = [x or b"" for x in texts[i:j]]
        start, end, value = _hash_block(b"\n".join(own))
        offset = np.zeros(len(own) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in own], out=offset[1:])
        cut = np.searchsorted(start, offset)
        for k in range(len(own)):
            a, b = cut[k], cut[k + 1]
            yield start[a:b] - offset[k], end[a:b] - offset[k], value[a:b]
        i = j


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; a shorter text is one run, an empty one has none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, size)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out *= _FOLD
        out += words[i : n - k + 1 + i]
    return mix(out, k)


def texts_of(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


# -- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of an edge list, component being the smallest id that can be reached.

    Alternates large-star and small-star steps until all edges are stars around their smallest id; each round is written
    to the shared folder and only whether it is settled comes to the driver. Minima are aggregated before they are
    shuffled, so that a node with many neighbours costs no more than its edges; a join on such a node is split by adaptive
    execution. A round's table goes as soon as the next one is written.
    """
    edges = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    now = stored(edges, "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("y"))
        small = small.where("x <> y").select(F.col("x").alias("lo"), F.col("y").alias("hi")).distinct()
        last, now = now, stored(small, "edges")
        drop(last)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether each id is the greater end of one edge or the smaller end of some, and never both."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select("lo", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below + above > 1").isEmpty()
