"""Importance resampling towards a target: hashed features of a corpus are weighed by how much commoner they are in the
target, and documents are drawn without replacement by weight plus Gumbel noise.

A feature is a run of words; its bucket is the CRC-32 of its bytes. CRC is linear: what a byte adds depends on the byte
and its distance from the end only. Contributions of all bytes come from one table, are folded by span with an exclusive
or, and a constant of the length is added. Spans longer than the table are folded block by block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE_BYTES, session, stored, texts_of

BUCKETS = 10_000
SIZES = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

#: Bytes of words, A-Z lower-cased; all others end a word.
_LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_b] = _b
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)

# -- CRC-32 of many spans --------------------------------------------------------------------------------------------

#: Distances from the end that the position table has.
BLOCK = 64
_POLY = 0xEDB88320


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLY), t >> np.uint32(1))
    return t


_STEP = _byte_table()


def _zero_byte(r: np.ndarray) -> np.ndarray:
    """A register after one more zero byte."""
    return (r >> np.uint32(8)) ^ _STEP[r & np.uint32(0xFF)]


def _position_table() -> np.ndarray:
    """[distance, byte]: what a byte so far from the end adds."""
    out = [_STEP]
    while len(out) < BLOCK:
        out.append(_zero_byte(out[-1]))
    return np.stack(out)


_PLACE = _position_table()


def _shifted(r: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers after as many zero bytes as a shift table stands for."""
    r = np.asarray(r, np.uint32)
    return table[0][r & np.uint32(0xFF)] ^ table[1][(r >> np.uint32(8)) & np.uint32(0xFF)] ^ table[2][(r >> np.uint32(16)) & np.uint32(0xFF)] ^ table[3][r >> np.uint32(24)]


def _shift_tables() -> list[np.ndarray]:
    """Shift tables of 1, 2, 4, ... zero bytes, for spans of up to 2^40 bytes."""
    one = np.stack([_zero_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
    out = [one]
    for _ in range(40):
        out.append(np.stack([_shifted(row, out[-1]) for row in out[-1]]))
    return out


_SHIFTS = _shift_tables()


def _length_constants(sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of so many zero bytes."""
    r = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        on = (sizes >> k) & 1 == 1
        r[on] = _shifted(r[on], _SHIFTS[k])
    return ~r


_CONSTANTS = _length_constants(np.arange(BLOCK + 1))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each span, one span after the other."""
    ahead = np.cumsum(size) - size
    return np.repeat(start - ahead, size) + np.arange(int(size.sum()))


def _folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the bytes of spans of 1 to BLOCK bytes add."""
    size = end - start
    at = _ranges(start, size)
    return np.bitwise_xor.reduceat(_PLACE[np.repeat(end, size) - 1 - at, data[at]], np.cumsum(size) - size)


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes, each of one byte at least; spans may overlap."""
    if not len(start):
        return np.empty(0, np.uint32)
    size = end - start
    out = np.empty(len(start), np.uint32)
    short = size <= BLOCK
    if short.any():
        out[short] = _folded(data, start[short], end[short]) ^ _CONSTANTS[size[short]]
    if not short.all():
        long = ~short
        s, e = start[long], end[long]
        # blocks are counted from the end, so that all but the first of a span are full
        n = -(-(e - s) // BLOCK)
        back = np.repeat(n, n) - 1 - _ranges(np.zeros(len(n), np.int64), n)
        to = np.repeat(e, n) - back * BLOCK
        value, level = _folded(data, np.maximum(to - BLOCK, np.repeat(s, n)), to), BLOCK.bit_length() - 1
        while n.max() > 1:
            # neighbours are joined from the end on; a first block without one stays as it is
            first, half = np.cumsum(n) - n, (n + 1) // 2
            left = np.repeat(n, half) - 2 - 2 * (np.repeat(half, half) - 1 - _ranges(np.zeros(len(half), np.int64), half))
            base = np.repeat(first, half)
            value = np.where(left >= 0, _shifted(value[base + np.maximum(left, 0)], _SHIFTS[level]), np.uint32(0)) ^ value[base + left + 1]
            n, level = half, level + 1
        out[long] = value ^ _length_constants(e - s)
    return out


# -- features --------------------------------------------------------------------------------------------------------


def _cuts(data: bytes) -> list[bytes]:
    """A text in blocks that end where no word does."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        while to < len(data) and _LOWER[data[to]]:
            to += 1
        out.append(data[at:to])
        at = to
    return out


def _block(parts: list[bytes], sizes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of texts: the words of each, and text and CRC-32 of each feature; last the words that a feature of the next block may begin with."""
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    low = _LOWER[data]
    word = low > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    began, ended = edge[::2], edge[1::2]
    offset = np.cumsum([0, *(len(p) + 1 for p in parts)])
    owner = np.searchsorted(offset, began, "right") - 1
    # words joined by one space each: a feature is one stretch of bytes
    keep = word.copy()
    keep[ended[ended < len(data)]] = True
    joined = np.where(word, low, np.uint8(0x20))[keep]
    size = ended - began
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    owners, values = [], []
    for k in range(min(sizes, len(start))):
        same = owner[: len(owner) - k] == owner[k:]
        owners.append(owner[: len(owner) - k][same])
        values.append(span_crc32(joined, start[: len(start) - k][same], end[k:][same]))
    tail = joined[start[-(sizes - 1)] if len(start) >= sizes - 1 else 0 :].tobytes() if sizes > 1 and len(start) else b""
    words = np.bincount(owner, minlength=len(parts)) if len(owner) else np.zeros(len(parts), np.int64)
    none = np.empty(0, np.int64)
    return words, np.concatenate(owners) if owners else none, np.concatenate(values) if values else none.astype(np.uint32), tail


def hashed_features(texts: list[bytes | None], sizes: int = SIZES):
    """Yields (first text, words of each text, text of each feature, CRC-32 of each feature) of blocks of texts, in order.

    Texts count from the first of their block. A long text is cut; its blocks come one after the other as blocks of one
    text, and features that reach over a cut are in the later one.
    """
    i = 0
    while i < len(texts):
        own = texts[i] or b""
        if len(own) > SLICE_BYTES:
            tail = b""
            for part in _cuts(own):
                words, owner, value, last = _block([tail + b" " + part], sizes)
                if tail:
                    old, _, known, _ = _block([tail], sizes)
                    words = words - old
                    # features of the words carried over have been given
                    first = _first_features(int(old[0]), int(words[0] + old[0]), sizes)
                    owner, value = owner[first], value[first]
                yield i, words, owner, value
                tail = last
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j] or b"") <= SLICE_BYTES:
            size += len(texts[j] or b"") + 1
            j += 1
        yield i, *_block([x or b"" for x in texts[i:j]], sizes)[:3]
        i = j


def _first_features(old: int, words: int, sizes: int) -> np.ndarray:
    """Which features of one text of so many words, in the order that `_block` gives, are not within its first `old` words."""
    keep = [np.arange(words - k) + k >= old for k in range(min(sizes, words))]
    return np.concatenate(keep) if keep else np.empty(0, bool)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, sizes: int = SIZES) -> np.ndarray:
    """Features of all texts by bucket. Tasks count for themselves; the driver gets as many numbers as there are buckets."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, value in hashed_features(texts_of(b.column(0)), sizes):
                total += np.bincount(value.astype(np.int64) % buckets, minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(on, pa.int32()), "n": pa.array(total[on], pa.int64())})

    session(docs)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much commoner each bucket is in the target, each bucket counted once more."""
    n = len(corpus)
    s, t = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", sizes: int = SIZES) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    import pyarrow as pa

    schema = f"id {dict(docs.dtypes)[id_col]}, n_words long, n_features long, weight long"

    def run(batches):
        for b in batches:
            n = b.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for first, own, owner, value in hashed_features(texts_of(b.column(1)), sizes):
                words[first : first + len(own)] += own
                count[first : first + len(own)] += np.bincount(owner, minlength=len(own))
                np.add.at(weight, owner + first, gain[value.astype(np.int64) % len(gain)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight))], ["id", "n_words", "n_features", "weight"])

    session(docs)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, sizes: int = SIZES, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null where a row isn't drawn.

    Features are all runs of 1 to `sizes` words, repeats counted. Of the rows with `least_words` words at least, the given
    part with the highest scores is drawn, rounded down; ties go to the smaller id, null ids last. A null or empty text
    has no features and a weight of 0. Rows that repeat an id have the same noise, each a rank of its own. Long texts are
    hashed whole, block by block. With an empty target, all buckets are as common there as each other. An empty table
    gives an empty one. Extra columns are not read. The sort is spread over ranges of the score; a rank is the row's place
    in its range after all rows of the ranges before.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, sizes), bucket_counts(target, target_text, buckets, sizes))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = weighed(docs, gain, id_col, text_col, sizes)
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0)))))
    # stored before the sort, which reads its rows twice: once to find the ranges
    rows = stored(rows.select("id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("fit")), "weighed")
    placed = stored(rows.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features").withColumn("at", F.monotonically_increasing_id()), "scored")
    part = F.shiftright("at", 33)
    # one row for each range of the sort
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fits"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    counts = counts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("fits").over(whole).alias("fits"))
    found = placed.withColumn("part", part).join(F.broadcast(counts), "part")
    rank = F.col("at") - F.col("first") + F.col("base") + 1
    drawn = F.floor(F.col("fits") * percent / 100)
    return found.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))
