"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's five-word shingles are hashed once; the hash range is cut into bins and the least hash of each bin is
kept. Empty bins borrow from a non-empty bin that a fixed random order of bins picks, each bin having its own order.
Bands of `rows` bins make buckets. In a bucket all members are paired with its least member only (a star), so that
candidates grow with the members and not with their square. Candidates are confirmed on full shingle sets.

Documents with equal sets are merged before banding. A pair that shares a bucket but whose members are, after the
stars, in different groups is searched for by exact prefix filtering, so that a star's centre hides no link.

Nulls and texts without words have an empty set: they keep their own id and are linked with nothing. Repeated rows of
one id give one output row each and share a group. A null id is in no group (component_id null, kept true). Of equal
texts the least id stands for all. Very long texts are read whole, block by block. Extra columns of the input are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, _FOLD, components, drop, hashed_words, mix, session, shingle_hashes, stored, texts_of

#: 40 bands of 5 bins: a pair with a similarity of 0.75 shares no bucket with a chance of 2e-5.
BANDS, ROWS, SHINGLE, PERCENT = 40, 5, 5, 75
#: Shingles before one that are looked at for an earlier meeting of a pair; only repeated work depends on it.
RECENT = 24


def bin_orders(bins: int, seed: int = 11) -> np.ndarray:
    """For each bin, the order in which it asks the others when it is empty."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)


def signature(hashes: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, distinct, non-empty set of hashes."""
    where = ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[where[first]] = hashes[first]
    full[where[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        ask = orders[empty]
        out[empty] = out[ask[np.arange(len(empty)), full[ask].argmax(axis=1)]]
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    own = sig.reshape(bands, rows)
    out = own[:, 0].copy()
    for i in range(1, rows):
        out = out * _FOLD + own[:, i]
    return mix(out + np.arange(bands, dtype=np.uint64) * U64(0x632BE59BD9B4E019), 17)


def _signed(bands: int, rows: int, size: int):
    def run(batches):
        orders = bin_orders(bands * rows)
        for batch in batches:
            n, one, two, out = [], [], [], []
            for _, _, words in hashed_words(texts_of(batch.column(1))):
                found = np.unique(shingle_hashes(words, size))
                n.append(len(found))
                one.append(np.sum(mix(found, 3), dtype=np.uint64))
                two.append(np.sum(mix(found, 5), dtype=np.uint64))
                if len(found):
                    out.append(band_hashes(signature(found, bands * rows, orders), bands, rows))
            ends = np.cumsum([0, *(bands if x else 0 for x in n)]).astype(np.int32)
            flat = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["id", "n", "one", "two", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            out = [np.unique(shingle_hashes(words, size)) for _, _, words in hashed_words(texts_of(batch.column(1)))]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"])

    return run


def _alike(a: str, b: str, percent: int) -> str:
    """Sets whose sizes are too far apart can't reach the similarity."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(right, "b").join(left, "a").withColumn("same", F.size(F.array_intersect("s", "t")))
    return both.where(f"100 * same >= {percent} * (size(s) + size(t) - same)").select("a", "b").distinct()


def across_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (id, shingles, group) in different groups that may be alike: exact prefix filtering.

    Shingles that only one group has come first in each set's order, then the others by frequency. Two sets that are
    alike enough share a shingle among the first n - ceil(percent * n / 100) + 1 of each, and from the first one they
    share on have enough left. A passage that many
    documents share is frequent, so it comes last and makes no pair of documents that share nothing else. A shingle's
    largest group is paired with the other groups only.
    """
    rows = rows.select("id", "group", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("group").alias("g1"), F.max("group").alias("g2"))
    rows = rows.join(shared.where("g1 <> g2").select("shingle", "df"), "shingle")
    own = Window.partitionBy("id")
    rows = rows.withColumn("k", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy("df", "shingle")))
    rows = rows.withColumn("before", F.collect_list("shingle").over(own.orderBy("df", "shingle").rowsBetween(-RECENT, -1)))
    # what a set holds from this shingle on, itself included
    rows = rows.where(f"nth <= k - ceil({percent} * n / 100) + 1").withColumn("left", F.col("k") - F.col("nth") + 1)
    rows = stored(rows.select("id", "group", "n", "left", "before", "shingle"), "prefix")
    sizes = rows.groupBy("shingle", "group").agg(F.count("*").alias("members"))
    top = sizes.groupBy("shingle").agg(F.count("*").alias("groups"), F.max_by("group", F.struct("members", "group")).alias("top"))
    apart = rows.join(top.where("groups > 1").select("shingle", "top"), "shingle").where("group <> top")
    apart = apart.select("shingle", "top", F.col("id").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("before").alias("ba"), F.col("group").alias("ga"))
    pairs = apart.join(rows.withColumnsRenamed({"id": "b", "n": "nb", "left": "lb", "before": "bb", "group": "gb"}), "shingle")
    pairs = pairs.where("ga <> gb and (gb = top or a < b)").where(_alike("na", "nb", percent))
    # at the first shingle that two sets share, no more can be shared than is left of the shorter rest
    pairs = pairs.where(f"(100 + {percent}) * least(la, lb) >= {percent} * (na + nb)")
    # a pair that shares one of the shingles just before was made there
    pairs = pairs.where("not arrays_overlap(ba, bb)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def minhash_components(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs."""
    session(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = docs.mapInArrow(_signed(bands, rows, size), "id long, n long, one long, two long, bands array<bigint>")
    signed = stored(signed, "signed")
    own = signed.where("n > 0 and id is not null")
    key = ["n", "one", "two"]
    classes = own.groupBy(*key).agg(F.min("id").alias("rep"))
    reps = own.join(classes, key).where("id = rep").dropDuplicates(["id", *key])
    bucket = reps.select("id", F.explode("bands").alias("bucket"))
    # counted before the shuffle and joined back, which adaptive execution can split: a bucket of very many is no hot task
    centre = bucket.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1").drop("members")
    bucket = stored(bucket.join(centre, "bucket"), "buckets")
    near = bucket.select("id").distinct()
    sets = stored(docs.join(near, "id", "left_semi").mapInArrow(_sets(size), "id long, shingles array<bigint>"), "sets")

    stars = bucket.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(confirmed(stars, sets, percent), "links")
    group = stored(components(links), "group")
    named = bucket.join(group, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("group"))
    mixed = named.groupBy("bucket").agg(F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 <> g2").select("bucket")
    doubt = stored(named.join(mixed, "bucket", "left_semi").select("id", "group").distinct(), "doubt")
    more = stored(confirmed(across_groups(sets.join(doubt, "id"), percent), sets, percent), "more")
    if not more.isEmpty():
        # the groups so far stand for the links that made them
        stars, last = group.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")), group
        group = stored(components(stars.union(more)), "group")
        drop(last)
    drop(bucket, sets, links, doubt, more)

    found = signed.select("id", *key).join(classes, key, "left")
    found = found.join(group.withColumnRenamed("id", "rep"), "rep", "left")
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
