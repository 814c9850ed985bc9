"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages they join.

Every run of `SEED_WORDS` words (A-Z lower-cased) of a test item is a seed. One pass over all documents counts in how
many documents each seed is; a seed weighs log2((1 + N) / (1 + df)), so rare seeds weigh most. A second pass joins
documents to items by their seeds: hits of one item that lie close together make a passage, one hit being enough. A
passage is aligned with the item word by word (match 2, mismatch -1, gap -1); the score is the share of the best
possible one. How common a seed is decides nothing but the weight shown, so that edited copies are found of an item that
a great part of the corpus holds. Left out are only stretches that hold too few of the item's words, in any order, for
the least share. A copy in which no `SEED_WORDS` words in a row are left has no seed and is not found.

Items are taken in blocks of at most `BLOCK_SEEDS` seeds, so that what a task holds is bounded however large the
benchmark is; each block is one more pass. Texts are read whole, stretch by stretch of `STRETCH` words (with what a
copy can span on both sides), so that a very long text that is full of seeds many items share needs no more memory than
a short one.

Null and empty documents match nothing. Null and empty items are ignored; items of fewer words than a seed are one
seed. Of passages with equal shares the first in the text is kept. Items that say the same are each reported, as are
repeated rows. Empty tables give an empty result. Extra columns are ignored by `contaminated` and passed by `clean`,
whatever their names. A null doc_id gives rows with a null doc_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, keyed, session, shingle_hashes, texts_of

SEED_WORDS, LEAST_SHARE, BLOCK_SEEDS, STRETCH = 3, 0.5, 2_000_000, 1 << 15
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Items:
    """A block of items: their words' hashes, and their seeds sorted by hash with item and place."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    lengths: np.ndarray
    short: list[int]
    weight: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple[object, np.ndarray]]) -> Items:
        found = [shingle_hashes(w, SEED_WORDS) for _, w in rows]
        seeds = np.concatenate(found) if found else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(rows)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, np.int64)
        order = np.argsort(seeds, kind="stable")
        lengths = np.array([len(w) for _, w in rows], np.int64)
        return Items([i for i, _ in rows], [w for _, w in rows], seeds[order], item[order], place[order], lengths, sorted({int(x) for x in lengths if x < SEED_WORDS}))

    def held(self, words: np.ndarray) -> np.ndarray:
        """Places among the seeds of those that a text holds, each once."""
        grams = [np.unique(shingle_hashes(words, k)) for k in (SEED_WORDS, *self.short) if len(words) >= k]
        if not grams or not len(self.seeds):
            return np.empty(0, np.int64)
        grams = np.unique(np.concatenate(grams))
        a, b = np.searchsorted(self.seeds, grams, "left"), np.searchsorted(self.seeds, grams, "right")
        found = np.flatnonzero(b > a)
        n = (b - a)[found]
        return np.repeat(a[found] - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(n.sum())

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place among the seeds) of all seeds in a text."""
        found = [np.empty(0, np.int64)] * 2
        if not len(self.seeds) or not len(words):
            return found[0], found[1]
        grams = [shingle_hashes(words, SEED_WORDS)]
        at = [np.arange(len(grams[0]))]
        for k in self.short:
            # an item of fewer words than a seed is looked for as it is
            if len(words) >= k:
                grams.append(shingle_hashes(words, k))
                at.append(np.arange(len(grams[-1])))
        grams, at = np.concatenate(grams), np.concatenate(at)
        a = np.searchsorted(self.seeds, grams, "left")
        inside = np.flatnonzero(self.seeds[np.minimum(a, len(self.seeds) - 1)] == grams)
        if not len(inside):
            return found[0], found[1]
        a, b = a[inside], np.searchsorted(self.seeds, grams[inside], "right")
        n = b - a
        start = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.repeat(at[inside], n), start + np.arange(n.sum())


def stretches(words: np.ndarray, longest: int, least: float):
    """(first place, words) of a text's stretches; neighbours share what a copy of the longest item can span."""
    reach = math.ceil((3 - 2 * least) * longest) + longest
    for at in range(0, max(1, len(words)), STRETCH):
        first = max(0, at - reach)
        yield first, words[first : at + STRETCH + reach]


def align(item: np.ndarray, text: np.ndarray) -> int:
    """The best local alignment's score (Smith-Waterman, linear gaps), one row of the matrix at a time."""
    best, row = 0, np.zeros(len(text) + 1, np.int64)
    slope = GAP * np.arange(len(text) + 1)
    for word in item:
        new = np.zeros(len(text) + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP))
        # a gap along the row: the running maximum of what stands before, less a step for each word
        new = np.maximum(new, np.maximum.accumulate(new - slope) + slope)
        best, row = max(best, int(new.max())), new
    return best


def passages(items: Items, words: np.ndarray):
    """Yields (item, from, to, weight) of the stretches of a text that hold seeds of an item."""
    at, seed = items.hits(words)
    if not len(at):
        return
    order = np.lexsort((at, items.item[seed]))
    at, seed = at[order], seed[order]
    item = items.item[seed]
    length = items.lengths[item]
    cut = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[1:]), [True])))
    for a, b in zip(cut, cut[1:], strict=False):
        yield int(item[a]), int(at[a]), int(at[b - 1]), float(items.weight[np.unique(seed[a:b])].sum())


def _frequencies(items: Items):
    def run(batches):
        total, n = np.zeros(len(items.seeds), np.int64), 0
        for batch in batches:
            for _, _, words in hashed_words(texts_of(batch.column(1))):
                n += 1
                total[items.held(words)] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), -1], pa.int64()), pa.array([*total[seen].tolist(), n], pa.int64())], ["seed", "docs"])

    return run


def _matches(items: Items, least: float):
    longest = int(items.lengths.max(initial=0))

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for k, (_, _, text) in enumerate(hashed_words(texts_of(batch.column(1)))):
                best: dict[int, tuple] = {}
                for first, i, a, b, weight, words in ((at, *p, part) for at, part in stretches(text, longest, least) for p in passages(items, part)):
                    own = items.words[i]
                    # what a copy of the least share can span: each word added to all of the item's costs one point
                    reach = math.ceil((3 - 2 * least) * len(own))
                    lo, step = max(0, a - reach), max(8 * len(own), 256)
                    # a long stretch is aligned in overlapping windows, so that its cost follows its length
                    hi = min(len(words), b + SEED_WORDS + reach)
                    for x in range(lo, hi, step):
                        part = words[x : min(hi, x + step + reach)]
                        # the share can't be more than that of the item's words that are there at all
                        if np.isin(own, part).mean() < least:
                            continue
                        share = align(own, part) / (MATCH * len(own))
                        if share >= least and share > best.get(i, (0.0,))[0]:
                            best[i] = (share, weight, first + x)
                out += [(k, items.ids[i], round(s, 6), round(w, 6)) for i, (s, w, _) in sorted(best.items())]
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.float64())], ["doc_id", "item_id", "share", "weight"])

    return run


def _blocks(benchmark: DataFrame):
    """The items in blocks of bounded size; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = next(hashed_words([r[1].encode()]))[2]
        if len(words):
            if rows and size + len(words) > BLOCK_SEEDS:
                yield Items.of(rows)
                rows, size = [], 0
            rows.append((r[0], words))
            size += len(words)
    if rows:
        yield Items.of(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, share, weight) of the documents that hold a test item, or most of it, copied or edited."""
    spark = session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark):
        seen = rows.mapInArrow(_frequencies(items), "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs")).toArrow()
        # the last place is that of the number of documents
        df = np.zeros(len(items.seeds) + 1)
        df[seen.column("seed").to_numpy()] = seen.column("docs").to_numpy()
        items.weight = np.log2((1 + df[-1]) / (1 + df[:-1]))
        found = rows.mapInArrow(_matches(items, least), "doc_id long, item_id long, share double, weight double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, share double, weight double")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """docs without the contaminated rows; each row is judged by its own text, whether its doc_id is null or repeated."""
    rows = keyed(docs)
    found = contaminated(rows.select(F.col("_row_key").alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias("_row_key")).distinct()
    return rows.join(found, "_row_key", "left_anti").drop("_row_key")
