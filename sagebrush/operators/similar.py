"""Pairs of texts by the Jaccard similarity of their token sets, exactly.

Token sets are stored once, and texts are not shuffled: a bitmap says which rows stand for all texts of their token set.
Texts of one token set are a class; what follows works on one set a class, and copies meet again in the result alone.
Words are ordered by how often the buckets of their hashes occur, rare ones first (any order would do for right
results), so that each set finds its own prefix without a shuffle. Two sets that are alike share a word of their
prefixes, the smaller one of a shorter prefix, which is the first part of the longer one. Pairs that meet there carry the
place of the word, the word before it (sets that share that one, too, have met there) and a few bits of each set, which
tell most of those that can't be alike before anything is written. Bits of more width follow for large sets, then the
exact value on the words themselves; both come to a cell of pairs once for each set, not for each pair. Shuffle files go
as soon as a step is stored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import drop, stored

#: Buckets of word hashes that are counted; their counts are what the driver holds and each task gets (4 MB).
BUCKETS = 1 << 20
#: Bits of a set that its prefix rows carry, in longs.
LONGS = 4
#: Sets of more words have bits of more width, in longs.
LARGE, WIDE = 250, 64
#: Sets of which a block of wide bits has some (32 MB), and blocks at least, so that there is work for many tasks.
BLOCK, BLOCKS = 1 << 16, 6
#: Sets of one group whose words a task holds at a time, about; smaller parts make work for more tasks, up to so many parts.
GROUP, PART, PARTS = 2000, 250, 8
#: Pairs that a task works through at a time.
PAIRS = 1 << 20
#: Prefix rows that are shuffled at a time, about (some 45 bytes each on disk); more go in rounds by their words.
ROUND = 100_000_000
#: Copies of one text that are paired as one group.
COPIES = 1000


def _parities(hashes: np.ndarray, row: np.ndarray, rows: int, longs: int) -> np.ndarray:
    """(rows, longs): bit k says whether an odd number of a set's words fall to k; sets that differ in d words differ in d bits at most."""
    bits = 64 * longs
    at = (hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % bits
    odd = np.bincount(row * bits + at, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.int64)


def _sets(batch):
    """The hashes of an Arrow list column, the row of each, and the sizes."""
    sizes = np.diff(batch.offsets.to_numpy()).astype(np.int64)
    return batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), sizes


def _room(least: float, n: Column) -> Column:
    """Places after the first in the prefix by which a set of n words meets larger ones."""
    return n - F.ceil(F.lit(2 * least / (1 + least)) * n - F.lit(1e-9))


def _prefixes(counts: np.ndarray, least: float, rounds: int, nth_round: int):
    """Rows of the words of each set's prefix that a round has, each with its place and the word before it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            h, row, n = _sets(b.column(1))
            if not len(h):
                continue
            own = np.lexsort((h, counts[h & (BUCKETS - 1)], row))
            h = h[own]
            nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            # a little less than the share, so that a product that is rounded up cuts nothing
            on = nth <= np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64), n)
            if rounds > 1:
                on &= (h.view(np.uint64) >> np.uint64(20)) % np.uint64(rounds) == nth_round
            at, bits = row[on], _parities(h, row, len(n), LONGS)[row[on]]
            cid = b.column(0).to_numpy()
            before = pa.array(np.roll(h, 1)[on], mask=nth[on] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(cid[at]), pa.array(n[at].astype(np.int32)), pa.array(nth[on].astype(np.int32)), before, *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LONGS))], names)

    names = ["word", "cid", "n", "nth", "before", *(f"s{k}" for k in range(LONGS))]
    return run


def _wide(batches):
    import pyarrow as pa

    for b in batches:
        h, row, n = _sets(b.column(1))
        bits = _parities(h, row, len(n), WIDE)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(n.astype(np.int32))], ["cid", "what", "n"])


def _counts(hashed: DataFrame) -> np.ndarray:
    """How many sets hold words of each bucket."""
    rows = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count()
    kept = _kept(rows, "counts")
    rows = kept.toArrow()
    drop(kept)
    out = np.zeros(BUCKETS, np.int32)
    out[rows.column(0).to_numpy()] = np.minimum(rows.column(1).to_numpy(), 2**31 - 1)
    return out


def _differ(least: float, na: str, nb: str) -> Column:
    """Most words in which sets of these sizes differ if they are alike."""
    return (F.col(na) + F.col(nb)) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9)


def _kept(df: DataFrame, tag: str, **options) -> DataFrame:
    """`stored`, whose shuffle files go when it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(name, None)
    conf.set(name, True)
    try:
        return stored(df, tag, **options)
    finally:
        conf.unset(name) if was is None else conf.set(name, was)


def _marked(rows: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """The rows whose key, a number from 0 on, is in the one column of marks: told by a bit for each number, not by a shuffle."""
    nth = F.col(marks.columns[0]) + 1
    bits = marks.groupBy(F.bitmap_bucket_number(nth).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(nth)).alias("_bits"))
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(F.col(key) + 1) == F.col("_bucket"))
    return found.where(f"getbit(cast(conv(hex(substring(_bits, cast(bitmap_bit_position({key} + 1) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position({key} + 1) % 8 as int)) = 1").drop("_bucket", "_bits")


def _in_cells(pairs: DataFrame, cell: list[str], sets: DataFrame, run, schema: str) -> DataFrame:
    """What `run` makes of each cell's sets (cid, n, what) and pairs (x, y); a set comes once to each cell that has a pair of it."""

    def cells(batches):
        import pyarrow as pa

        now, own, xs, ys = None, {}, [], []
        for b in batches:
            at = [b.column(k).to_numpy() for k in range(len(cell))]
            cid, y, n, what = (b.column(len(cell) + k) for k in range(4))
            ends = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1), b.num_rows] if b.num_rows else [0]
            for i, j in zip(ends[:-1], ends[1:]):
                here = tuple(x[i] for x in at)
                if here != now:
                    if xs:
                        yield from run(own, np.concatenate(xs), np.concatenate(ys))
                    now, own, xs, ys = here, {}, [], []
                # sets come first
                m = i + y.slice(i, j - i).null_count
                own.update(zip(cid.slice(i, m - i).to_pylist(), zip(n.slice(i, m - i).to_pylist(), what.slice(i, m - i).to_pylist())))
                if m < j:
                    xs.append(cid.slice(m, j - m).to_numpy())
                    ys.append(y.slice(m, j - m).to_numpy())
                if sum(map(len, xs)) >= PAIRS:
                    yield from run(own, np.concatenate(xs), np.concatenate(ys))
                    xs, ys = [], []
        if xs:
            yield from run(own, np.concatenate(xs), np.concatenate(ys))

    sides = pairs.select(*cell, F.explode(F.array("x", "y")).alias("cid")).distinct()
    need = sides.join(_marked(sets, "cid", sides.select("cid")), "cid").select(*cell, "cid", F.lit(None).cast("long").alias("y"), "n", "what")
    rows = need.unionByName(pairs.select(*cell, F.col("x").alias("cid"), "y"), allowMissingColumns=True)
    return rows.repartition(*cell).sortWithinPartitions(*cell, F.col("y").isNotNull(), "cid").mapInArrow(cells, schema)


def _near(least: float):
    """Pairs of a cell whose wide bits differ in no more words than those of alike sets."""

    def run(own, x, y):
        import pyarrow as pa

        place = {c: k for k, c in enumerate(own)}
        n = np.array([v[0] for v in own.values()], np.int64)
        bits = np.frombuffer(b"".join(v[1] for v in own.values()), np.uint64).reshape(-1, WIDE)
        for k in range(0, len(x), 1 << 13):
            i, j = (np.array([place[c] for c in v[k : k + (1 << 13)].tolist()]) for v in (x, y))
            far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            on = far <= (n[i] + n[j]) * ((1 - least) / (1 + least)) + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 13)][on]) for v in (x, y)], ["x", "y"])

    return run


def _shared(own, x, y):
    """How many words the sets of each pair of a cell have in common; sets of other blocks have none."""
    import pyarrow as pa

    numbers, sets = {}, {}
    for c, (_, text) in own.items():
        block, _, words = text.rpartition("\n")
        sets[c] = block, np.array([numbers.setdefault(w, len(numbers)) for w in words.split(" ")])
    has, last, same = np.zeros(len(numbers), bool), None, []
    for a, b in zip(x.tolist(), y.tolist()):
        if a != last:
            if last is not None:
                has[sets[last][1]] = False
            has[sets[a][1]] = True
            last = a
        same.append(np.count_nonzero(has[sets[b][1]]) if sets[a][0] == sets[b][0] else 0)
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array([own[c][0] for c in x.tolist()], pa.int32()), pa.array([own[c][0] for c in y.tolist()], pa.int32()), pa.array(same, pa.int32())], ["x", "y", "na", "nb", "same"])


def _met(hashed: DataFrame, counts, least: float, rounds: int, nth_round: int) -> DataFrame:
    """(x, y, large) of the sets that meet at a word of the round and whose bits do not tell that they can't be alike."""
    fields = "word long, cid long, n int, nth int, before long, " + ", ".join(f"s{k} long" for k in range(LONGS))
    prefix = hashed.select("cid", "h").mapInArrow(lambda batches: _prefixes(counts.value, least, rounds, nth_round)(batches), fields)
    a, b = (prefix.withColumnsRenamed({c: f"{c}{k}" for c in prefix.columns if c != "word"}) for k in "ab")
    met = a.join(b, "word").where("na < nb or (na = nb and cida < cidb)").where(F.col("na") >= least * F.col("nb") - 1e-9)
    # at the first word that two sets share, no more can be shared than is left of the shorter rest
    left = (1 + F.least(F.col("na") - F.col("ntha") - 1, F.col("nb") - F.col("nthb") - 1)) * F.lit(1 + least) - F.lit(least) * (F.col("na") + F.col("nb")) + F.lit(1e-9)
    # one condition on both sides, so that they stay one table that is shuffled once
    met = met.where(F.least(_room(least, F.col("na")) - F.col("ntha"), left) >= 0)
    met = met.where("beforea is null or beforeb is null or beforea <> beforeb")
    bits = sum((F.bit_count(F.col(f"s{k}a").bitwiseXOR(F.col(f"s{k}b"))) for k in range(LONGS)), F.lit(0))
    differ = (F.col("na") + F.col("nb")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9)
    return met.where(bits <= differ).select(F.col("cida").alias("x"), F.col("cidb").alias("y"), (F.col("na") > LARGE).alias("large")).distinct()


def _alike(hashed: DataFrame, least: float) -> DataFrame:
    """(x, y) of the sets that may be alike, each pair once."""
    found = _counts(hashed)
    rounds = max(1, math.ceil((1 - least) * found.sum(dtype=np.int64) / ROUND))
    counts = hashed.sparkSession.sparkContext.broadcast(found)
    each = [_kept(_met(hashed, counts, least, rounds, k), "met") for k in range(rounds)]
    pairs = each[0]
    if rounds > 1:
        pairs = _kept(reduce(DataFrame.union, each).distinct(), "met")
        drop(*each)
    large = pairs.where("large")
    sets = large.select(F.explode(F.array("x", "y")).alias("cid")).agg(F.approx_count_distinct("cid")).first()[0]
    blocks = max(BLOCKS, -(-sets // BLOCK))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    cell = (F.least(of("x"), of("y")) * blocks + F.greatest(of("x"), of("y"))).alias("cell")
    wide = hashed.where(F.col("n") > LARGE).select("cid", "h").mapInArrow(_wide, "cid long, what binary, n int")
    near = _kept(_in_cells(large.select(cell, "x", "y"), ["cell"], wide, _near(least), "x long, y long"), "near")
    return pairs.where("not large").select("x", "y").union(near)


def _grouped(pairs: DataFrame) -> DataFrame:
    """(grp, i, j, x, y): sets go by the least one that they or their partner may be like; large groups are cut in parts."""
    ends = pairs.select("x", F.col("y").alias("v")).union(pairs.select("x", F.col("x").alias("v")))
    group = ends.groupBy("v").agg(F.min("x").alias("grp"))
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.least(F.ceil(F.count("*") / PART), F.lit(PARTS)))
    sizes = group.groupBy("grp").agg(parts.cast("int").alias("parts"))
    group = _kept(group.join(sizes, "grp").select("v", F.struct("grp", "parts").alias("g")), "groups")
    both = pairs.join(group.select(F.col("v").alias("x"), F.col("g").alias("gx")), "x").join(group.select(F.col("v").alias("y"), F.col("g").alias("gy")), "y")
    both = both.select("x", "y", F.least("gx", "gy").alias("g"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("g.parts")).cast("int")
    return both.select(F.col("g.grp").alias("grp"), F.least(part("x"), part("y")).alias("i"), F.greatest(part("x"), part("y")).alias("j"), "x", "y")


def similar_pairs(docs: DataFrame, least: float, blocks: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, similarity): pairs with a Jaccard similarity of token sets above `least` (which is above 0) within blocks.

    Equal texts are compared as one and are expanded to pairs in the result alone, which has as many rows as there are pairs.
    """
    # nothing is equal to a null
    rows = docs.select(F.col(key).alias("id"), *blocks, F.col(text).alias("text")).where(" and ".join(f"`{c}` is not null" for c in ["id", *blocks]))
    block = F.to_json(F.struct(*blocks)) if blocks else F.lit(None).cast("string")
    sets = rows.select("id", block.alias("block"), F.sort_array(X.token_set(F.coalesce("text", F.lit("")))).alias("words"))
    sets = sets.select("id", "block", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))
    sets = sets.select(F.monotonically_increasing_id().alias("cid"), "id", "block", "n", F.unhex(F.sha2(F.concat_ws("\n", "block", "words"), 256)).alias("digest"), "words")
    whole = _kept(sets, "sets", compression="zstd")
    sets = whole.where("n > 0")
    classes = _kept(sets.groupBy("digest").agg(F.min("cid").alias("cid"), F.count("*").alias("copies")), "classes")
    members = _kept(sets.select("id", "digest").join(classes, "digest").select("cid", "id"), "members")
    own = _marked(sets, "cid", classes.select("cid"))
    hashed = own.select("cid", "n", F.transform(F.split("words", " "), lambda w: F.xxhash64("block", w)).alias("h"))
    pairs = _kept(_alike(hashed, least), "alike")
    texts = own.select("cid", "n", F.concat_ws("\n", "block", "words").alias("what"))
    found = _in_cells(_grouped(pairs), ["grp", "i", "j"], texts, _shared, "x long, y long, na int, nb int, same int")
    links = found.select("x", "y", (F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))).alias("similarity")).where(F.col("similarity") > least)
    links = _kept(links.union(classes.where("copies > 1").where(F.lit(1.0 > least)).select("cid", "cid", F.lit(1.0))), "links")
    drop(whole, pairs)
    # copies of one text are cut in parts, so that none of them makes one task's pairs
    parts = classes.select(F.col("cid").alias("y"), F.ceil(F.col("copies") / COPIES).cast("int").alias("parts"))
    left = links.join(parts, "y").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(members.select(F.col("cid").alias("x"), F.col("id").alias("a")), "x")
    right = members.select(F.col("cid").alias("y"), F.col("id").alias("b")).join(parts, "y").select("y", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    every = left.join(right, ["y", "part"]).where("if(x = y, a < b, a <> b)")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
