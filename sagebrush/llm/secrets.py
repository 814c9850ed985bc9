"""Secrets in texts: three fixed forms, and stretches of high Shannon entropy per character class. [native]

A kind of span is a pattern. Its matches and the pieces between them are taken in one pass over the text; a running
sum of their lengths gives the places, in code points. Runs of a character class are candidates: a window slides over
them, its counts change by the character that enters and the one that leaves, and its entropy with them. Everything is
DataFrame functions; rows of matches are shuffled once, by document, and texts never.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed

#: The fixed forms, in the order in which spans that start together are listed (fixed values).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: A run that is too short holds no longer one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))


@dataclass(frozen=True)
class CharClass:
    """Runs of these characters hold secrets where a window of so many of them has at least so many bits a character."""

    kind: str
    chars: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{self.chars}]{{{self.window},}}"

    @property
    def limit(self) -> int:
        """The most that the sum of c*log2(c) over a window's counts c may be, as a whole number."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 16, 2.8), CharClass("entropy_alnum", "0-9A-Za-z", 20, 3.8), CharClass("entropy_base64", "0-9A-Za-z+/_=-", 24, 4.05))

#: Candidates that are no secrets: placeholders, counting sequences, UUIDs.
ALLOW = (
    "(?i)example|sample|placeholder|changeme|dummy|redacted|xxxx",
    "(?i)abcdefgh|01234567|98765432|qwertyui",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)
#: Words, also joined: no digit, plus or equals sign, and no capital inside a word.
NO_WORDS = "[0-9+=]|[A-Za-z][A-Z]"

#: Candidates are scanned in pieces of so many windows; spans that go on in the next piece are joined afterwards.
PIECE = 2048
#: Sums of c*log2(c) are kept as whole numbers of this part, so that adding and taking away leaves no rounding behind.
UNIT = 1 << 20
#: Characters of all classes lie in so many codes from this one on.
FIRST_CODE, CODES = ord("+"), ord("z") - ord("+") + 1


def _steps(most: int) -> Column:
    """By count c: what c*log2(c) grows by when the count goes from c-1 to c."""
    total = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, most + 1))]
    return F.array(F.lit(0).cast("long"), *(F.lit(b - a).cast("long") for a, b in zip(total, total[1:])))


def _matches(text: Column, kind: int, pattern: str, value: int = 0) -> Column:
    """(kind, nth, step, size, text, value) of the matches of a pattern; step is the way from the last one's end to this one's."""
    whole = F.lit(pattern)
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, whole, F.lit(0)).alias("text"), F.regexp_extract_all(text, whole, F.lit(value)).alias("value"))
    # the piece after the last match has none
    there = lambda z: z["text"].isNotNull()
    row = lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), (F.length(z["piece"]) + F.length(z["text"])).alias("step"), F.length(z["text"]).alias("size"), z["text"].alias("text"), z["value"].alias("value"))
    return F.transform(F.filter(both, there), row)


def _dense_parts(codes: Column, window: Column, limit: Column, steps: Column) -> Column:
    """Unions of the windows with enough entropy, as (start, end) from the piece's start, in order.

    Counts, their sum of c*log2(c) and the open span are the state; each character that enters, and the one that leaves
    a window's length before, changes two counts.
    """
    gone = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
    moves = F.filter(F.arrays_zip(codes.alias("new"), gone.alias("old")), lambda z: z["new"].isNotNull())
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none = F.filter(F.array(span(F.lit(0), F.lit(0))), lambda x: F.lit(False))
    state = F.struct(F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), span(F.lit(0), F.lit(0)).alias("open"), none.alias("done"))

    def step(s: Column, z: Column) -> Column:
        new, old = z["new"], z["old"]
        less = F.when(old.isNull(), 0).otherwise(F.get(steps, F.get(s["counts"], old)))
        more = F.get(steps, F.get(s["counts"], new) + F.when(new.eqNullSafe(old), 0).otherwise(1))
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k.eqNullSafe(old), 1).otherwise(0))
        start, end = s["at"] + 1 - window, s["at"] + 1

        def close(total: Column) -> Column:
            dense = (start >= 0) & (total <= limit)
            goes_on = s["open"]["end"] > 0
            joined = goes_on & (start <= s["open"]["end"])
            opened = F.when(dense & joined, span(s["open"]["start"], end)).when(dense, span(start, end)).otherwise(s["open"])
            done = F.when(dense & goes_on & ~joined, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
            return F.struct(counts.alias("counts"), total.alias("sum"), end.alias("at"), opened.alias("open"), done.alias("done"))

        return F.get(F.transform(F.array(s["sum"] - less + more), close), F.lit(0))

    return F.aggregate(moves, state, step, lambda s: F.when(s["open"]["end"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def spans(docs: DataFrame, key: str = "_row_key", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(key, kind, name, start, end): all spans of all texts, in code points, end exclusive; kind is the place in the list of kinds.

    Fixed forms are found leftmost first and without overlap within a kind, and are never suppressed. Of a character
    class, a span is a union of windows that reach its bits; candidates on the allow-list, and words, give none. Null and
    empty texts have no spans. A long text is searched whole; its candidates are scanned piece by piece. Extra columns
    are not read.
    """
    kinds = [*BASE, *((c.kind, c.pattern) for c in classes)]
    base = len(BASE)
    text = F.col(text_col)
    every = F.concat(*[_matches(text, k, pattern, 2 if k == 0 else 0) for k, (_, pattern) in enumerate(kinds)])
    rows = docs.select(F.col(key).alias("_key"), F.explode(every).alias("m")).select("_key", "m.*").repartition("_key")
    # from here on all stays by document, so that nothing is shuffled again
    own = Window.partitionBy("_key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("step").over(own)).withColumn("start", F.col("end") - F.col("size"))
    words = ~F.col("text").rlike(NO_WORDS)
    known = words
    for pattern in allow:
        known = known | F.col("text").rlike(pattern)
    rows = rows.where(F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_LEAST).when(F.col("kind") < base, True).otherwise(~known))
    by_class = lambda get: F.get(F.array(*[F.lit(0)] * base, *[F.lit(get(c)) for c in classes]), F.col("kind"))
    rows = rows.withColumn("window", by_class(lambda c: c.window)).withColumn("limit", by_class(lambda c: c.limit).cast("long"))
    # windows start from `from` on; a fixed form is one piece
    starts = F.when(F.col("kind") < base, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("size") - F.col("window"), F.lit(PIECE)))
    rows = rows.select("_key", "kind", "start", "end", "window", "limit", "text", F.explode(starts).alias("from"))
    piece = F.substring(F.col("text"), F.col("from") + 1, F.lit(PIECE - 1) + F.col("window"))
    codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - FIRST_CODE)
    most = max((c.window for c in classes), default=1)
    dense = F.transform(_dense_parts(codes, F.col("window"), F.col("limit"), _steps(most)), lambda p: F.struct((F.col("start") + F.col("from") + p["start"]).alias("start"), (F.col("start") + F.col("from") + p["end"]).alias("end")))
    fixed = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    rows = rows.select("_key", "kind", F.explode(F.when(F.col("kind") < base, fixed).otherwise(dense)).alias("p")).select("_key", "kind", "p.*")
    by = Window.partitionBy("_key", "kind").orderBy("start", "end")
    fresh = (F.col("kind") < base) | F.coalesce(F.col("start") > F.lag("end").over(by), F.lit(True))
    rows = rows.withColumn("part", F.sum(F.when(fresh, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.groupBy("_key", "kind", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    name = F.get(F.array(*[F.lit(k) for k, _ in kinds]), F.col("kind"))
    return out.select(F.col("_key").alias(key), "kind", name.alias("name"), "start", "end")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Rows with null or repeated ids are searched one by one like others. A row without spans has counts of 0, the hash of
    an empty string and an empty list. An empty table gives an empty one.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    found = spans(rows, classes=classes, allow=allow)
    item = F.struct("start", "kind", F.concat_ws(":", "name", "start", "end").alias("shown"), (F.col("kind") < len(BASE)).alias("base"))
    count = lambda k: F.count_if(F.col("kind") == k)
    own = found.groupBy("_row_key").agg(*[count(k).alias(f"n_{name}") for k, (name, _) in enumerate(BASE)], F.array_sort(F.collect_list(item)).alias("list"))
    shown = lambda x: F.array_join(F.transform(x, lambda s: s["shown"]), ",")
    own = own.select("_row_key", *[f"n_{name}" for name, _ in BASE], shown(F.filter("list", lambda s: s["base"])).alias("base"), shown(F.col("list")).alias("spans"))
    out = rows.select("_row_key", "doc_id").join(own, "_row_key", "left")
    zero = [F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name, _ in BASE]
    empty = lambda c: F.coalesce(c, F.lit(""))
    return out.select(F.col("doc_id").alias(id_col), *zero, F.sha2(empty("base").cast("binary"), 256).alias("base_sha256"), empty("spans").alias("spans"))
