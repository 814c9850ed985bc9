"""Quality rules: a decision list learned by sequential covering from labelled statistics.

The statistics of every document are made by built-in functions only. The learner takes a bounded sample of labelled
rows (`TRAIN_ROWS`, by hash of the id), and on the driver grows one conjunction of thresholds after another (greatest
FOIL gain), prunes each on rows held back, and keeps it while its precision there is high enough. The list becomes one
ordered `CASE WHEN` expression, which Catalyst runs like any other.

Null and empty texts have no words: all statistics are 0 and base_failed is true. Very long texts are read whole.
Repeated rows get equal answers. Labels that are null, or of ids that no document has, are ignored; a label on several
rows counts on each. Without labels, or with one class only, the list is empty and every document that passes the base
rules is kept. Of terms with equal gain the first by feature, direction and cut is taken; of the sample's rows, equal hashes go
by id and label. An empty table gives an empty result. Only doc_id and text of the documents, and doc_id and quality of
the labels are read; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WHITE, WHITE

TRAIN_ROWS = 8000
#: Words of a window that may come twice.
WINDOW = 5
#: Thresholds tried for each feature and direction, by quantiles of the sample.
CUTS, MOST_RULES, MOST_TERMS, LEAST_PRECISION, LEAST_COVER = 24, 12, 3, 0.9, 8
FEATURES = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def window_hashes(values: Column, size: int = WINDOW) -> Column:
    """One hash for each run of `size` values of an array, in order; none where the array is shorter.

    The outer transform binds the array: a filter that is pushed below the projection would else put the expression
    that makes it into the inner lambda, and evaluate it for each window.
    """
    starts = lambda own: F.when(F.size(own) >= size, F.sequence(F.lit(0), F.size(own) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(values), lambda own: F.transform(starts(own), lambda i: F.xxhash64(*[own[i + k] for k in range(size)])))[0]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts.

    A window's hash is made of its words' hashes. Only where a window comes twice they are sorted with their places:
    equal ones are neighbours then, and the sorted starts of those cover min(5, gap to the next start) words each.
    Nothing is exploded and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.select(
        "doc_id",
        F.transform(F.filter(F.split("text", f"{WHITE}+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
        F.length(F.regexp_replace("text", f"{WHITE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_WHITE)).alias("lines"),
    )
    base = base.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("windows"),
    )
    base = base.withColumn("again", F.size("windows") > F.size(F.array_distinct("windows")))
    ordered = F.when(F.col("again"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("ordered", ordered).drop("windows")
    m = F.size("ordered") - 1
    pairs = F.zip_with(F.slice("ordered", 1, m), F.slice("ordered", 2, m), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    base = base.withColumn("starts", F.when(F.col("again"), F.array_sort(F.array_distinct(F.flatten(pairs))))).drop("ordered")
    m = F.size("starts") - 1
    gaps = F.zip_with(F.slice("starts", 1, m), F.slice("starts", 2, m), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("again"), F.aggregate(gaps, F.lit(WINDOW), lambda x, y: x + y)).otherwise(0)
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Term:
    """A feature at most, or at least, a threshold."""

    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.cut if self.above else row[self.feature] <= self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks a document as bad, with its rows and precision on what was held back."""

    terms: tuple[Term, ...]
    cover: int
    precision: float

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.terms)

    def sql(self) -> str:
        return " AND ".join(f"({t.sql()})" for t in self.terms)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's gain of a term that leaves p1 of p0 bad and n1 of n0 good rows."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -math.inf


def _cuts(rows: list[dict], feature: str) -> list[float]:
    values = sorted(r[feature] for r in rows)
    picked = {values[(len(values) - 1) * k // CUTS] for k in range(CUTS + 1)}
    return sorted(round(x, 6) for x in picked)


def _grow(rows: list[dict], terms: list[Term]) -> tuple[Term, ...]:
    chosen, left = [], rows
    while len(chosen) < MOST_TERMS:
        p0 = sum(r["bad"] for r in left)
        n0 = len(left) - p0
        if not n0:
            break
        best, most = None, 1e-9
        for t in terms:
            inside = [r["bad"] for r in left if t.holds(r)]
            p1 = sum(inside)
            if p1 >= LEAST_COVER and (g := _gain(p0, n0, p1, len(inside) - p1)) > most:
                best, most = t, g
        if best is None:
            break
        chosen.append(best)
        left = [r for r in left if best.holds(r)]
    return tuple(chosen)


def _prune(terms: tuple[Term, ...], rows: list[dict]) -> tuple[Term, ...]:
    """Drops last terms while (bad - good) / (bad + good) on the rows held back does not fall."""

    def worth(ts):
        inside = [r["bad"] for r in rows if all(t.holds(r) for t in ts)]
        return (2 * sum(inside) - len(inside)) / len(inside) if inside else -1.0

    while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
        terms = terms[:-1]
    return terms


def learn(rows: list[dict]) -> list[Rule]:
    """Sequential covering over rows of features and `bad`; every third row is held back for pruning."""
    grow, held = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    out: list[Rule] = []
    while len(out) < MOST_RULES and sum(r["bad"] for r in grow) >= LEAST_COVER and not all(r["bad"] for r in grow):
        bad = [r for r in grow if r["bad"]]
        terms = [Term(f, above, c) for f in FEATURES for above in (True, False) for c in _cuts(bad, f)]
        found = _prune(_grow(grow, terms), held) if terms else ()
        inside = [r["bad"] for r in held if all(t.holds(r) for t in found)]
        if not found or len(inside) < LEAST_COVER // 2 or sum(inside) / len(inside) < LEAST_PRECISION:
            break
        rule = Rule(found, len(inside), round(sum(inside) / len(inside), 4))
        out.append(rule)
        grow, held = [r for r in grow if not rule.holds(r)], [r for r in held if not rule.holds(r)]
    return out


def labelled(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> list[dict]:
    """Features and label of a bounded sample, the least hashes of doc_id first."""
    own = labels.where("quality is not null").select("doc_id", "quality").join(stats, "doc_id")
    own = own.select("doc_id", (F.col("quality") == 0).alias("bad"), *(F.expr(f"round({e}, 6)").alias(f) for f, e in FEATURES.items()))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(most)
    return [r.asDict() for r in picked.collect()]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true where no rule speaks against a document."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Statistics, base_failed and kept of every document; n_rule is the number of the rule that spoke, from 1."""
    stats = statistics(docs)
    # the labels pick their sample before any text is read
    sample = labels.where("quality is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rules = learn(labelled(statistics(docs.join(sample.select("doc_id").distinct(), "doc_id", "left_semi")), sample, most))
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    number = F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {k}" for k, r in enumerate(rules, 1)) + " ELSE 0 END") if rules else F.lit(0)
    out = stats.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.withColumn("n_rule", number.cast("int")).drop("n_lines")
