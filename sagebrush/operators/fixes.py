"""Fixes: tiers, patches, similar past fixes, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T

#: Messages that tell kinds of faults apart when a past fix is looked for (fixed values).
SIGNS = "Cannot read properties of|is not a function|is not defined|ECONNREFUSED|MODULE_NOT_FOUND|SyntaxError|TypeError|null|undefined".split("|")


def tier(strategy: Column, cross_file: Column, probability: Column, promoted: Column) -> Column:
    """1 (certain), 2 (candidates) or 3 (needs context)."""
    sure = strategy.isin(*T.TIER1)
    return F.when(strategy.isNull(), 3).when(promoted, 1).when(cross_file, 3).when((probability > 0.7) & sure, 2).when(sure, 1).when(strategy.isin(*T.TIER2), 2).otherwise(3)


def planned(errors: DataFrame, promoted: DataFrame, most: int = 10) -> DataFrame:
    """errors with their tier; at most `most` of the first tier are automatic, by queue position."""
    p = promoted.select("language", F.col("error_code").alias("code"), F.lit(True).alias("promoted")).distinct()
    out = errors.join(p, ["language", "code"], "left")
    out = out.withColumn("tier", tier(F.col("strategy"), F.coalesce("cross_file", F.lit(False)), F.col("probability"), F.coalesce("promoted", F.lit(False))))
    nth = F.row_number().over(Window.partitionBy("tier").orderBy("pos"))
    return out.withColumn("automatic", (F.col("tier") == 1) & (nth <= most))


def similar_fixes(errors: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, event_id, priority) of the latest passed outcome like an error: same code and language with a diff, then
    without one, then a message with the same sign.

    Outcomes are first reduced to the latest of each key, so what is joined is small.
    """
    good = outcomes.where("passed")
    latest = lambda df, *by: df.groupBy(*by).agg(F.max(F.struct("ts", "event_id")).alias("at"))
    exact = latest(good.where("diff is not null"), "error_code", "language").withColumn("priority", F.lit(1))
    code = latest(good, "error_code", "language").withColumn("priority", F.lit(2))
    one = errors.join(exact.unionByName(code).withColumnRenamed("error_code", "code"), ["code", "language"]).select("id", "at", "priority")
    signs = F.array(*[F.lit(s.lower()) for s in SIGNS])
    signed = lambda c: F.filter(signs, lambda s: F.contains(F.lower(c), s))
    by_sign = latest(good.where("diff is not null and message is not null").select("*", F.explode(signed(F.col("message"))).alias("sign")), "sign")
    two = errors.select("id", F.explode(signed(F.coalesce("message", F.lit("")))).alias("sign")).join(by_sign, "sign").groupBy("id").agg(F.max("at").alias("at")).withColumn("priority", F.lit(3))
    return one.unionByName(two).groupBy("id").agg(F.min_by(F.struct("at", "priority"), "priority").alias("x")).select("id", "x.at.event_id", F.col("x.priority").cast("long").alias("priority"))


def fix_rates(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("error_code", "language").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("rate"))


def patched(content: Column, kind: Column, line: Column, old: Column, new: Column) -> Column:
    """The text after a patch by line (from 1): insert, delete, replace or content (all of it); null if it doesn't fit.

    Of a line to replace the first place of `old` changes; a line without it becomes `new`. Text inserted beyond the
    end is appended, before the first line it comes first.
    """
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    inside = line.between(1, n)
    at = F.element_at(lines, F.when(inside, line).otherwise(1))
    place = F.instr(at, old)
    row = F.when((place > 0) & (old != ""), F.concat(F.substring(at, F.lit(1), place - 1), new, F.substring(at, place + F.length(old), F.length(at)))).otherwise(new)
    first = F.greatest(line, F.lit(1))
    head, tail = F.slice(lines, 1, F.least(first - 1, n)), lambda k: F.slice(lines, first + k, n)
    out = F.when(kind == "insert", F.concat(head, F.array(new), tail(0))).when(inside & (kind == "delete"), F.concat(head, tail(1)))
    out = out.when(inside & (kind == "replace") & new.isNotNull(), F.concat(head, F.array(row), tail(1)))
    return F.when(kind == "content", new).otherwise(F.array_join(out, "\n"))


def recipe(error: Column, fix: Column, before: Column, after: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Error: "), error), F.concat(F.lit("Fix: "), fix), F.concat(F.lit("Before: "), before), F.concat(F.lit("After: "), after))
