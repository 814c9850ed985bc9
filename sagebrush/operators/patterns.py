"""Many patterns at once: an automaton over the literals that patterns require picks the few to run on each line.

A pattern can match only where the literals that its parse tree requires are there. One pass of an automaton over a line
finds all literals of all patterns; the patterns whose every requirement is met are candidates, and only those are run.
Patterns that require no literal are run on every line. The time hardly depends on the number of patterns.
"""

from __future__ import annotations

import re
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shorter literals are in every other line and pick nothing.
LEAST_LITERAL = 3
#: Literals of one requirement; a pattern with more alternatives has that requirement dropped.
MOST_ALTERNATIVES = 64


# -- catalogs --------------------------------------------------------------------------------------------------------


def load_rules(spark: SparkSession, folder: str, own_folder: str | None = None) -> DataFrame:
    """(technology, file, nth, id, category, severity, pattern, captures, root_cause, prescription, code_block, conditions) of all catalogs of a folder.

    A catalog that `own_folder` has under the same file name takes its place. A catalog is a JSON file with `technology` and `patterns`. Files that are no JSON have no rules.
    """
    condition = "array<struct<`when`:string,rootCause:string,prescription:string,codeBlock:string>>"
    schema = f"technology string, patterns array<struct<id:string,category:string,severity:string,`match`:string,captures:array<string>,rootCause:string,prescription:string,codeBlock:string,conditions:{condition}>>"

    def read(path: str, place: int) -> DataFrame:
        rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
        return rows.select(name.alias("file"), F.from_json("value", schema).alias("c"), F.lit(place).alias("place"))

    every = read(folder, 0)
    if own_folder is not None:
        mine = read(own_folder, 1)
        every = every.join(mine.select("file"), "file", "left_anti").unionByName(mine)
    out = every.select("file", F.col("c.technology").alias("technology"), F.posexplode("c.patterns").alias("nth", "p"))
    given = lambda x: F.struct(x["when"].alias("when"), x["rootCause"].alias("root_cause"), x["prescription"].alias("prescription"), x["codeBlock"].alias("code_block"))
    return out.select(
        "technology", "file", F.col("nth").cast("long").alias("nth"), "p.id", "p.category", "p.severity", F.col("p.match").alias("pattern"), F.coalesce("p.captures", F.array().cast("array<string>")).alias("captures"), F.col("p.rootCause").alias("root_cause"),
        "p.prescription", F.col("p.codeBlock").alias("code_block"), F.transform(F.coalesce("p.conditions", F.array().cast(condition)), given).alias("conditions"),
    )


# -- what a pattern requires -----------------------------------------------------------------------------------------


def _needs(tree) -> list[frozenset[str]]:
    """Requirements of a parsed pattern: of each set at least one literal must be there."""
    out: list[frozenset[str]] = []
    run: list[str] = []

    def close():
        if len(run) >= LEAST_LITERAL:
            out.append(frozenset(["".join(run)]))
        run.clear()

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run.append(chr(arg).lower())
            continue
        close()
        if name == "SUBPATTERN":
            out += _needs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            out += _needs(arg[2])
        elif name == "ATOMIC_GROUP":
            out += _needs(arg)
        elif name == "ASSERT" and arg[0] > 0:
            out += _needs(arg[1])
        elif name == "BRANCH":
            # of each alternative the requirement with the longest literals; all alternatives must have one
            best = [max(own, key=lambda s: min(map(len, s))) for own in map(_needs, arg[1]) if own]
            if len(best) == len(arg[1]):
                out.append(frozenset().union(*best))
    close()
    return [s for s in out if len(s) <= MOST_ALTERNATIVES]


def required(pattern: str) -> list[frozenset[str]]:
    """What a pattern requires, in lower case; nothing where it can't be read."""
    try:
        return _needs(parser.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)))
    except (re.error, OverflowError, RecursionError):
        return []


# -- matching --------------------------------------------------------------------------------------------------------


def candidates(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """lines (text, others) with a column `rule`: a row for each pattern (rule long, pattern) that a line may match.

    The patterns come to the driver and go to every task: a catalog, not data. Null lines match nothing.
    """
    import pyarrow as pa

    known = [(r.rule, required(r.pattern)) for r in rules.select("rule", "pattern").where("pattern is not null").collect()]
    always = [rule for rule, needs in known if not needs]
    literal = {x: k for k, x in enumerate(sorted({x for _, needs in known for s in needs for x in s}))}
    # a requirement is the list of its literals; a rule is met when all of its requirements are
    users: dict[int, list[tuple[int, int]]] = {}
    count = {rule: len(needs) for rule, needs in known if needs}
    for rule, needs in known:
        for n, s in enumerate(needs):
            for x in s:
                users.setdefault(literal[x], []).append((rule, n))
    names = lines.columns
    schema = T.StructType([*lines.schema.fields, T.StructField("rule", T.LongType())])
    at = names.index("text")

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x, k in literal.items():
            automaton.add_word(x, k)
        if literal:
            automaton.make_automaton()
        for b in batches:
            row, found = [], []
            for k, text in enumerate(b.column(at).to_pylist()):
                if text is None:
                    continue
                met = list(always)
                if literal:
                    there = {x for _, x in automaton.iter(text.lower())}
                    done = {(rule, n) for x in there for rule, n in users[x]}
                    own: dict[int, int] = {}
                    for rule, _ in done:
                        own[rule] = own.get(rule, 0) + 1
                    met += [rule for rule, n in own.items() if n == count[rule]]
                row += [k] * len(met)
                found += met
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(found, pa.int64())], [*names, "rule"])

    return lines.mapInArrow(run, schema)


def matches(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """lines (text, others) with `rule` for each pattern (rule long, pattern) found in them: what a nested loop gives."""
    own = rules.select("rule", "pattern").where("pattern is not null")
    return candidates(lines, own).join(F.broadcast(own), "rule").where("text rlike pattern").select(*lines.columns, "rule")


def first_matches(lines: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, rule): the first rule, by its number, that a line matches."""
    return matches(lines, rules).groupBy(key).agg(F.min("rule").alias("rule"))
