"""Inputs that are made from given tables: build logs and test results of users, from events; texts with headings, from orders.

A template is rendered as a Spark column and as SQL alike, so that what parsers find in the texts can be compared with
the fields that they were made of.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table

#: Fields of an event: what they are in Spark and in SQL.
FIELDS = {
    "f": ("concat('src/m', user_id % 7)", "'src/m' || (user_id % 7)"),
    "l": ("cast(event_id % 900 + 1 as string)", "CAST(event_id % 900 + 1 AS VARCHAR)"),
    "c": ("cast(cast(floor(coalesce(value, 0)) as bigint) % 80 + 1 as string)", "CAST(CAST(floor(coalesce(value, 0)) AS BIGINT) % 80 + 1 AS VARCHAR)"),
    "k": ("cast(1000 + user_id % 9000 as string)", "CAST(1000 + user_id % 9000 AS VARCHAR)"),
    "m": ("concat('cannot use ', event_type, ' of user ', user_id)", "'cannot use ' || event_type || ' of user ' || user_id"),
    "n": ("cast(n as string)", "CAST(n AS VARCHAR)"),
    "p": ("cast(p as string)", "CAST(p AS VARCHAR)"),
    "x": ("cast(x as string)", "CAST(x AS VARCHAR)"),
}

#: By language: an error's line, and file, column, code and message as a parser gives them (templates; None where there is none).
LOGS = {
    "typescript": ("{f}.ts({l},{c}): error TS{k}: {m}", "{f}.ts", "{c}", "TS{k}", "{m}"),
    "python": ('Traceback (most recent call last):\n  File "a.py", line 1, in <module>\n  File "{f}.py", line {l}, in g\nValueError: {m}', "{f}.py", None, "PY_VALUE_ERROR", "ValueError: {m}"),
    "go": ("./{f}.go:{l}:{c}: {m}", "./{f}.go", "{c}", "GO_ERROR", "{m}"),
    "rust": ("error[E{k}]: {m}\n --> {f}.rs:{l}:{c}", "{f}.rs", "{c}", "E{k}", "{m}"),
    "java": ("{f}.java:{l}: error: {m}", "{f}.java", None, "JAVA_ERROR", "{m}"),
    "csharp": ("{f}.cs({l},{c}): error CS{k}: {m}", "{f}.cs", "{c}", "CS{k}", "{m}"),
    "php": ("PHP Fatal error: {m} in /{f}.php on line {l}", "/{f}.php", None, "PHP_ERROR", "{m}"),
    "cpp": ("{f}.cpp:{l}:{c}: error: {m}", "{f}.cpp", "{c}", "CPP_ERROR", "{m}"),
    "nestjs": ("{f}.ts({l},{c}): error TS{k}: {m}", "{f}.ts", "{c}", "TS{k}", "{m}"),
    "nextjs": ("{f}.tsx({l},{c}): error TS{k}: {m}", "{f}.tsx", "{c}", "TS{k}", "{m}"),
    "reactnative": ("{f}.tsx({l},{c}): error TS{k}: {m}", "{f}.tsx", "{c}", "TS{k}", "{m}"),
}
#: Languages whose output has one error, so that each event has a log of its own.
ALONE = ("python",)

#: By language: what a test run says of n tests, p of them passed and x failed.
RUNS = {
    "typescript": "Tests: {p} passed, {x} failed", "python": "=== {p} passed, {x} failed in 0.1s", "rust": "test result: {p} passed; {x} failed; 0 ignored", "java": "Tests run: {n}, Failures: {x}, Errors: 0",
    "csharp": "Passed: {p}, Failed: {x}", "php": "Tests: {n}, Assertions: {n}, Failures: {x}", "cpp": "{p} tests passed, {x} tests failed", "nestjs": "{p} passed, {x} failed", "nextjs": "{p} passed, {x} failed", "reactnative": "{p} passed, {x} failed",
}


#: Rows of a table whose texts are made in one task.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: str, source: DataFrame, most: int | None = None) -> DataFrame:
    """Rows by their key in tasks whose size is bounded: more rows in the source (counted from its footers) make more tasks, not larger ones.

    What follows, by the same key, needs no further shuffle, and stays as small.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-source.count() // (most or TASK_ROWS))), key)


def _parts(template: str) -> list[str]:
    return [x for x in re.split(r"(\{[a-z]\})", template) if x]


def column(template: str) -> Column:
    return F.concat(*[F.expr(FIELDS[x[1]][0]) if re.fullmatch(r"\{[a-z]\}", x) else F.lit(x) for x in _parts(template)])


def sql(template: str) -> str:
    return " || ".join(f"({FIELDS[x[1]][1]})" if re.fullmatch(r"\{[a-z]\}", x) else "'" + x.replace("'", "''") + "'" for x in _parts(template))


def logs(spark, sf_dir: str, language: str) -> DataFrame:
    """(id, raw): the log of each user, a line an event in their order; or of each event."""
    rows = table(spark, sf_dir, "events").where("user_id is not null and event_id is not null and event_type is not null")
    line = column(LOGS[language][0])
    if language in ALONE:
        return rows.select(F.col("event_id").alias("id"), line.alias("raw"))
    # a user's log is one text, as a build's is
    lines = rows.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    return lines.select("id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("raw"))


def logs_sql(language: str, kinds) -> str:
    """What a parser finds in the logs: the fields of the events."""
    _, file, at, code, message = LOGS[language]
    kind = " ".join(f"WHEN regexp_matches(lower({sql('{m}')}), '{p}') THEN '{k}'" for p, k in ((p.replace("'", "''"), k) for p, k in kinds))
    alone = language in ALONE
    nth = "0::BIGINT" if alone else "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1"
    column_sql = "CAST(NULL AS INTEGER)" if at is None else f"CAST({sql(at)} AS INTEGER)"
    return f"""SELECT {"event_id" if alone else "user_id"} AS id, {nth} AS nth, {sql(file)} AS file, CAST({sql("{l}")} AS INTEGER) AS line, {column_sql} AS "column", {sql(code)} AS code, {sql(message)} AS message, CASE {kind} ELSE 'runtime' END AS category
FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL"""


def runs(spark, sf_dir: str, language: str) -> DataFrame:
    """(id, raw): the test results of each user; an event of 50 or more is a test passed."""
    rows = table(spark, sf_dir, "events").where("user_id is not null").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("p"))
    rows = rows.withColumn("x", F.col("n") - F.col("p"))
    if language == "go":
        return rows.select("id", F.concat(F.expr("repeat('ok  \\tpkg\\n', cast(p as int))"), F.expr("repeat('FAIL\\tpkg\\t0.1s\\n', cast(x as int))")).alias("raw"))
    return rows.select("id", column(RUNS[language]).alias("raw"))


RUNS_SQL = "SELECT user_id AS id, count(*) FILTER (value >= 50) AS passed, count(*) - count(*) FILTER (value >= 50) AS failed FROM events WHERE user_id IS NOT NULL GROUP BY user_id"


def order_texts(spark, sf_dir: str) -> DataFrame:
    """(doc_id, title, text): an order as a Markdown text, a heading of one of three levels and a line for each item; some lines are fenced."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_quantity"))
    said = F.concat(F.repeat(F.lit("#"), (nth - 1) % 3 + 1), F.lit(" Part "), F.col("l_partkey").cast("string"), F.lit("\nShipped by "), F.col("l_returnflag"))
    line = F.when(F.col("l_quantity") % 5 == 0, F.concat(said, F.lit("\n```\n# no heading\n```"))).otherwise(said)
    items = table(spark, sf_dir, "lineitem")
    rows = items.where("l_returnflag is not null and l_partkey is not null and l_linenumber is not null")
    rows = dealt(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"), "l_orderkey", items)
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), nth.alias("nth"), line.alias("line"))
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("x"))
    return own.select("doc_id", F.concat(F.lit("Order "), F.col("doc_id").cast("string")).alias("title"), F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


ORDER_TEXTS = """(SELECT l_orderkey AS doc_id, 'Order ' || l_orderkey AS title, string_agg(repeat('#', CAST((nth - 1) % 3 + 1 AS INTEGER)) || ' Part ' || l_partkey || chr(10) || 'Shipped by ' || l_returnflag
  || CASE WHEN l_quantity % 5 = 0 THEN chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' ELSE '' END, chr(10) ORDER BY nth) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS nth FROM lineitem WHERE l_returnflag IS NOT NULL AND l_partkey IS NOT NULL AND l_linenumber IS NOT NULL) GROUP BY l_orderkey)"""
