"""Skeletons of tests: the cases that functions and classes suggest, stand-ins for modules, and test files of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cases as T


def edges(language: Column, kind: Column) -> Column:
    """array<struct<label, value>> of the values at which a parameter of a type is tried; none for unknown languages."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    out = F
    for name, rules in T.EDGES.items():
        for words, *values in rules:
            fits = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words], ~F.lit(bool(words)))
            out = out.when((language == name) & fits, F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in values]))
    return F.coalesce(out.otherwise(F.lit(None)), F.array().cast("array<struct<label:string,value:string>>"))


def mocks(modules: DataFrame) -> DataFrame:
    """(id, language, module, kind, value) of the stand-in for each module (id, language, module)."""
    out = F
    for name, rules in T.MOCKS.items():
        for pattern, kind, value in rules:
            out = out.when((F.col("language") == name) & F.lower("module").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value")))
    return modules.select("id", "language", "module", out.otherwise(F.lit(None)).alias("x")).select("id", "language", "module", "x.kind", "x.value")


def _case(kind: str, name: Column, function: Column, param: Column | None = None, value: Column | None = None, waits: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    waits = F.lit(False) if waits is None else F.coalesce(waits, F.lit(False))
    return F.struct(name.alias("name"), F.lit(kind).alias("kind"), function.alias("function"), (none if param is None else param).alias("param"), (none if value is None else value).alias("value"), waits.alias("is_async"))


def cases(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, language, nth, name, kind, function, param, value, is_async): what is to be tested, in the order of the sources.

    Functions: pos, file, language, name, params (name, type), is_async. Classes: pos, file, language, name, methods.
    Names that begin with an underscore are private, but for __init__. Nothing is shuffled but to number the cases.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    public = lambda c: ~c.startswith("_") | (c == "__init__")
    name, own = F.col("name"), F.filter("params", lambda p: ~p["name"].isin("self", "cls"))
    tried = F.flatten(F.transform(own, lambda p: F.transform(edges(F.col("language"), p["type"]), lambda e: _case("edge", text(name, " handles ", p["name"], "=", e.label), name, p["name"], e.value))))
    nulls = F.transform(own, lambda p: _case("null", text(name, " handles ", p["name"], "=null"), name, p["name"]))
    none = F.array().cast("array<struct<name:string,kind:string,function:string,param:string,value:string,is_async:boolean>>")
    rejected = F.when(F.col("is_async"), F.array(_case("async_error", text(name, " handles async rejection"), name))).otherwise(none)
    every = F.concat(F.array(_case("happy", text(name, " returns expected output"), name, waits=F.col("is_async"))), F.coalesce(tried, none), F.array(_case("error", text(name, " handles invalid input"), name)), F.coalesce(nulls, none), rejected)
    f = functions.where(public(name)).select("file", "language", F.lit(0).alias("part"), "pos", F.posexplode(every).alias("k", "c"))
    methods = F.transform(F.filter("methods", public), lambda m: _case("happy", text(name, ".", m, " works correctly"), text(name, ".", m)))
    made = F.concat(F.array(_case("happy", text(name, " can be instantiated"), text(name, " constructor"))), F.coalesce(methods, none))
    c = classes.select("file", "language", F.lit(1).alias("part"), "pos", F.posexplode(made).alias("k", "c"))
    rows = f.unionByName(c).groupBy("file", "language").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "k", "c"))).alias("rows"))
    return rows.select("file", "language", F.posexplode("rows").alias("nth", "r")).select("file", "language", F.col("nth").cast("long").alias("nth"), "r.c.*")


def _python(c: Column) -> Column:
    f, p, v = c.function, c.param, c.value
    line = lambda *parts: F.concat(F.lit("    "), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    # wording of the bodies is fixed
    body = (
        F.when(c.kind == "happy", F.concat(line("# TODO: Fill in expected value"), line("result = ", f, "()  # TODO: add arguments"), line("assert result is not None  # TODO: replace with actual assertion")))
        .when(c.kind == "edge", F.concat(line("# Edge case: ", p, " = ", v), line("result = ", f, "(", p, "=", v, ")"), line("assert result is not None  # TODO: replace with actual assertion")))
        .when(c.kind == "error", F.concat(line("with pytest.raises(Exception):  # TODO: specify exception type"), line("    ", f, "(None)  # TODO: use invalid input")))
        .when(c.kind == "null", F.concat(line("# Handle ", p, " = None"), line("result = ", f, "(", p, "=None)"), line("assert result is not None or True  # TODO: define expected behavior")))
        .otherwise(F.concat(line("# Async rejection test"), line("with pytest.raises(Exception):"), line("    await ", f, "()  # TODO: trigger rejection")))
    )
    return F.concat(F.lit("def test_"), F.lower(F.regexp_replace(c["name"], "[^a-zA-Z0-9]", "_")), F.lit("():\n"), body, F.lit("\n\n"))


def python_files(rows: DataFrame) -> DataFrame:
    """(file, content): a pytest file for each Python file of cases."""
    own = rows.where("language = 'python'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "kind", "function", "param", "value"))).alias("rows"))
    module = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)\z", 1), r"\.[^.]*\z", "")
    head = F.concat(F.lit("import pytest\nfrom "), module, F.lit(" import *  # TODO: import specific functions\n\n\n"))
    return own.select("file", F.concat(head, F.array_join(F.transform("rows", _python), "")).alias("content"))


def _javascript(c: Column) -> Column:
    f, p, v = c.function, c.param, c.value
    line = lambda *parts: F.concat(F.lit("    "), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    wait = F.when(c.is_async & (c.kind == "happy"), "await ").otherwise("")
    defined = "expect(result).toBeDefined(); // TODO: "
    # wording of the bodies is fixed
    body = (
        F.when(c.kind == "happy", F.concat(line("// TODO: Fill in expected value"), line("const result = ", wait, f, "(); // TODO: add arguments"), line(defined + "replace with actual assertion")))
        .when(c.kind == "edge", F.concat(line("// Edge case: ", p, " = ", v), line("const result = ", f, "(", v, ");"), line(defined + "replace with actual assertion")))
        .when(c.kind == "error", line("expect(() => ", f, "(null)).toThrow(); // TODO: specify error"))
        .when(c.kind == "null", F.concat(line("// Handle ", p, " = null"), line("const result = ", f, "(null);"), line(defined + "define expected behavior")))
        .otherwise(line("await expect(", f, "()).rejects.toThrow(); // TODO: trigger rejection"))
    )
    waits = F.when((c.is_async & (c.kind == "happy")) | (c.kind == "async_error"), "async ").otherwise("")
    return F.concat(F.lit("  test('"), c["name"], F.lit("', "), waits, F.lit("() => {\n"), body, F.lit("  });\n\n"))


def javascript_files(rows: DataFrame, framework: str = "jest") -> DataFrame:
    """(file, content): a jest or vitest file for each TypeScript file of cases. A case that awaits is async."""
    item = F.struct("nth", "name", "kind", "function", "param", "value", "is_async")
    own = rows.where("language = 'typescript'").groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    module = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)\z", 1), r"\.[^.]*\z", "")
    loads = ("import { describe, test, expect, vi } from 'vitest';\nimport { /* TODO: functions */ } from './", "';\n") if framework == "vitest" else ("const { /* TODO: functions */ } = require('./", "');\n")
    head = F.concat(F.lit(loads[0]), module, F.lit(loads[1] + "\ndescribe('"), module, F.lit("', () => {\n"))
    return own.select("file", F.concat(head, F.array_join(F.transform("rows", _javascript), ""), F.lit("});")).alias("content"))


def generic_files(rows: DataFrame) -> DataFrame:
    """(file, content): the cases of each file as comments, for languages without a form of their own."""
    own = rows.groupBy("file", "language").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "kind", "function", "value"))).alias("rows"))
    said = lambda c: F.concat(F.lit("// Test: "), c["name"], F.lit(" ["), c.kind, F.lit("]\n// Function: "), c.function, F.when(c.value.isNotNull(), F.concat(F.lit("\n// Input: "), c.value)).otherwise(""), F.lit("\n// TODO: implement test\n"))
    return own.select("file", F.concat(F.lit("// Test skeleton for "), "language", F.lit("\n\n"), F.array_join(F.transform("rows", said), "\n")).alias("content"))
