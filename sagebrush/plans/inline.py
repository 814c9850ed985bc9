"""Small inputs that no table has, for Spark and as SQL VALUES alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


class Inline:
    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        cols = [c.strip().split(" ", 1) for c in self.schema.split(",")]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return "(SELECT " + ", ".join(f"CAST({n} AS {KINDS[k]}) AS {n}" for n, k in cols) + f" FROM (VALUES {rows}) AS v({', '.join(n for n, _ in cols)}))"


MARKDOWN = Inline("doc_id long, title string, text string", [
    (1, "Guide", "intro\n# One\ntext a\n## Alpha\nbody\n```\n# not a heading\n```\n## Beta\nmore\n# Two\nend"),
    (2, "Notes", "## Early\nx\n# First\ny\n### Deep\nz\n## Side\nlast"),
    (3, "Empty", ""),
    (4, "Code", "# API\n```py\nprint(1)\n```\nsome api reference\n```js\nx\n```"),
])
HEADINGS = Inline("id long, line string", list(enumerate([
    "Introduction", "Chapter 3: Loops", "1.2 About Data", "def foo():", "pip install x", "/usr/bin/env", "my_var name", "x", "THE BIG PICTURE", "This is a sentence.",
    "Section 4 done.", "12345", "a, b, and c,", "one two three four five six seven eight nine ten eleven twelve thirteen", "%%% ###", "$ ls", "return home", "lower case words",
])))
QUERIES = Inline("id long, query string, label string", [
    (1, "explain chapter 3 from Python Programming", None), (2, "show me all code examples for closures", None), (3, "TypeError: cannot read properties of undefined", "Node.js"),
    (4, "how many chapters are there", None), (5, "how to use goroutine pools", "golang 1.22"), (6, "method signature of map", None), (7, "best laptop for travel", None),
    (8, "postgres index tuning", ""), (9, "what is ownership", "Rust"), (10, "3.1.2 About the source data", None),
])
PATHS = Inline("id long, path string, content string", [
    (1, "docs/express/guide.md", "# Guide"), (2, "src/App.tsx", "x"), (3, "a/b/main.go", "package main"), (4, "book.pdf", ""), (5, "index.HTML", "<html>"), (6, "notes", "<!DOCTYPE html>"),
    (7, "README", "## Title"), (8, "mongodb/readme.txt", "t"), (9, "pkg/lib.rs", "fn"), (10, "style/site.scss", "a"), (11, "java/Spring.java", "class"), (12, ".env", "A=1"),
])
EDGES = Inline("src string, dst string, symbols array<string>, pos long", [
    ("api", "auth", ["login"], 1), ("api", "db", ["query"], 2), ("auth", "db", ["query"], 3), ("auth", "types", ["User"], 4), ("db", "types", ["Row"], 5),
    ("x", "y", ["a"], 6), ("y", "x", ["b"], 7), ("app", "x", ["c"], 8), ("api", "auth", ["login", "logout"], 9), ("main", "api", [], 10), ("cli", "api", ["run"], 11), ("test", "api", ["run"], 12),
])
FILES = Inline("file string", [(f,) for f in ("src/a.ts", "src/b.ts", "src/lib/index.ts", "src/util.js", "pkg/__init__.py")])
IMPORTS = Inline("src string, raw string, symbols array<string>, pos long", [
    ("src/a.ts", "./b", ["X", "Y as Z"], 1), ("src/a.ts", "react", ["useState"], 2), ("src/a.ts", "./lib", ["L"], 3), ("src/b.ts", "../src/util", ["u"], 4), ("src/b.ts", "./gone", ["g"], 5), ("src/b.ts", "./a", [], 6),
])
EXPORTS = Inline("file string, symbol string", [("src/b.ts", "X"), ("src/b.ts", "Y"), ("src/lib/index.ts", "M"), ("src/util.js", "u")])
BEFORE = Inline("file string, symbols array<string>", [("a", ["x", "y"]), ("b", ["z"]), ("c", ["k"])])
AFTER = Inline("file string, symbols array<string>", [("a", ["y", "w"]), ("b", ["z"]), ("d", ["n"])])
BOOKMARKS = Inline("pos long, level long, title string", [(1, 1, "One"), (2, 2, "Alpha"), (3, 1, "Two")])
TOC = Inline("pos long, level long, title string", [(1, 1, " one "), (2, 2, "Beta"), (3, 1, "Three")])
VERSIONS = Inline("id long, a string, b string", [(1, "v1.2.3", "1.2.4"), (2, "2.0", "1.9.9"), (3, "1.0.0", "1.0.0"), (4, "x.1", "0.0.9"), (5, "10.0.0", "9.9.9")])
PATCHES = Inline("id long, content string, kind string, line long, old string, new string", [
    (1, "a\nb\nc", "insert", 2, None, "N"), (2, "a\nb\nc", "delete", 3, None, None), (3, "a\nb\nc", "replace", 1, "a", "Z"), (4, "a\nb\nc", "replace", 1, "q", "Z"), (5, "a", "insert", 2, None, "end"), (6, "a\nb", "delete", 9, None, None),
    (7, "a\nb a a", "replace", 2, "a", "Z"), (8, "a", "insert", 9, None, "far"), (9, "a\nb", "content", None, None, "whole"),
])
HINTS = Inline("id long, message string", [
    (1, '"fmt" imported and not used'), (2, "x declared and not used"), (3, "NameError: name 'foo' is not defined. Did you mean: 'for'?"), (4, "perhaps you meant 'bar'"), (5, "nothing here"),
    (6, "Undefined variable $total"), (7, "note: suggested alternative: 'size'"), (8, "Did you mean? reverse"),
])
CATALOG = Inline("code string, probability double, strategy string, cross_file boolean, co_codes array<string>, pos long", [
    ("TS2305", 0.9, "add_import", False, ["TS2304", "TS2339"], 1), ("TS2304", 0.6, "update_import_path", False, ["TS2305"], 2), ("TS2339", 0.3, "add_null_check", False, [], 3), ("TS1005", 0.1, "fix_syntax", False, [], 4), ("TS2305", 0.8, "add_import", False, ["TS2304", "TS2339"], 5),
])
ERRORS = Inline("pos long, id long, file string, code string, message string, origin string, language string, symbol string", [
    (1, 1, "api", "TS2305", "Module has no exported member", "db", "typescript", "query"), (2, 2, "api", "TS2304", "Cannot find name", None, "typescript", "login"), (3, 3, "db", "TS2339", "Property is undefined", None, "typescript", "Row"),
    (4, 4, "types", "TS1005", "';' expected", None, "typescript", "User"), (5, 5, "auth", "TS9999", "odd", "types", "typescript", "User"), (6, 6, "x", "TS2305", "SyntaxError", "x", "typescript", "b"),
])
RULES = Inline("pos long, technology string, pattern string", [(1, "python", "No module named"), (2, "python", "SyntaxError"), (3, "go", "undefined: \\w+"), (4, "python", "Error")])
MESSAGES = Inline("id long, technology string, message string", [(1, "python", "ImportError: No module named x"), (2, "python", "SyntaxError: bad"), (3, "go", "undefined: foo"), (4, "go", "all fine"), (5, "python", "KeyError: 1")])
OUTPUTS = {
    "typescript": ["src/a.ts(3,5): error TS2304: Cannot find name 'x'.\nsrc/b.ts(10,1): error TS1005: ';' expected.", "ok"],
    "go": ["./main.go:7:2: undefined: foo\n./b.go:9:1: syntax error", ""],
    "java": ["A.java:3: error: cannot find symbol\nB.java:9: error: incompatible types", "fine"],
    "csharp": ["P.cs(1,2): error CS1002: ; expected\nQ.cs(3,4): warning CS0168: unused", "error NU1101: Unable to find package"],
    "php": ["PHP Fatal error: Class 'X' not found in /a/b.php on line 12", "nothing"],
    "cpp": ["a.cpp:3:4: error: expected ';'\nb.hpp:1:1: fatal error: x.h: No such file", "ld: undefined reference to `foo'"],
    "python": ['Traceback (most recent call last):\n  File "a.py", line 1, in <module>\n  File "b.py", line 9, in f\nValueError: bad value', "fine"],
    "rust": ["error[E0425]: cannot find value `x`\n --> src/main.rs:4:9", "done"],
    "nestjs": ["a.ts(1,1): error TS2322: Type mismatch\nNest can't resolve dependencies of the X", "A circular dependency has been detected\nUnknown export Foo from module Bar", "at work\nsrc/main.ts:3\nsrc/app.js:12\nTypeError: x is undefined", ""],
    "nextjs": ["Error: Hydration failed because\nModule not found: Can't resolve 'x'", "You're importing a component that needs useState\nServer Error: boom\nImage is missing required width", "ok"],
    "reactnative": ["error: Unable to resolve module './x' from y\nInvariant Violation: bad", "Native module Cam cannot be null\nCould not connect to development server\nBuild failed", "Could not determine the dependencies of task ':app:x'.", "ok"],
}
TESTS = {
    "typescript": ["5 passed, 2 failed"], "python": ["=== 3 passed, 1 failed in 0.1s"], "go": ["ok  \tpkg\nok \tq\nFAIL\tz\t"], "rust": ["test result: 4 passed; 1 failed"],
    "java": ["Tests run: 10, Failures: 2, Errors: 1", "7 tests completed, 2 failed"], "csharp": ["Passed: 5, Failed: 2", "3 passed, 1 failed"],
    "php": ["Tests: 10, Assertions: 25, Failures: 2, Errors: 1"], "cpp": ["8 tests passed, 2 tests failed", "[  PASSED  ] 4 tests."],
}


def outputs(texts: list[str]) -> Inline:
    return Inline("id long, raw string", list(enumerate(texts)))


WANTED = Inline("registry string, package string", [("npm", "a"), ("npm", "b"), ("pypi", "c"), ("pypi", "d")])
CACHE = Inline("registry string, package string, version string, ts long", [("npm", "a", "1.1.0", 100_000_000), ("npm", "a", "1.2.0", 150_000_000), ("npm", "b", "9.0.0", 10)])
SHIPPED = Inline("registry string, package string, version string", [("npm", "a", "1.0.0"), ("npm", "b", "8.0.0"), ("pypi", "c", "3.1")])
TOPICS = Inline("session long, pos long, topic string", [(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (1, 4, "z"), (1, 5, "w"), (2, 1, "q")])
RESPONSES = Inline("id long, response string", [
    (1, '```json\n[{"type": "fact", "content": "uses tabs", "scope": "user"}, {"type": "fact"}]\n```'), (2, '[{"type": "fact", "content": "no scope"}]'), (3, "no json"), (4, '{"type": "fact", "content": "no array"}'),
])
FAULTS = Inline("id long, file string, line long, column long, message string, language string, strategy string, symbol string, actual string, expected string, hint_type string, hint string, hint_sure string", [
    (1, "src/app.ts", 3, None, "Cannot find name 'User'", "typescript", "add_import", None, None, None, None, None, None), (2, "src/app.ts", 1, None, "unused", "typescript", "remove_import", None, None, None, None, None, None),
    (3, "src/app.ts", 1, None, "Cannot find module", "typescript", "update_import_path", None, None, None, None, None, None), (4, "src/app.ts", 3, None, "';' expected", "typescript", "add_semicolon", None, None, None, None, None, None),
    (5, "src/app.ts", 4, None, "Duplicate identifier 'size'", "typescript", "remove_duplicate", None, None, None, None, None, None), (6, "src/app.ts", 3, None, "no hint", "typescript", "apply_compiler_hint", "lgin", None, None, "did_you_mean", "login", "MachineApplicable"),
    (7, "src/app.ts", 3, None, "'user' is possibly null", "typescript", "add_null_check", None, None, None, None, None, None), (8, "src/app.ts", 4, None, "Type mismatch", "typescript", "cast_type", None, "string", "number", None, None, None),
    (9, "lib/io.py", 2, None, "not all paths return", "python", "add_missing_return", None, None, None, None, None, None), (10, "src/app.ts", 6, 9, "')' expected", "typescript", "fix_syntax", None, None, None, None, None, None),
    (11, "src/app.ts", 6, None, "'}' expected", "typescript", "close_bracket", None, None, None, None, None, None), (12, "lib/io.py", 99, None, "beyond", "python", "add_semicolon", None, None, None, None, None, None),
])
TEXTS = Inline("pos long, file string, content string", [
    (1, "src/app.ts", "import { a } from './types';\nimport b from 'b';\nconst u = lgin(user)\nlet size: string = 1;\nlet size = 2;\nif (f(u {"), (2, "src/model/types.ts", "export class User {}"), (3, "lib/io.py", "def f(x):\n    x.y"),
])
SYMBOLS = Inline("file string, symbol string", [("src/model/types.ts", "User"), ("src/app.ts", "User")])
CALLABLES = Inline("pos long, file string, language string, name string, params array<struct<name:string,type:string>>, is_async boolean", [
    (1, "m.py", "python", "load", [("self", None), ("path", "str"), ("deep", "bool")], False), (2, "m.py", "python", "_own", [], False), (3, "a.ts", "typescript", "send", [("ids", "number[]")], True), (4, "x.go", "go", "Run", [("e", "error")], False),
])
CLASSES = Inline("pos long, file string, language string, name string, methods array<string>", [(1, "m.py", "python", "Box", ["__init__", "_hide", "open"])])
NEEDS = Inline("id long, language string, module string", [(1, "python", "requests"), (2, "typescript", "@prisma/client"), (3, "go", "net/http"), (4, "rust", "tokio::fs"), (5, "java", "odd")])
RECIPES = Inline("id long, content string", [
    (1, "ERROR\nMESSAGE: bad import\nFILE: a.py\nFIX: import it\nDIFF:\n+import a\n-import b\nSTRATEGY: add_import"), (2, "FIX: only words"), (3, "FIX: x\nDIFF:\n"), (4, "FIX: y\nDIFF:\n+z"),
])
ANSWERS = Inline("id long, response string", [(1, "1. sorting a list in place\n2) stable sort order of keys\nshort\nfast sorting of big arrays\none more query that is left out"), (2, ""), (3, None)])
SOURCES = Inline("file string, content string", [
    ("a.ts", "import React, { useState as useS } from 'react';\nimport './side';\nimport type { T } from '../t';\n// import no from 'no'\nexport const a = 1, b: Map<string, X> = f(1, 2), c = 3;\nexport default class Main extends Base implements I {\n  go() { const d = 1 }\n}\nexport { a as z } from './re';\nexport * from \"./all\";\nconst fn = async (x) => x;\nlet t = `\nexport const no = 1`;\ntype U = A | B"),
    ("b.ts", ""), ("c.ts", None),
])
MODULES = Inline("file string, content string", [("m.py", "import os as o\nfrom ..p import x, y\n__all__ = ['f']\n@deco(1)\nasync def f(a: int, b=1) -> str:\n    pass\nclass K(B):\n    def m(self): pass\n"), ("bad.py", "def ("), ("none.py", None)])
GO = Inline("file string, content string", [("x.go", 'package a\nimport "fmt"\nimport "github.com/x/y"\nfunc Run() {}\ntype Box struct {}\nfunc id() {}')])
WRITES = Inline("pos long, owner string, scope string, key string, value string", [(1, "p", "project", "tech", "go"), (2, "p", "project", "tech", "rust"), (3, "p", "user", "fixStyle", "small steps"), (4, "p", "user", "codeStyle", "x"), (5, "p", "user", "codeStyle", None), (6, "q", "project", "other", "y")])
LEGACY = Inline("pos long, type string, content string", [(1, "user_pref", "prefers tabs over spaces"), (2, "user_pref", "hello there friend"), (3, "project_fact", "builds with gradle"), (4, "user_pref", "short"), (5, "error_solution", "restart the daemon"), (6, "user_pref", "likes small commits"), (7, None, None)])
INGESTED = Inline("doc_id string, pos long, event string, collection string, n long", [("a", 1, "start", "go", 9), ("a", 2, "progress", None, 4), ("a", 3, "progress", None, 9), ("a", 4, "complete", None, None), ("b", 1, "start", "c", 5), ("b", 2, "progress", None, 2), ("c", 1, "start", "c", 5), ("c", 2, "reset", None, None), ("d", 1, "progress", None, 3)])
CODE_FILES = Inline("path string, content string", [
    ("src/a.py", "import os\nfrom x import y\n\nLIMIT = 3\n\ndef f(x):\n    return x\n\nclass A:\n    def m(self):\n        pass\n"), ("b.py", "x = 1"), ("c.go", "package a\n\nimport \"fmt\"\n\nfunc (b *Box) Run() {}\ntype Box struct {\n}\nfunc id() {}"),
    ("d.ts", "import { a } from 'b';\n// note\nexport abstract class K {}\nexport interface I {}\nexport const n: number = 1;\nexport async function go() {}"), ("e.js", "const fs = require('fs');\nconst f = (a, b) => a;\nexport function g() {}"),
    ("f.rs", "use std::io;\npub struct S;\nimpl<T> S {}\npub async fn run() {}\nenum E {}"), ("g.java", "package p;\nimport q.R;\n\npublic class M {\n    private static int size(int a) {\n        return a;\n    }\n}"),
    ("h.rb", "module B\n  class C\n    def d\n    end\n  end\nend"), ("i.php", "<?php\nuse X;\nclass P {\n  public function go() {}\n}"), ("j.unknown", "function u() {}"), ("k.py", ""), ("l.py", None),
])
DOC_FILES = Inline("path string, content string", [
    ("docs/guide.md", "# Guide\n\nSome words of an introduction.\n\n## Setup\n\n" + "\n\n".join(f"Paragraph {k} tells how the thing is set up, and why that is so. It goes on for a while." for k in range(90)) + "\n\n```js\nrun()\n```"),
    ("notes.txt", "A plain note\n\nREAD THIS FIRST\n\nwhat is said here:\nsome words"), ("page.html", "<html><title>A page</title><main><p>Words, and more of them.</p></main></html>"), ("src/a.py", "import os\n\ndef f(x):\n    return x\n\ndef g():\n    pass"),
    ("book.pdf", "%PDF"), ("empty.md", ""), ("lost.md", None), ("express/intro.md", "# Express\n\nHow routes work in express."),
])
TREE_CATALOG = Inline("pos long, code string, probability double, message_pattern string, capture string, checks array<string>, probabilities array<double>, traces array<string>, fix_hint string", [
    (1, "TS2305", 0.8, "member '([^']+)'", "symbol", ["is_local", "is_imported"], [0.2, 0.95], ["here", None], "look at the export"), (2, "TS2304", 0.6, "name '([^']+)'", "symbol", ["is_external", "odd_check"], [0.1, 0.9], ["package", "x"], None),
    (3, "TS2339", 0.7, "Property '([^']+)'", "symbol", [], [], [], "hint"), (4, "TS1005", 0.1, None, None, [], [], [], None),
])
TREE_ERRORS = Inline("id long, file string, code string, message string", [
    (1, "a", "TS2305", "no exported member 'User'"), (2, "a", "TS2305", "no exported member 'own'"), (3, "a", "TS2304", "Cannot find name 'useState'"), (4, "a", "TS2339", "Property 'Row' does not exist"), (5, "b", "TS2305", "no exported member 'gone'"),
    (6, "a", "TS1005", "';' expected"), (7, "a", "TS9999", "odd"), (8, "b", "TS2305", "nothing in quotes"), (9, "c", "TS2305", "no exported member 'loop'"),
])
TREE_IMPORTS = Inline("file string, symbols array<string>, dst string, external boolean, pos long", [
    ("a", ["User as U", "x"], "b", False, 1), ("a", ["useState"], None, True, 2), ("a", ["Row"], None, False, 3), ("a", ["Row"], "d", False, 4), ("b", ["User"], "types", False, 1), ("c", ["loop"], "d", False, 1), ("d", ["loop"], "c", False, 1),
])
TREE_NAMES = Inline("file string, name string", [("a", "own"), ("a", "own"), ("types", "User")])
CALLS = Inline("id long, args string", [(1, '{"filepath": "a.ts"}'), (2, '{"file_path": "b.py", "x": 1}'), (3, '"{\\"filepath\\": \\"c.go\\"}"'), (4, "{}"), (5, None), (6, '{"x": 2}')])
