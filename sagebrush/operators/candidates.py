"""Candidates of fixes: certain patches, choices by rules, the checks of a patched text. All in the JVM.

Errors: id, file, line (from 1), column, message, language, strategy, the captures symbol, actual, expected and token,
and hint_type, hint, hint_sure of a compiler's hint. Files: file, content, pos (their order). Exports: file, symbol.
Missing columns of errors count as null. An error whose file or line is unknown gets no certain patch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPTIONAL = {"column": "int", "symbol": "string", "actual": "string", "expected": "string", "token": "string", "hint_type": "string", "hint": "string", "hint_sure": "string"}

# Lines that import, lines that declare, names quoted in messages.
IMPORTS = r"^\s*(import |from |require|use |using |package )"
IMPORT = r"^\s*(import |from |require|use |using )"
DECLARES = r"\b(class|function|const|let|var|interface|type|enum|def|struct)\b"
QUOTED = r"""['"](\w+)['"]"""
EXPECTED = r"""['"]([^'"]+)['"]\s*expected"""
# The confidence of each kind of certain patch.
CERTAIN = {"add_import": 0.85, "remove_import": 0.9, "update_import_path": 0.8, "add_semicolon": 0.95, "remove_duplicate": 0.6, "did_you_mean": 0.95, "unused_import": 0.9}


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _filled(errors: DataFrame) -> DataFrame:
    return errors.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in errors.columns})


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+\z", "")


def _trim(c: Column) -> Column:
    return F.regexp_replace(_rtrim(c), r"\A\s+", "")


def first_replaced(text: Column, old: Column, new: Column) -> Column:
    """The text with the first place of a string changed."""
    at = F.instr(text, old)
    return F.when((at > 0) & (old != ""), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def word_replaced(text: Column, word: Column, new: Column) -> Column:
    """The text with the first place where a string stands as a word changed."""
    pattern = F.concat(F.lit(r"(?s)\A(.*?)\b\Q"), word, F.lit(r"\E\b"))
    return F.regexp_replace(text, pattern, F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\$])", r"\\$1")))


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"\.\w+\z", "")


def relative(source: Column, target: Column) -> Column:
    """The path of a file as seen from another file's folder, without its extension, with a leading dot."""
    parts = lambda p: F.filter(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    a, b = F.slice(parts(source), 1, F.greatest(F.size(parts(source)) - 1, F.lit(0))), parts(target)
    most = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.sequence(F.lit(0), most), lambda k: (k > 0) & (F.slice(a, 1, k) == F.slice(b, 1, k))))
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    path = F.regexp_replace(F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/"), r"\.\w+\z", "")
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def import_line(language: Column, path: Column, symbol: Column) -> Column:
    """The line that imports a symbol; null for languages without a form."""
    bare = F.replace(path, F.lit("./"), F.lit(""))
    dotted = lambda by: F.replace(bare, F.lit("/"), F.lit(by))
    forms = {
        ("typescript", "javascript"): F.concat(F.lit("import { "), symbol, F.lit(" } from '"), path, F.lit("';")),
        ("python",): F.concat(F.lit("from "), dotted("."), F.lit(" import "), symbol),
        ("go",): F.concat(F.lit('\t"'), bare, F.lit('"')),
        ("rust",): F.concat(F.lit("use crate::"), dotted("::"), F.lit("::"), symbol, F.lit(";")),
        ("java", "kotlin"): F.concat(F.lit("import "), dotted("."), F.lit("."), symbol, F.lit(";")),
        ("csharp",): F.concat(F.lit("using "), dotted("."), F.lit(";")),
        ("php",): F.concat(F.lit("use "), dotted("\\"), F.lit("\\"), symbol, F.lit(";")),
        ("swift",): F.concat(F.lit("import "), F.regexp_extract(path, r"([^/]*)\z", 1)),
    }
    return reduce(lambda w, kv: w.when(language.isin(*kv[0]), kv[1]), forms.items(), F).otherwise(F.lit(None).cast("string"))


def _patch(kind: str, line: Column, old: Column | None, new: Column | None, sure: str, *words: Column | str) -> Column:
    none = F.lit(None).cast("string")
    said = F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words])
    return F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), (none if old is None else old).alias("old"), (none if new is None else new).alias("new"), F.lit(CERTAIN[sure]).alias("confidence"), said.alias("description"))


def _with_targets(rows: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """Adds `origin`, the first other file that exports the symbol, and `moved`, the first with the stem of the path on the line.

    Both are found through the keys that errors hold, so that only those are grouped.
    """
    first = F.min_by("target", "target_pos")
    order = files.select(F.col("file").alias("target"), F.col("pos").alias("target_pos"))
    wanted = rows.where("strategy = 'add_import' and name is not null").select("file", "name").distinct()
    made = exports.select(F.col("file").alias("target"), F.col("symbol").alias("name")).distinct().join(order, "target")
    origin = wanted.join(made, "name").where("target <> file").groupBy("file", "name").agg(first.alias("origin"))
    lost = rows.where("strategy = 'update_import_path' and quoted is not null").select("file", "quoted", stem(F.col("quoted")).alias("stem")).distinct()
    moved = lost.join(order.withColumn("stem", stem(F.col("target"))), "stem").where("target <> file").groupBy("file", "quoted").agg(first.alias("moved"))
    return rows.join(origin, ["file", "name"], "left").join(moved, ["file", "quoted"], "left")


def certain(errors: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, strategy, kind, line, old, new, confidence, description): one patch for each error that has a certain one."""
    own = _filled(errors).join(files.select("file", F.split("content", "\n", -1).alias("lines")), "file")
    at = F.coalesce("line", F.lit(1)).cast("int")
    row = F.when(at.between(1, F.size("lines")), F.element_at("lines", F.when(at.between(1, F.size("lines")), at).otherwise(1)))
    name = F.coalesce(F.col("symbol"), _or_null(F.regexp_extract("message", r"""['"](\w{2,50})['"]""", 1)))
    own = own.withColumns({"at": at, "row": row, "name": name, "quoted": _or_null(F.regexp_extract(row, r"""['"]([^'"]+)['"]""", 1))})
    own = _with_targets(own, files, exports)
    c = F.col
    last = F.array_max(F.transform("lines", lambda x, i: F.when(x.rlike(IMPORTS), i + 1).otherwise(0)))
    line = import_line(c("language"), relative(c("file"), c("origin")), c("name"))
    path = relative(c("file"), c("moved"))
    dup = F.coalesce(c("symbol"), _or_null(F.regexp_extract("message", QUOTED, 1)))
    declared = F.filter(F.transform("lines", lambda x, i: F.when(F.contains(x, dup) & x.rlike(DECLARES), i + 1)), lambda i: i.isNotNull())
    second = F.try_element_at(declared, F.lit(2))
    changed = first_replaced(c("row"), c("symbol"), c("hint"))
    hinted = (c("strategy") == "apply_compiler_hint") & (c("hint_sure") == "MachineApplicable")
    made = (
        F.when((c("strategy") == "add_import") & line.isNotNull(), _patch("insert", last + 1, None, line, "add_import", "Add import: ", line))
        .when((c("strategy") == "remove_import") & c("row").rlike(IMPORT), _patch("delete", at, None, None, "remove_import", "Remove unused import: ", _trim(c("row"))))
        .when((c("strategy") == "update_import_path") & path.isNotNull(), _patch("replace", at, c("quoted"), path, "update_import_path", "Fix import path: '", c("quoted"), "' → '", path, "'"))
        .when((c("strategy") == "add_semicolon") & ~_rtrim(c("row")).endswith(";"), _patch("replace", at, c("row"), F.concat(_rtrim(c("row")), F.lit(";")), "add_semicolon", "Add missing semicolon at line ", at.cast("string")))
        .when((c("strategy") == "remove_duplicate") & second.isNotNull(), _patch("delete", second, None, None, "remove_duplicate", "Remove duplicate declaration of '", dup, "' at line ", second.cast("string")))
        .when(hinted & (c("hint_type") == "did_you_mean") & (changed != c("row")), _patch("replace", at, c("row"), changed, "did_you_mean", "Replace '", c("symbol"), "' with '", c("hint"), "' (compiler suggestion)"))
        .when(hinted & (c("hint_type") == "unused_import") & c("row").isNotNull(), _patch("delete", at, None, None, "unused_import", "Remove unused import '", c("hint"), "'"))
    )
    return own.select("id", "strategy", made.alias("p")).where("p is not null").select("id", "strategy", "p.*")


@dataclass
class Fault:
    """What the rules of candidates write with."""

    line: Column
    symbol: Column
    actual: Column
    expected: Column
    token: Column
    column: Column

    def put(self, *parts: str) -> Column:
        """Parts in a row; those that name a field stand for it, `trimmed` and `rtrimmed` for the line so cut."""
        fields = {"line": self.line, "trimmed": _trim(self.line), "rtrimmed": _rtrim(self.line), "symbol": self.symbol, "actual": self.actual, "expected": self.expected, "token": self.token}
        return F.concat(*[fields[p[1:]] if p[0] == "@" else F.lit(p) for p in parts])

    def word(self, *parts: str) -> Column:
        return word_replaced(self.line, self.symbol, self.put(*parts))

    def swap(self, old: Column, *parts: str) -> Column:
        return first_replaced(self.line, old, self.put(*parts))

    def cut(self, back: int) -> Column:
        """The line with the token at the column, over the `back` characters before it."""
        return F.concat(F.substring(self.line, F.lit(1), F.greatest(self.column - back, F.lit(0))), self.token, F.substring(self.line, self.column + 1, F.length(self.line)))


JS, PY, GO, RS, SW = ("typescript", "javascript"), ("python",), ("go",), ("rust",), ("swift",)
#: (strategy, languages, code, rationale, confidence): wording and confidence are fixed values, the order is the choice's number.
RULES: list[tuple[str, tuple, Callable[[Fault], Column], tuple, float]] = [
    ("add_null_check", JS, lambda f: f.word("@symbol", "?"), ("Optional chaining — safely access property, returns undefined if null",), 0.7),
    ("add_null_check", JS, lambda f: f.put("if (", "@symbol", ") {\n  ", "@trimmed", "\n}"), ("Explicit null guard — skips the operation entirely if null",), 0.6),
    ("add_null_check", JS, lambda f: f.word("@symbol", "!"), ("Non-null assertion — tells TypeScript you guarantee it's not null (use only if certain)",), 0.4),
    ("add_null_check", PY, lambda f: f.put("if ", "@symbol", " is not None:\n    ", "@trimmed"), ("Explicit None check before access",), 0.7),
    ("add_null_check", PY, lambda f: f.word("(", "@symbol", " or default_value)"), ("Falsy fallback — use default if None/empty",), 0.5),
    ("add_null_check", RS, lambda f: first_replaced(f.line, F.lit(".unwrap()"), F.lit(".unwrap_or_default()")), ("unwrap_or_default — returns Default::default() instead of panicking",), 0.7),
    ("add_null_check", RS, lambda f: first_replaced(f.line, F.lit(".unwrap()"), F.lit("?")), ("? operator — propagates the error to the caller",), 0.8),
    ("add_null_check", SW, lambda f: f.put("if let ", "@symbol", " = ", "@symbol", " {\n    ", "@trimmed", "\n}"), ("if let unwrap — safely unwraps the optional",), 0.7),
    ("add_null_check", SW, lambda f: f.put("guard let ", "@symbol", " = ", "@symbol", " else { return }"), ("guard let — early exit if nil",), 0.6),
    ("add_null_check", SW, lambda f: f.word("@symbol", " ?? defaultValue"), ("Nil coalescing — provide a default value",), 0.5),
    ("cast_type", JS, lambda f: f.put("@line", " as ", "@expected"), ("Type assertion — cast to ", "@expected"), 0.5),
    ("cast_type", JS, lambda f: f.swap(f.actual, "@expected"), ("Change the type annotation from ", "@actual", " to ", "@expected"), 0.6),
    ("cast_type", GO, lambda f: word_replaced(f.line, f.actual, f.expected), ("Type conversion: ", "@expected", "(value)"), 0.6),
    ("cast_type", RS, lambda f: f.put("@rtrimmed", ".into()"), (".into() — convert using the Into trait",), 0.6),
    ("cast_type", RS, lambda f: F.regexp_replace(f.line, r"(?s)\A(.*?)&(\w+)", "$1$2.clone()"), (".clone() — create an owned copy",), 0.5),
    ("cast_type", PY, lambda f: f.put("@expected", "(", "@trimmed", ")"), ("Explicit type conversion to ", "@expected"), 0.5),
    ("update_type_annotation", JS, lambda f: f.swap(f.expected, "@actual", " | ", "@expected"), ("Widen type to union: ", "@actual", " | ", "@expected"), 0.6),
    ("update_type_annotation", JS, lambda f: f.swap(f.actual, "@expected"), ("Narrow to expected type: ", "@expected"), 0.5),
    ("add_missing_return", JS, lambda f: f.put("  return undefined;"), ("Return undefined (safe default)",), 0.5),
    ("add_missing_return", JS, lambda f: f.put("  return null;"), ("Return null (explicit no-value)",), 0.5),
    ("add_missing_return", JS, lambda f: f.put("  throw new Error('Not implemented');"), ("Throw error (make it explicit this needs implementation)",), 0.4),
    ("add_missing_return", PY, lambda f: f.put("  return None"), ("Return None",), 0.6),
    ("add_missing_return", PY, lambda f: f.put("  raise NotImplementedError()"), ("Raise NotImplementedError",), 0.4),
    ("add_missing_return", GO, lambda f: f.put("  return"), ("Empty return (for void functions)",), 0.5),
    ("add_missing_return", GO, lambda f: f.put("  return nil"), ("Return nil (for pointer/interface returns)",), 0.5),
    ("add_missing_return", RS, lambda f: f.put("  todo!()"), ("todo!() macro — marks as unimplemented",), 0.4),
    ("add_missing_return", RS, lambda f: f.put("  Default::default()"), ("Default::default() — zero value for the return type",), 0.5),
    ("initialize_variable", JS, lambda f: F.regexp_replace(f.line, r"(?s)\A(.*?);?\s*\z", "$1 = undefined;"), ("Initialize to undefined",), 0.5),
    ("initialize_variable", JS, lambda f: F.regexp_replace(f.line, r"(?s)\A(.*?);?\s*\z", "$1 = null;"), ("Initialize to null",), 0.5),
    ("initialize_variable", PY, lambda f: f.put("@symbol", " = None"), ("Initialize to None",), 0.6),
    ("fix_syntax", (), lambda f: f.cut(0), ("Insert '", "@token", "' at the error position"), 0.6),
    ("fix_syntax", (), lambda f: F.when(f.column > 0, f.cut(1)), ("Replace character before error with '", "@token", "'"), 0.4),
]


def _braces(line: Column) -> Column:
    n = lambda mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))
    return n("{") - n("}")


def _scan(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """How many lines it takes (from 1) until the running depth of braces stops; null if it never does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("found"))

    def step(s: Column, x: Column) -> Column:
        depth, seen = s.depth + _braces(x), s.seen + 1
        return F.struct(depth.alias("depth"), seen.alias("seen"), F.coalesce(s.found, F.when(stop(depth), seen)).alias("found"))

    return F.aggregate(lines, start, step, lambda s: s.found)


def choices(errors: DataFrame, files: DataFrame) -> DataFrame:
    """(id, nth, code, rationale, confidence, insert_line): candidates of the second tier, from which a caller chooses.

    A line outside its file counts as empty, and no bracket is closed there.
    """
    own = _filled(errors).join(files.select("file", F.split("content", "\n", -1).alias("lines")), "file")
    at, n, c = F.coalesce("line", F.lit(1)).cast("int"), F.size("lines"), F.col
    inside = at.between(1, n)
    safe = F.when(inside, at).otherwise(1)
    line = F.when(inside, F.element_at("lines", safe)).otherwise("")
    quoted = _or_null(F.regexp_extract("message", QUOTED, 1))
    named = F.coalesce(c("symbol"), quoted, F.when(c("strategy") == "initialize_variable", "variable").otherwise("value"))
    typed = lambda name: F.coalesce(c(name), F.when(c("strategy") == "cast_type", "unknown").otherwise(name))
    fault = Fault(line, named, typed("actual"), typed("expected"), F.coalesce(c("token"), _or_null(F.regexp_extract("message", EXPECTED, 1))), F.coalesce(F.when(c("column") > 0, c("column")), F.length(line)).cast("int"))
    ends = F.when(c("strategy") == "add_missing_return", F.coalesce(F.when(inside, safe + _scan(F.slice("lines", safe, n), lambda d: d <= 0) - 1), at) - 1)
    items = []
    for strategy, languages, code, why, sure in RULES:
        fits = (c("strategy") == strategy) & (c("language").isin(*languages) if languages else fault.token.isNotNull())
        item = F.struct(code(fault).alias("code"), fault.put(*why).alias("rationale"), F.lit(sure).alias("confidence"), ends.cast("int").alias("insert_line"))
        items.append(F.when(fits & item.code.isNotNull(), item))
    opened = F.when((c("strategy") == "close_bracket") & inside, _scan(F.reverse(F.slice("lines", 1, safe)), lambda d: d > 0))
    where = safe - opened + 1
    indent = F.regexp_extract(F.element_at("lines", F.coalesce(where, F.lit(1))), r"^(\s*)", 1)
    items.append(F.when(opened.isNotNull(), F.struct(F.concat(indent, F.lit("}")).alias("code"), F.concat(F.lit("Close bracket matching line "), where.cast("string")).alias("rationale"), F.lit(0.7).alias("confidence"), safe.cast("int").alias("insert_line"))))
    found = F.filter(F.array(*items), lambda x: x.isNotNull())
    return own.select("id", F.posexplode(found).alias("nth", "x")).select("id", c("nth").cast("long").alias("nth"), "x.*")


def around(content: Column, line: Column, reach: int = 5) -> Column:
    """The numbered lines about a line, which is marked."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(line - reach, F.lit(1))
    own = F.slice(lines, first, F.greatest(F.least(line + reach, F.size(lines)) - first + 1, F.lit(0)))
    return F.array_join(F.transform(own, lambda x, i: F.concat(F.when(first + i == line, " >>>").otherwise("    "), F.lit(" "), (first + i).cast("string"), F.lit(": "), x)), "\n")


def cascade_risk(n_dependents: Column) -> Column:
    return F.when(n_dependents > 5, "HIGH").when(n_dependents > 2, "MEDIUM").when(n_dependents.isNotNull(), "LOW").otherwise("UNKNOWN")


def checked(files: DataFrame) -> DataFrame:
    """(file, passed, evidence, confidence) of texts by the balance of their braces."""
    off = _braces(F.col("content"))
    return files.select("file", (off == 0).alias("passed"), F.when(off == 0, "basic structure valid").otherwise(F.concat(F.lit("unbalanced braces: "), off.cast("string"))).alias("evidence"), F.when(off == 0, 0.4).otherwise(0.5).alias("confidence"))


def recipes(texts: DataFrame) -> DataFrame:
    """(id, message, fix, diff, file, strategy) of stored recipes that hold a diff."""
    part = lambda p: _trim(F.regexp_extract("content", p, 1))
    own = texts.where(F.contains("content", F.lit("DIFF:")) & F.contains("content", F.lit("FIX:")))
    own = own.select("id", part(r"MESSAGE:\s*(.+)").alias("message"), part(r"FIX:\s*(.+)").alias("fix"), part(r"DIFF:\n([\s\S]*?)(?:\nSTRATEGY:|\z)").alias("diff"), part(r"FILE:\s*(.+)").alias("file"), part(r"STRATEGY:\s*(.+)").alias("strategy"))
    return own.where("diff <> ''").withColumn("strategy", F.when(F.col("strategy") == "", "kb_recipe").otherwise(F.col("strategy")))


def neighbourhood(errors: DataFrame, edges: DataFrame, ranks: DataFrame, most: int = 5) -> DataFrame:
    """(id, risk, dependencies, dependents): the first files that an error's file imports and that import it."""

    def near(key: str, other: str, name: str) -> DataFrame:
        # ranked before the lists are made, so that a file that everything imports makes no long one
        keyed = edges.groupBy(F.col(key).alias("file"), F.col(other).alias("near")).agg(F.min("pos").alias("pos")).join(errors.select("file").distinct(), "file", "left_semi")
        first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("pos", "near"))).where(F.col("nth") <= most)
        return first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("nth", "near"))).alias("x")).select("file", F.transform("x", lambda r: r.near).alias(name))

    out = errors.select("id", "file").join(ranks.select(F.col("node").alias("file"), "n_dependents"), "file", "left")
    out = out.join(near("src", "dst", "dependencies"), "file", "left").join(near("dst", "src", "dependents"), "file", "left")
    none = F.array().cast("array<string>")
    return out.select("id", cascade_risk(F.col("n_dependents")).alias("risk"), F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))
