"""Compiler and test output: error rows, crash detection, classification by a catalog, and an order of repair.

A language is data: patterns with the groups that give file, line, column, code and message. Rows come from
`regexp_extract_all` in the JVM; a later pattern of a language counts only where an earlier one found nothing, unless
it is marked as additional.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import patterns


@dataclass(frozen=True)
class Form:
    """A pattern and its groups; a group of 0 stands for the constant beside it.

    `at` finds the place (file and line) elsewhere in the output: its last match, without which there is no error, or
    with `first` its first, if any. `named` puts the code before the message. `coded` makes a code of an error's name.
    Errors of a form with `nowhere` have no file and line. `category` is the form's own, where the message decides none.
    """

    pattern: str
    file: int = 0
    line: int = 0
    column: int = 0
    code: int = 0
    message: int = 0
    constant: str = ""
    prefix: str = ""
    suffix: str = ""
    at: str = ""
    first: bool = False
    named: bool = False
    coded: str = ""
    nowhere: bool = False
    category: str = ""
    place: str = ""
    #: One of these, in lower case, is in every text that the pattern matches; others are not searched by it.
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Language:
    forms: tuple[Form, ...]
    crash: tuple[str, ...] = ()
    passed: tuple[str, ...] = (r"(\d+)\s+passed",)
    failed: tuple[str, ...] = (r"(\d+)\s+failed",)
    kinds: tuple[tuple[str, str], ...] = ()
    #: Looked for in any case, behind what the forms found.
    extra: tuple[Form, ...] = field(default=())
    #: Looked for where neither forms nor extra forms found anything.
    last: tuple[Form, ...] = ()


_TSC = Form(r"(?m)^(.+?)\((\d+),(\d+)\):\s*error\s+(TS\d+):\s*(.+)$", 1, 2, 3, 4, 5)
_NODE = Form(r"(?m)^(\w+Error):\s*(.+)$", code=1, message=2, named=True, at=r"(?m)^(.+\.(?:js|ts|jsx|tsx|mjs|cjs)):(\d+)\b")
_JS_CRASH = ("TypeError:", "ReferenceError:", "SyntaxError:", "RangeError:", r"(?i)unhandled\s+promise\s+rejection", "ECONNREFUSED", "EADDRINUSE", "Cannot find module")
_JS_KINDS = (("syntax|parse|unexpected", "syntax"), ("cannot find module|import|require", "import"), ("type|property.*does not exist|not assignable", "type"))
_NEXT_KINDS = (_JS_KINDS[0], ("cannot find module|import|require|can't resolve", "import"), _JS_KINDS[2], ("hydration", "hydration"))
_RN_KINDS = (_JS_KINDS[0], ("cannot find module|import|require|unable to resolve", "import"), _JS_KINDS[2])



def _note(pattern: str, code: str, category: str, *needs: str) -> Form:
    """An error that is its whole match, without a place."""
    return Form(pattern, message=-1, constant=code, nowhere=True, category=category, needs=needs)


# The formats of compilers, runtimes and test runners.
LANGUAGES = {
    "typescript": Language((_TSC, _NODE), _JS_CRASH, kinds=_JS_KINDS),
    "python": Language(
        (Form(r"(?m)^(\w+Error):\s*(.+)$", code=1, message=2, named=True, coded="PY_%s_ERROR", at=r'File "([^"]+)", line (\d+)'),),
        (r"Traceback \(most recent call last\)", r"(?m)^\w+Error:", "SystemExit", "Segmentation fault", "Killed"),
        kinds=(("syntax|parse|indent|tab", "syntax"), ("import|module|no module", "import"), ("type|expected|incompatible|argument", "type"), ("name.*not defined|undefined", "import"), ("attribute", "type")),
    ),
    "go": Language(
        (Form(r"([^\s:]+\.go):(\d+):(\d+)?:?\s*(.+)", 1, 2, 3, 0, 4, "GO_ERROR"),),
        ("panic:", "goroutine .* deadlock", "nil pointer dereference", "fatal error", "signal: segmentation fault", "runtime error"),
        ("#ok\\s+",), ("#FAIL\\s+",),
        (("syntax|unexpected|parse", "syntax"), ("cannot find package|undefined|undeclared|not found", "import"), ("type|cannot use|incompatible|cannot convert", "type")),
    ),
    "rust": Language(
        (Form(r"error(?:\[(E\d{4})\])?:\s*([^\n]+)(?:[\s\S]*?-->\s*([^:\n]+):(\d+):(\d+))?", 3, 4, 5, 1, 2, "RUST_ERROR"),),
        ("panic!", "thread .* panicked", "stack overflow", "segfault", "SIGSEGV", "process didn't exit successfully"),
        kinds=(("syntax|unexpected|parse", "syntax"), ("cannot find|unresolved|not found in", "import"), ("type|mismatch|expected|mismatched", "type"), ("borrow|lifetime|move|ownership", "borrow")),
    ),
    "java": Language(
        (Form(r"([^\s:]+\.(?:java|kt)):(\d+):\s*(?:error:\s*)?(.+)", 1, 2, 0, 0, 3, "JAVA_ERROR"), Form(r"Exception in thread .+\s+(.+Exception):\s*(.+)", code=1, message=2, named=True, at=r"at\s+\S+\(([^:]+):(\d+)\)", first=True)),
        ("Exception in thread", r"at .+\.java:\d+", "OutOfMemoryError", "StackOverflowError", "NullPointerException", "ClassNotFoundException", "NoClassDefFoundError"),
        (r"(\d+)\s+tests?\s+completed",), (r"(\d+)\s+failed",),
        (("syntax|parse|expected|illegal", "syntax"), ("cannot find symbol|cannot resolve|package.*does not exist", "import"), ("incompatible types|type mismatch|cannot be converted", "type"), ("nullpointer", "null")),
    ),
    "csharp": Language(
        (
            Form(r"([^(\s]+)\((\d+),(\d+)\):\s*(?:error|warning)\s+(CS\d+):\s*(.+)", 1, 2, 3, 4, 5),
            Form(r"Unhandled exception\.\s*(System\.\w+(?:\.\w+)?Exception):\s*(.+)", code=1, message=2, named=True, constant="RUNTIME_EXCEPTION", category="runtime"),
            Form(r"error\s+(NU\d+):\s*(.+)", code=1, message=2, category="dependency"),
        ),
        ("Unhandled exception", r"System\.\w+Exception", "Stack Trace:", "Process terminated", "StackOverflowException", "OutOfMemoryException", "AccessViolationException"),
        (r"(?i)Passed:\s*(\d+)", r"(\d+)\s+passed"), (r"(?i)Failed:\s*(\d+)", r"(\d+)\s+failed"),
        (("syntax|unexpected|parse", "syntax"), ("cannot be found|does not exist|not found", "import"), ("cannot convert|type|mismatch|expected", "type"), ("null", "null")),
    ),
    "php": Language(
        (
            Form(r"(?:PHP\s+)?(?:Fatal error|Parse error|Warning|TypeError|ValueError):\s*(.+?)\s+in\s+(\S+?)\s+on\s+line\s+(\d+)", 2, 3, 0, 0, 1, "PHP_ERROR"),
            Form(r"(Illuminate\\[A-Za-z\\]+Exception):\s*(.+)", code=1, message=2, named=True, constant="LARAVEL_EXCEPTION", category="runtime"),
            Form(r"Problem\s+\d+\s*\n\s*-\s*(.+)", message=1, constant="COMPOSER_ERROR", category="dependency", place="composer.json"),
        ),
        ("PHP Fatal error", "Parse error", "Uncaught Exception", "Uncaught Error", "Stack trace:", "Segmentation fault", "Allowed memory size of"),
        (r"Tests:\s*(\d+)",), (r"Failures:\s*(\d+)",),
        (("parse error|syntax error|unexpected", "syntax"), ("class .* not found|interface .* not found|not found", "import"), ("type|expected|incompatible|argument|return", "type"), ("undefined variable|undefined property", "reference"), ("cannot redeclare|already defined", "duplicate"), ("memory|timeout|max_execution", "resource")),
    ),
    "cpp": Language(
        (
            Form(r"([^\s:]+\.(?:cpp|cc|cxx|c|hpp|h)):(\d+):(\d+):\s*(?:error|fatal error):\s*(.+)", 1, 2, 3, 0, 4, "CPP_ERROR"),
            Form(r"undefined reference to [`'](.+?)['`]", message=1, constant="CPP_LINKER_ERROR", prefix="undefined reference to '", suffix="'", category="linker"),
        ),
        ("Segmentation fault", "(?i)bus error", "(?i)abort", "undefined reference", "core dumped", "SIGSEGV", "SIGABRT"),
        (r"(?i)(\d+)\s+tests?\s+passed", r"\[\s+PASSED\s+\]\s+(\d+)"), (r"(?i)(\d+)\s+tests?\s+failed", r"\[\s+FAILED\s+\]\s+(\d+)"),
        (("syntax|expected|parse|stray|missing", "syntax"), ("no such file|not found|cannot find|include", "import"), ("type|cannot convert|incompatible|invalid conversion", "type"), ("undefined reference|multiple definition", "linker")),
    ),
    "nestjs": Language(
        (_TSC,), (*_JS_CRASH, "Nest can't resolve", "(?i)circular dependency"), kinds=(*_JS_KINDS, ("resolve dependencies|circular", "dependency-injection")), last=(_NODE,),
        extra=(
            _note(r"Nest can't resolve dependencies of the (\w+)", "NEST_DI_RESOLVE", "dependency-injection"),
            _note(r"(?i)A circular dependency has been detected|circular dependency", "NEST_CIRCULAR_DEP", "dependency-injection"),
            _note(r"(?i)Unknown\s+export\s+(\w+)\s+from\s+module\s+(\w+)", "NEST_UNKNOWN_EXPORT", "dependency-injection"),
        ),
    ),
    "nextjs": Language(
        (_TSC,), (*_JS_CRASH, "Hydration failed", "Server Error", "NEXT_NOT_FOUND"), kinds=_NEXT_KINDS, last=(_NODE,),
        extra=(
            _note(r"(?m)Error:\s*Hydration failed because.*$", "NEXT_HYDRATION", "hydration"),
            _note(r"(?i)You're importing a component that needs\s+(.+)", "NEXT_CLIENT_BOUNDARY", "boundary"),
            _note(r"(?i)Server Error[:\s]+(.+)", "NEXT_SERVER_ERROR", "runtime"),
            _note(r"(?i)Module not found:\s*Can't resolve\s+'([^']+)'", "NEXT_MODULE_NOT_FOUND", "import"),
            _note(r"(?i)Image.*(?:missing|required).*(?:width|height|src)", "NEXT_IMAGE", "component"),
        ),
    ),
    "reactnative": Language(
        (_TSC,), (*(c for c in _JS_CRASH if c != "EADDRINUSE"), "Invariant Violation", "Native module.*cannot be null", "Unable to resolve module"), kinds=_RN_KINDS, last=(_NODE,),
        extra=(
            _note(r"""(?i)error:\s*Unable to resolve module\s+['"]?([^'"]+)['"]?""", "RN_MODULE_RESOLVE", "import", "unable to resolve module"),
            _note(r"(?i)Invariant Violation:\s*(.+)", "RN_INVARIANT", "runtime", "invariant violation:"),
            _note(r"(?i)Native module\s+(\S+)\s+cannot be null", "RN_NATIVE_NULL", "native", "native module"),
            _note(r"(?i)Could not connect to development server", "RN_DEV_SERVER", "network", "could not connect to development server"),
            _note(r"(?i)Could not determine the dependencies of task\s+'([^']+)'", "RN_GRADLE", "build", "could not determine the dependencies of task"),
            _note(r"(?i)Build failed|Signing requires a development team", "RN_XCODE", "build", "build failed", "signing requires a development team"),
        ),
    ),
}


def _rows(raw: Column, form: Form) -> Column:
    """array of struct(file, line, column, code, message, said, category) of all matches of a form.

    `said` is what the category is told by: the message before it is dressed.
    """
    text = lambda g, p=form.pattern: F.regexp_extract_all(raw, F.lit(p), F.lit(g))
    whole, none = text(0), F.lit(None).cast("string")
    got = {n: text(max(g, 0)) if g else F.transform(whole, lambda _: F.lit("")) for n, g in (("file", form.file), ("line", form.line), ("col", form.column), ("code", form.code), ("message", form.message))}
    place, line = F.lit(form.place), F.lit("0")
    if form.at:
        nth = 1 if form.first else -1
        place, line = (F.try_element_at(text(g, form.at), F.lit(nth)) for g in (1, 2))

    def row(x: Column) -> Column:
        code = x["code"] if form.code and not (form.constant and form.named) else F.lit("")
        if form.coded:
            a, b = form.coded.split("%s")
            code = F.concat(F.lit(a), F.upper(F.regexp_replace(code, r"Error\z", "")), F.lit(b))
        said = F.trim(x["message"])
        message = F.concat(x["code"], F.lit(": "), said) if form.named else F.concat(F.lit(form.prefix), said, F.lit(form.suffix))
        file = none if form.nowhere else F.trim(x["file"]) if form.file else F.coalesce(place, F.lit(""))
        number = F.lit(None).cast("int") if form.nowhere else F.coalesce((x["line"] if form.line else line).try_cast("int"), F.lit(0))
        own = F.lit(form.category) if form.category else none
        return F.struct(file.alias("file"), number.alias("line"), x["col"].try_cast("int").alias("column"), F.when(code == "", form.constant).otherwise(code).alias("code"), message.alias("message"), said.alias("said"), own.alias("category"))

    rows = F.transform(F.arrays_zip(*[c.alias(n) for n, c in got.items()]), row)
    # an error whose place is the last frame is the first of its kind, and none without a place
    return F.when(place.isNotNull() & (line.try_cast("int") > 0), F.slice(rows, 1, 1)).otherwise(F.slice(rows, 1, 0)) if form.at and not form.first else rows


_NO_ROWS = "array<struct<file:string,line:int,column:int,code:string,message:string,said:string,category:string>>"


def _needed(raw: Column, form: Form) -> Column:
    """The rows of a form; texts without any of what it needs have none and are not searched."""
    if not form.needs:
        return _rows(raw, form)
    low = F.lower(raw)
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in form.needs]), _rows(raw, form)).otherwise(F.array().cast(_NO_ROWS))


def _chain(raw: Column, forms: tuple[Form, ...]) -> Column:
    """The rows of the first form that finds any."""
    return reduce(lambda later, form: (lambda r: F.when(F.size(r) > 0, r).otherwise(later))(_rows(raw, form)), reversed(forms[:-1]), _rows(raw, forms[-1]))


def parsed(outputs: DataFrame, language: str) -> DataFrame:
    """Error rows (id, nth, file, line, column, code, message, category) of raw outputs (id, raw)."""
    own = LANGUAGES[language]
    raw = F.coalesce("raw", F.lit(""))
    rows = F.concat(_chain(raw, own.forms), *[_needed(raw, form) for form in own.extra])
    if own.last:
        rows = F.when(F.size(rows) > 0, rows).otherwise(_chain(raw, own.last))
    out = outputs.select("id", F.posexplode(rows).alias("nth", "e")).select("id", F.col("nth").cast("long").alias("nth"), "e.*")
    low = F.lower("said")
    kind = reduce(lambda w, k: w.when(low.rlike(k[0]), k[1]), own.kinds, F).otherwise("runtime")
    return out.withColumn("category", F.coalesce("category", kind)).drop("said")


def crashed(outputs: DataFrame, language: str) -> DataFrame:
    return outputs.select("id", reduce(lambda a, b: a | b, [F.coalesce("raw", F.lit("")).rlike(p) for p in LANGUAGES[language].crash]).alias("crashed"))


def test_counts(outputs: DataFrame, language: str) -> DataFrame:
    """(id, passed, failed): the last pattern that is found counts; `#` marks patterns whose matches are counted."""
    raw, own = F.coalesce("raw", F.lit("")), LANGUAGES[language]

    def number(patterns):
        one = lambda p: F.regexp_count(raw, F.lit(p[1:])).cast("long") if p[0] == "#" else F.regexp_extract(raw, p, 1).try_cast("long")
        return F.coalesce(*[one(p) for p in reversed(patterns)], F.lit(0).cast("long"))

    passed, failed = number(own.passed), number(own.failed)
    if language == "java":
        maven = [F.regexp_extract(raw, r"Tests run:\s*(\d+),\s*Failures:\s*(\d+),\s*Errors:\s*(\d+)", g).try_cast("long") for g in (1, 2, 3)]
        return outputs.select("id", F.coalesce(maven[0] - maven[1] - maven[2], passed - failed).alias("passed"), F.coalesce(maven[1] + maven[2], failed).alias("failed"))
    if language == "php":
        failed = failed + number((r"Errors:\s*(\d+)",))
        passed = F.greatest(passed - failed, F.lit(0).cast("long"))
    return outputs.select("id", passed.alias("passed"), failed.alias("failed"))


def classified(errors: DataFrame, catalog: DataFrame) -> DataFrame:
    """errors with the catalog's probability of another file being the cause (0.5 if unknown) and a type."""
    last = catalog.groupBy("code").agg(F.max_by(F.struct("probability", "strategy", "cross_file", "co_codes"), "pos").alias("c"))
    out = errors.join(last, "code", "left").withColumn("probability", F.coalesce("c.probability", F.lit(0.5)))
    kind = F.when(F.col("c").isNull(), "unknown").when(F.col("probability") > 0.5, "likely_cross_file").otherwise("likely_local")
    return out.withColumn("type", kind).withColumn("strategy", F.col("c.strategy")).withColumn("cross_file", F.coalesce("c.cross_file", F.lit(False))).withColumn("co_codes", F.col("c.co_codes")).drop("c")


def fix_order(errors: DataFrame, ranks: DataFrame) -> DataFrame:
    """(file, n_errors, score, queue, auto_resolved, nth): the order in which files should be repaired.

    errors has pos, file, code, probability, type, origin, co_codes; ranks has node, depth, n_dependents, n_transitive,
    is_root, is_leaf, is_hub. Codes and origins that occur are looked up by joins on distinct values.
    """
    codes = errors.select(F.col("code").alias("co")).distinct().withColumn("there", F.lit(1))
    co = errors.select("pos", F.explode("co_codes").alias("co")).join(codes, "co").groupBy("pos").agg(F.count("*").alias("co_count"))
    origins = errors.where("origin is not null and origin <> file").select(F.col("origin").alias("file")).distinct().withColumn("is_origin", F.lit(True))
    rows = errors.join(co, "pos", "left").withColumn("co_count", F.coalesce("co_count", F.lit(0)))
    local = F.col("origin").isNull() | (F.col("origin") == F.col("file"))
    groups = rows.groupBy("file").agg(
        F.count("*").alias("n_errors"), F.min("pos").alias("first"), F.max("co_count").alias("co_count"), F.max(F.col("probability") > 0.5).alias("cross"),
        F.max(local).alias("some_local"), F.min(local).alias("all_local"), F.collect_set(F.when(~local, F.col("origin"))).alias("origins"),
    )
    own = groups.join(ranks.withColumnRenamed("node", "file"), "file", "left").join(origins, "file", "left")
    own = own.select("*", F.coalesce("depth", F.lit(0)).alias("d"), *[F.coalesce(c, F.lit(v)).alias(f"_{c}") for c, v in (("is_root", False), ("is_leaf", True), ("is_hub", False))])
    have = groups.select(F.col("file").alias("only"), F.lit(True).alias("origin_failed"))
    own = own.withColumn("only", F.when(F.size("origins") == 1, F.col("origins")[0])).join(have, "only", "left")
    when = lambda c, v: F.when(c, v).otherwise(0)
    near = F.least(F.when(F.coalesce("n_transitive", F.lit(0)) > 0, F.col("n_transitive")).otherwise(F.coalesce("n_dependents", F.lit(0))), F.lit(20))
    score = (
        when(F.col("cross"), F.col("d") * 30) - when(F.col("co_count") >= 2, 25) - when(F.col("_is_hub") & F.col("some_local"), near + 10)
        - when(F.col("_is_leaf") & F.col("all_local"), 30) + when(F.col("_is_hub") & F.col("cross"), 50) + when(F.col("n_errors") > 10, 15)
    )
    first = F.coalesce("is_origin", F.lit(False)) | (F.col("_is_hub") & F.col("some_local")) | (F.col("co_count") >= 2) | (F.col("_is_root") & (F.coalesce("n_dependents", F.lit(0)) > 0))
    out = own.select("file", "n_errors", score.cast("long").alias("score"), F.when(first, "queue1").otherwise("queue2").alias("queue"), F.coalesce("origin_failed", F.lit(False)).alias("auto_resolved"), "first")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("queue").orderBy("score", "first")).cast("long")).drop("first")


def diagnosed(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule) of the first rule (pos, technology, pattern) of a message's technology that matches it.

    An automaton over what the patterns require picks the rules to run on a message; see `patterns`.
    """
    hits = _matching(messages.select("id", "technology", F.col("message").alias("text")), rules.select("pos", "technology", "pattern"))
    return hits.groupBy("id").agg(F.min("rule").alias("rule"))


def _matching(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages (technology, text, others) with the columns of each rule (pos, technology, pattern, others) of their technology that matches."""
    own = rules.withColumn("rule", F.col("pos").cast("long"))
    met = patterns.candidates(messages, own.select("rule", "pattern").where("pattern is not null"))
    named = own.select(*[F.col(c).alias("rule_id" if c == "id" else "of" if c == "technology" else c) for c in own.columns if c != "pos"])
    hits = met.join(F.broadcast(named), "rule")  # a catalog
    return hits.where((F.col("technology") == F.col("of")) & F.expr("text rlike pattern")).drop("of")


def explained(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule, root_cause, prescription, code_block) of the first rule that matches a message, filled with its captures.

    Rules: pos, technology, pattern, captures (names of the groups in order), root_cause, prescription, code_block and
    conditions (`when`: a capture's name, contains, startsWith, equals or endsWith, and a value; then its own texts).
    The first condition that holds overrides the texts; where it has none, the rule's own stay.
    """
    hits = _matching(messages.select("id", "technology", F.col("message").alias("text")), rules).withColumnRenamed("text", "message")
    one = hits.groupBy("id").agg(F.min_by(F.struct("rule", "message", "pattern", "captures", "root_cause", "prescription", "code_block", "conditions"), "rule").alias("r")).select("id", "r.*")
    one = one.withColumn("got", F.expr("transform(captures, (c, i) -> struct(c as name, regexp_extract(message, pattern, i + 1) as value))"))
    word = "element_at(filter(got, g -> g.name = split(c.`when`, ' ', 3)[0]), 1).value"
    value = "split(c.`when`, ' ', 3)[2]"
    holds = f"case split(c.`when`, ' ', 3)[1] when 'contains' then contains({word}, {value}) when 'startsWith' then startswith({word}, {value}) when 'endsWith' then endswith({word}, {value}) when 'equals' then {word} = {value} else false end"
    one = one.withColumn("c", F.expr(f"try_element_at(filter(conditions, c -> coalesce({holds}, false)), 1)"))
    fill = lambda k: F.expr(f"aggregate(got, coalesce(c.{k}, {k}), (s, g) -> replace(s, concat('{{', g.name, '}}'), g.value))").alias(k)
    return one.select("id", "rule", fill("root_cause"), fill("prescription"), fill("code_block"))


#: Captures that name the symbol an error is about, in this order (fixed values); else the first capture.
SYMBOL_CAPTURES = ("symbol", "symbolName", "name", "expected", "wrong")


def captured(errors: DataFrame, catalog: DataFrame) -> DataFrame:
    """errors with their catalog's last row: probability, type, hint, co_codes and `captures` (name, value).

    Catalog: code, pos, probability, message_pattern, captures (names of the groups in order), refinements (check,
    target, probability, trace), fix_hint, co_codes. A group that caught nothing is no capture.
    """
    fields = [F.col(c) for c in ("probability", "message_pattern", "captures", "refinements", "fix_hint", "co_codes")]
    last = catalog.groupBy("code").agg(F.max_by(F.struct(*fields), "pos").alias("c"))
    own = errors.join(last, "code", "left")
    got = "transform(c.captures, (n, i) -> struct(n as name, regexp_extract(message, c.message_pattern, i + 1) as value))"
    own = own.withColumn("captures", F.expr(f"coalesce(filter(case when message rlike c.message_pattern then {got} end, g -> g.value <> ''), cast(array() as array<struct<name:string,value:string>>))"))
    probability = F.coalesce("c.probability", F.lit(0.5))
    kind = F.when(F.col("c").isNull(), "unknown").when(probability > 0.5, "likely_cross_file").otherwise("likely_local")
    co = F.coalesce("c.co_codes", F.array().cast("array<string>"))
    return own.withColumns({"known": F.col("c").isNotNull(), "probability": probability, "type": kind, "fix_hint": F.col("c.fix_hint"), "refinements": F.col("c.refinements"), "co_codes": co}).drop("c")


def clean_symbol(symbol: Column) -> Column:
    """A symbol's own name, without the one it is imported as."""
    return F.trim(F.substring_index(symbol, " as ", 1))


def located(errors: DataFrame, catalog: DataFrame, imports: DataFrame, definitions: DataFrame, hops: int = 5) -> DataFrame:
    """(id, file, code, captures, probability, type, origin, chain, fix_hint, co_codes): where errors come from.

    imports: file, symbols, dst (null if not resolved), external, pos; definitions: file, name. Of a catalog row's
    refinements the first that holds sets probability and type: the target's capture is imported (its file is the
    origin), defined in the file, or part of an external import. An origin is followed along imports of the symbol
    through at most `hops` files. A likely foreign error without an origin gets the first import that names a capture.
    """
    own = captured(errors, catalog)
    sides = imports.select(F.col("file").alias("at"), F.explode("symbols").alias("s"), "dst", "external", "pos")
    local = sides.where("not external").withColumn("symbol", clean_symbol(F.col("s"))).groupBy("at", "symbol").agg(F.min_by(F.struct("dst"), "pos").alias("first"), F.min_by("dst", F.when(F.col("dst").isNotNull(), F.col("pos"))).alias("resolved"), F.min(F.when(F.col("dst").isNotNull(), F.col("pos"))).alias("resolved_pos"))
    checks = own.select("id", F.col("file").alias("at"), "captures", F.posexplode("refinements").alias("nth", "r"))
    checks = checks.withColumn("value", F.expr("try_element_at(filter(captures, g -> g.name = r.target), 1).value")).where("value is not null").drop("captures")
    imported = checks.where("r.check = 'is_imported'").join(local.withColumnRenamed("symbol", "value"), ["at", "value"]).select("id", "nth", "r", F.col("first.dst").alias("origin"))
    defined = checks.where("r.check = 'is_local'").join(definitions.select(F.col("file").alias("at"), F.col("name").alias("value")).distinct(), ["at", "value"]).select("id", "nth", "r", F.lit(None).cast("string").alias("origin"))
    outside = checks.where("r.check = 'is_external'").join(sides.where("external").select("at", "s"), "at").where("contains(s, value)").select("id", "nth", "r", F.lit(None).cast("string").alias("origin"))
    held = imported.unionByName(defined).unionByName(outside).groupBy("id").agg(F.min_by(F.struct("r", "origin"), "nth").alias("h"))
    own = own.join(held, "id", "left")
    own = own.withColumns({"probability": F.coalesce("h.r.probability", "probability"), "type": F.coalesce("h.r.trace", "type"), "origin": F.col("h.origin")}).drop("h", "refinements")
    named = [F.expr(f"try_element_at(filter(captures, g -> g.name = '{n}'), 1).value") for n in SYMBOL_CAPTURES]
    own = own.withColumn("symbol", F.coalesce(*named, F.expr("try_element_at(captures, 1).value")))
    # the chain of files from the origin on; the file itself and files met before end it
    step = local.select("at", "symbol", F.col("first.dst").alias("next"))
    now = own.select("id", "symbol", F.col("origin").alias("at"), F.array("file").alias("seen"), F.array().cast("array<string>").alias("chain"))
    for _ in range(hops):
        now = now.withColumn("go", F.col("at").isNotNull() & ~F.array_contains("seen", F.coalesce("at", F.lit(""))))
        longer = lambda c: F.when(F.col("go"), F.concat(c, F.array("at"))).otherwise(F.col(c)).alias(c)
        now = now.select("id", "symbol", F.when(F.col("go"), F.col("at")).alias("at"), longer("seen"), longer("chain")).join(step, ["at", "symbol"], "left")
        now = now.select("id", "symbol", F.when(F.col("next") != F.col("at"), F.col("next")).alias("at"), "seen", "chain")
    own = own.join(now.select("id", "chain"), "id").withColumn("origin", F.coalesce(F.try_element_at("chain", F.lit(-1)), "origin"))
    names = own.where("known and probability > 0.5 and origin is null").select("id", F.col("file").alias("at"), F.explode("captures.value").alias("symbol"))
    guess = names.join(local, ["at", "symbol"]).where("resolved is not null").groupBy("id").agg(F.min_by("resolved", "resolved_pos").alias("guess"))
    own = own.join(guess, "id", "left").withColumn("origin", F.coalesce("origin", "guess"))
    return own.select("id", "file", "code", "captures", "probability", "type", "origin", "chain", "fix_hint", "co_codes")


def plan_stats(order: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of a fix_order and its errors: errors, groups of each queue, groups that others resolve."""
    n = errors.agg(F.count("*").alias("errors"))
    groups = order.agg(F.count_if(F.col("queue") == "queue1").alias("root_cause_groups"), F.count_if(F.col("queue") == "queue2").alias("isolated_groups"), F.count_if("auto_resolved").alias("auto_resolvable"))
    return n.crossJoin(groups)  # one row each


def error_report(errors: DataFrame, most: int = 3) -> DataFrame:
    """(file, n, shown): the first errors of a file in order, and how many more there are."""
    nth = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    rows = errors.withColumn("nth", nth)
    line = F.when(F.col("nth") <= most, F.struct("nth", F.concat_ws(": ", "code", "message").alias("s")))
    out = rows.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x.s), "\n")
    return out.select("file", "n", F.when(F.col("n") > most, F.concat(text, F.lit("\n... and "), F.col("n") - most, F.lit(" more"))).otherwise(text).alias("shown"))
