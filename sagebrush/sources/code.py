"""Source files read into imports, exports and definitions: Python by its own parser, JavaScript and TypeScript by a
scan of top-level statements, other languages by patterns that a caller supplies. Each file is one row of Arrow batches.

A file that can't be parsed gives empty lists and an error. Null content is empty.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names too common to be definitions.
NOISE = frozenset("id name email title description value key type data result error message status count index length size port host path url".split())
# Modules that come with a language, which are no packages.
STDLIB = frozenset(
    """os sys re json datetime typing enum abc collections functools itertools pathlib logging hashlib contextlib dataclasses uuid time math io copy
    string textwrap struct codecs unicodedata difflib calendar random statistics fractions decimal secrets html xml email base64 binascii quopri uu
    http urllib ftplib smtplib imaplib poplib socket ssl select selectors asyncio signal subprocess threading multiprocessing concurrent pickle shelve
    marshal dbm sqlite3 csv configparser tomllib argparse getopt shutil tempfile glob fnmatch stat filecmp zipfile tarfile gzip bz2 lzma unittest
    doctest pdb profile timeit trace tracemalloc warnings inspect dis gc weakref types importlib ast tokenize token keyword linecache traceback
    builtins fmt net sync context errors sort strconv strings bytes bufio runtime reflect testing std core alloc""".split()
)
# The names under which a pattern may capture what it exports, the first that is there counts.
EXPORTED = "symbols symbolName name className functionName interfaceName traitName enumName constName structName typeName".split()

_IMPORT = pa.struct([("kind", pa.string()), ("symbols", pa.list_(pa.string())), ("default_symbol", pa.string()), ("namespace", pa.string()), ("raw", pa.string()), ("is_external", pa.bool_()), ("is_type_only", pa.bool_()), ("line", pa.int32())])
_EXPORT = pa.struct([("kind", pa.string()), ("symbols", pa.list_(pa.string())), ("is_re_export", pa.bool_()), ("source", pa.string()), ("line", pa.int32())])
_DEFINITION = pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("is_exported", pa.bool_()), ("parents", pa.list_(pa.string()))])
_FUNCTION = pa.struct([("name", pa.string()), ("params", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))), ("is_async", pa.bool_()), ("line", pa.int32()), ("returns", pa.string()), ("decorators", pa.list_(pa.string()))])
_CLASS = pa.struct([("name", pa.string()), ("methods", pa.list_(pa.string())), ("bases", pa.list_(pa.string())), ("line", pa.int32())])
MODULE = {"imports": pa.list_(_IMPORT), "exports": pa.list_(_EXPORT), "definitions": pa.list_(_DEFINITION), "packages": pa.list_(pa.string()), "error": pa.string()}
PYTHON = {"functions": pa.list_(_FUNCTION), "classes": pa.list_(_CLASS), "imports": pa.list_(_IMPORT), "exports": pa.list_(pa.string()), "error": pa.string()}


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in t) + ">"
    return {"string": "string", "bool": "boolean", "int32": "int"}[str(t)]


def _read(files: DataFrame, columns: dict[str, pa.DataType], one: Callable[[str], dict]) -> DataFrame:
    """(file, the columns) of what a function finds in each file's content."""

    def run(batches):
        for batch in batches:
            got = [one(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g.get(c) for g in got], t) for c, t in columns.items())], ["file", *columns])

    return files.select("file", "content").mapInArrow(run, ", ".join(["file string", *(f"{c} {_ddl(t)}" for c, t in columns.items())]))


def _import(kind: str, raw: str, external: bool, line: int, symbols=(), default=None, namespace=None, type_only=False) -> dict:
    return {"kind": kind, "symbols": list(symbols), "default_symbol": default, "namespace": namespace, "raw": raw, "is_external": external, "is_type_only": type_only, "line": line}


# -- Python ----------------------------------------------------------------------------------------------------------


def python_module(text: str) -> dict:
    """Top-level functions, classes, imports and the names of __all__ of a Python source."""
    out: dict = {"functions": [], "classes": [], "imports": [], "exports": [], "error": None}
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
        return out | {"error": str(x)}
    for node in body:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                params = [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None} for a in node.args.args]
                out["functions"].append({"name": node.name, "params": params, "is_async": isinstance(node, ast.AsyncFunctionDef), "line": node.lineno, "returns": ast.unparse(node.returns) if node.returns else None, "decorators": [ast.unparse(d) for d in node.decorator_list]})
            case ast.ClassDef():
                methods = [x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
                out["classes"].append({"name": node.name, "methods": methods, "bases": [ast.unparse(b) for b in node.bases], "line": node.lineno})
            case ast.Import():
                out["imports"] += [_import("module", a.name, True, node.lineno, namespace=a.asname) for a in node.names]
            case ast.ImportFrom():
                out["imports"].append(_import("named", "." * node.level + (node.module or ""), not node.level, node.lineno, [a.name for a in node.names]))
            case ast.Assign(value=ast.List() | ast.Tuple()) if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
                out["exports"] += [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return out


def python_modules(files: DataFrame) -> DataFrame:
    """(file, functions, classes, imports, exports, error) of Python sources (file, content)."""
    return _read(files, PYTHON, python_module)


# -- JavaScript and TypeScript ---------------------------------------------------------------------------------------

_QUIET = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`""", re.S)
_FROM = r"""\bfrom\s*(?P<q>['"])(?P<raw>[^'"\n]+)(?P=q)"""
_IMPORTS = re.compile(rf"""import\s+(?:(?P<type>type)\s+(?![,\s]*from\b))?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\*\s*as\s+(?P<ns>[\w$]+)\s*|(?P<named>\{{[^}}]*\}})\s*)?{_FROM}|import\s*(?P<q2>['"])(?P<bare>[^'"\n]+)(?P=q2)""")
_EXPORTS = re.compile(
    rf"""export\s+(?:type\s+)?(?P<list>\{{[^}}]*\}})(?:\s*{_FROM})?|export\s*\*\s*(?:as\s+(?P<alias>[\w$]+)\s*)?{_FROM.replace("<q>", "<q3>").replace("<raw>", "<star>").replace("=q)", "=q3)")}"""
    r"""|export\s+default\s+(?:(?:abstract\s+)?(?:async\s+)?(?:class|function)\b\s*\*?\s*)?(?P<default>(?!class\b|function\b|async\b|extends\b|new\b)[A-Za-z_$][\w$]*)?"""
)
_DEFINED = re.compile(
    r"(?P<export>export\s+(?P<default>default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?P<word>function|class|interface|type|enum|const\s+enum|const|let|var)\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^\n;{]*)"
)
_CALLED = re.compile(r"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|[\w$]+\s*=>|\([^)]*\)\s*(?::[^=\n]+)?=>)")
_PARENTS = re.compile(r"\b(?:extends|implements)\s+([\w$.,\s]+?)(?=\bimplements\b|$)")
KINDS = {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum", "const enum": "enum"}


def _entries(braced: str) -> list[str]:
    """`a`, or `a as b`, of each entry of a braced list."""
    parts = (re.sub(r"\s+", " ", x).strip() for x in braced.strip("{} \n\t").split(","))
    return [re.sub(r"^type ", "", p) for p in parts if p]


def _further(bare: str, at: int):
    """(name, place) of the other variables of a declaration; `at` is behind the first one's name."""
    depth, angle, typed, before = 0, 0, False, ""
    for k in range(at, len(bare)):
        c = bare[k]
        depth += (c in "([{") - (c in ")]}")
        if depth < 0 or (depth == 0 and (c == ";" or c == "\n" and before not in (",", "=", ":", "|", "&"))):
            return
        if depth == 0:
            typed = c == ":" or (typed and c not in "=,") or angle > 0
            angle += typed * ((c == "<") - (c == ">" and angle > 0))
            if c == "," and not angle and (m := re.compile(r"\s*([A-Za-z_$][\w$]*)").match(bare, k + 1)):
                yield m[1], m.start(1)
        before = c if not c.isspace() else before


def script_module(text: str) -> dict:
    """Top-level imports, exports and definitions of a JavaScript or TypeScript source.

    Comments, strings and everything in brackets are passed over; what is neither at the start of a statement nor on
    the top level is none. Destructured variables are left out.
    """
    quoted = {m.start(): m for m in _QUIET.finditer(text)}
    blank = lambda m, keep: m[0] if keep and m[0][0] in "'\"" else re.sub(r"[^\n]", " ", m[0])
    code = _QUIET.sub(lambda m: blank(m, True), text)
    bare = _QUIET.sub(lambda m: blank(m, False), text) if quoted else text
    depth, deep, line, lines = 0, bytearray(len(bare)), 1, []
    for k, c in enumerate(bare):
        deep[k] = depth > 0
        lines.append(line)
        depth += (c in "{([") - (c in "})]")
        line += c == "\n"
    out: dict = {"imports": [], "exports": [], "definitions": [], "packages": [], "error": None}
    for m in re.finditer(r"(?:^|(?<=[;}\n]))[ \t]*(?=(?:import|export|declare|abstract|async|function|class|interface|type|enum|const|let|var)\b)", bare):
        at = m.end()
        if deep[at]:
            continue
        if found := _IMPORTS.match(code, at):
            raw, named = found["raw"] or found["bare"], _entries(found["named"] or "")
            default, space = found["default"], found["ns"]
            kind = "namespace" if space else "default_and_named" if default and named else "default" if default else "named" if named else "side_effect"
            outside = raw[0] not in "./"
            out["imports"].append(_import(("type_only_" if found["type"] else "") + kind, raw, outside, lines[at], named, default, space, bool(found["type"])))
            if outside:
                out["packages"].append("/".join(raw.split("/")[: 2 if raw[0] == "@" else 1]))
            continue
        own = _DEFINED.match(code, at)
        if own and own["rest"].lstrip().startswith("from ") or (own and own["word"] == "type" and "=" not in code[own.end("name") : own.end("name") + 500].split("\n\n")[0]):
            own = None
        exported = bool(own and own["export"])
        names = [(own["name"], own.start("name"))] if own else []
        if own and own["word"] in ("const", "let", "var"):
            names += _further(bare, own.end("name"))
        if exported and not own["default"]:
            out["exports"] += [{"kind": "inline_named", "symbols": [n], "is_re_export": False, "source": None, "line": lines[at]} for n, _ in names]
        elif found := _EXPORTS.match(code, at):
            source = found["raw"] or found["star"]
            if found["list"]:
                entry = ("re_export_named" if source else "named"), _entries(found["list"])
            elif found["star"]:
                entry = ("re_export_star_as", [found["alias"]]) if found["alias"] else ("re_export_star", [])
            else:
                entry = "default", [found["default"] or "default"]
            out["exports"].append({"kind": entry[0], "symbols": entry[1], "is_re_export": bool(source), "source": source, "line": lines[at]})
        for name, place in names:
            kind, parents = KINDS.get(re.sub(r"\s+", " ", own["word"])), []
            if kind is None:
                kind = "function" if _CALLED.match(bare, place + len(name)) else "variable"
            elif kind in ("class", "interface"):
                lists = _PARENTS.findall(re.sub(r"<[^>]*>", "", own["rest"]))
                parents = [p for x in lists for p in re.split(r"[\s,]+", x) if p]
            out["definitions"].append({"kind": kind, "name": name, "line": lines[place], "is_exported": exported, "parents": parents})
    named = {s for e in out["exports"] for s in e["symbols"]}
    for d in out["definitions"]:
        d["is_exported"] = d["is_exported"] or d["name"] in named
    return out | {"packages": list(dict.fromkeys(out["packages"]))}


def script_modules(files: DataFrame) -> DataFrame:
    """(file, imports, exports, definitions, packages, error) of JavaScript and TypeScript sources (file, content)."""
    return _read(files, MODULE, script_module)


# -- by patterns -----------------------------------------------------------------------------------------------------


@dataclass
class Pattern:
    """A pattern for imports, exports or definitions: `names` of its groups in order; `listed` is the separator of `symbols`."""

    pattern: str
    kind: str = "named"
    names: list[str] = field(default_factory=list)
    listed: str | None = None
    exported: bool = True


def pattern_module(text: str, imports: list[Pattern], exports: list[Pattern], definitions: list[Pattern]) -> dict:
    """What patterns find in a source. A pattern that is none is passed over."""

    def found(rules: list[Pattern]):
        for p in rules:
            try:
                matcher = re.compile(p.pattern, re.M)
            except re.error:
                continue
            for m in matcher.finditer(text):
                groups = {n: m[k] for k, n in enumerate(p.names, 1) if k <= (m.re.groups or 0)}
                yield p, m, groups, text.count("\n", 0, m.start()) + 1

    split = lambda raw, by: [s.strip() for s in raw.split(by) if s.strip()]
    out: dict = {"imports": [], "exports": [], "definitions": [], "packages": [], "error": None}
    for p, _, g, line in found(imports):
        raw = g.get("source") or g.get("module") or g.get("defaultSymbol") or ""
        one = g.get("defaultSymbol") or g.get("alias")
        symbols = split(g["symbols"], p.listed) if p.listed and g.get("symbols") else [one.strip()] if one else []
        root = re.split(r"[./]", raw)[0]
        outside = not raw.startswith((".", "/", "app.", "app/", "src.", "src/")) and root not in STDLIB
        out["imports"].append(_import(p.kind, raw, outside, line, symbols, g.get("defaultSymbol"), g.get("alias")))
        if outside and root:
            out["packages"].append(root)
    seen: set[str] = set()
    for p, _, g, line in found(exports):
        raw = next((g[n] for n in EXPORTED if g.get(n)), "")
        new = [s for s in dict.fromkeys(split(raw, p.listed) if p.listed else [raw.strip()] if raw else []) if s not in seen]
        seen.update(new)
        if new:
            out["exports"].append({"kind": p.kind, "symbols": new, "is_re_export": bool(g.get("source")), "source": g.get("source"), "line": line})
    known: set[tuple] = set()
    for p, m, _, line in found(definitions):
        name = m[1] if m.re.groups else None
        if name and 2 <= len(name) < 100 and name.lower() not in NOISE and (name, line) not in known:
            known.add((name, line))
            out["definitions"].append({"kind": p.kind, "name": name, "line": line, "is_exported": p.exported, "parents": []})
    return out | {"packages": list(dict.fromkeys(out["packages"]))}


def pattern_modules(files: DataFrame, imports: list[Pattern], exports: list[Pattern], definitions: list[Pattern]) -> DataFrame:
    """(file, imports, exports, definitions, packages, error) of sources (file, content) by patterns."""
    return _read(files, MODULE, lambda text: pattern_module(text, imports, exports, definitions))


def listed(modules: DataFrame, what: str) -> DataFrame:
    """(file, pos, fields): one row for each entry of a list of modules, in its order."""
    return modules.select("file", F.posexplode(what).alias("pos", "x")).select("file", F.col("pos").cast("long").alias("pos"), "x.*")
