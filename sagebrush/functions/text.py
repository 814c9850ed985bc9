"""Column functions over text, paths and arrays: all built-in, so they stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, 2 to 50 characters long."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x).between(2, 50))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != ""))


def term_counts(terms: Column) -> Column:
    """(term, n) of each distinct term of an array: it is sorted, and runs are counted by where they start."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        # an array of one holds what is used more than once
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))[0]

    return F.transform(F.array(F.array_sort(terms)), runs)[0]


def word_set(text: Column | str) -> Column:
    """Distinct words of three characters or more, by white space, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 if one is empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def chunk_tokens(text: Column) -> Column:
    """Estimate by words, a third more for text full of punctuation."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[{}()\[\];:,.<>=+\-*/&|!@#$%^~`]", ""))
    base = F.ceil(words / 0.75)
    return F.when(marks > words * 0.3, F.ceil(base * 1.3)).otherwise(base)


def message_tokens(text: Column) -> Column:
    """Estimate by characters: 3 to a token in text with many marks, else 3.8."""
    n = F.length(text)
    marks = n - F.length(F.regexp_replace(text, r"[{}()\[\];:=<>!&|+\-*/\\@#$%^~`]", ""))
    return F.when(n == 0, 0).otherwise(F.ceil(n / F.when(marks / n > 0.08, 3.0).otherwise(3.8)))


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: Column | None = None) -> Column:
    """The first rule of which the text contains a word."""
    out = reduce(lambda w, r: w.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in r[1]]), r[0]), rules, F)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def extension(path: Column) -> Column:
    """With its dot, lower case; empty where a name has none or only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*(\.[^./\\]*)$", 1))


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def language_of(path: Column) -> Column:
    return lookup(extension(path), T.LANGUAGES)


def framework_of(path: Column) -> Column:
    return first_match(F.lower(path), T.FRAMEWORKS)


def collection_of(path: Column, language: Column | None = None) -> Column:
    language = lookup(language, T.LANGUAGE_ROUTES) if language is not None else F.lit(None).cast("string")
    return first_match(F.lower(path), T.ROUTES, F.coalesce(language, F.lit("general")))


def format_of(path: Column, content: Column) -> Column:
    ext = extension(path)
    known = F.when(ext == ".pdf", "pdf").when(ext.isin(".html", ".htm"), "html").when(ext.isin(".md", ".mdx"), "markdown").when(ext.isin(".txt", ".rst"), "text")
    known = known.when(ext.isin(*T.CODE_FILES), "code")
    return known.when(content.startswith("<!DOCTYPE") | content.startswith("<html"), "html").when(content.rlike(r"\A#{1,3}\s"), "markdown").otherwise("text")


def content_type(text: Column) -> Column:
    fences = F.floor((F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 6)
    share = F.least(fences * 10 / F.size(F.split(text, "\n", -1)), F.lit(1.0))
    return F.when(share > 0.5, "code").when(share > 0.1, "mixed").otherwise("prose")


def doc_type(text: Column) -> Column:
    head = F.substring(text, 1, 500)
    return reduce(lambda w, r: w.when(head.rlike(r[1]), r[0]), T.DOC_TYPES, F).otherwise("reference")


def query_class(query: Column) -> Column:
    """scope, code_examples, error, structural, conceptual or api, by the first pattern found; else general."""
    some = lambda ps: reduce(lambda a, b: a | b, [query.rlike(p) for p in ps])
    return reduce(lambda w, c: w.when(some(c[1]), c[0]), T.QUERY_CLASSES, F).otherwise("general")


def tech_of(query: Column, label: Column | None = None) -> Column:
    """By the label given, exactly or in part, else by the words of the query."""
    by_query = first_match(F.lower(query), T.TECH)
    if label is None:
        return by_query
    low = F.lower(F.trim(label))
    part = reduce(lambda w, kv: w.when(F.contains(low, F.lit(kv[0])) | F.contains(F.lit(kv[0]), low), kv[1]), T.TECH_LABELS.items(), F)
    return F.when(F.coalesce(label, F.lit("")) == "", by_query).otherwise(F.coalesce(lookup(low, T.TECH_LABELS), part.otherwise(F.lit(None).cast("string")), by_query))


def collections_for(kind: Column, tech: Column) -> Column:
    """The collections that a query is sent to, in order."""
    every = F.array(*map(F.lit, T.CONTENT))
    first = F.array_distinct(F.concat(F.array(tech), every))
    error = F.filter(F.array_distinct(F.array(F.lit("fix_recipes"), tech, F.lit("general"))), lambda x: x.isNotNull())
    wide = kind.isin("scope", "code_examples", "structural")
    return F.when(kind == "error", error).when(tech.isNull(), every).when(wide, first).otherwise(F.array_distinct(F.array(tech, F.lit("general"))))


def heading_class(line: Column) -> Column:
    """struct(is_heading, confidence, reason) of a line."""
    t = F.trim(line)
    words = F.size(F.split(t, r"\s+"))
    no = lambda c, why: F.struct(F.lit(False).alias("is_heading"), F.lit(c).alias("confidence"), F.lit(why).alias("reason"))
    letters, solid = F.length(F.regexp_replace(t, "[^a-zA-Z]", "")), F.length(F.regexp_replace(t, r"\s", ""))
    score = F.lit(0.5) + F.when(t.rlike("^[A-Z]"), 0.1).otherwise(0.0) + F.when(words <= 6, 0.15).otherwise(0.0)
    score = score + F.when(t.rlike(r"(?i)^(Chapter|Section|Part|Appendix|Module|Unit|Lesson|Topic)\b"), 0.25).otherwise(0.0)
    score = score + F.when(t.rlike(r"^\d+(\.\d+)+\s"), 0.2).otherwise(0.0) + F.when((t == F.upper(t)) & words.between(2, 8), 0.2).otherwise(0.0)
    yes = F.struct((score >= 0.6).alias("is_heading"), F.least(score, F.lit(1.0)).alias("confidence"), F.when(score >= 0.6, "classified_as_heading").otherwise("low_confidence").alias("reason"))
    rules = [
        (F.length(t) < 2, 1.0, "too_short"), (words > 12, 0.9, "too_many_words"),
        (t.rlike(r"[.!?]\z") & ~t.rlike(r"(?i)^(Chapter|Section|Part|Appendix)\b"), 0.85, "sentence_ending"),
        (t.rlike(r"[{}\[\]=;`]"), 0.95, "code_syntax"), (t.rlike(r"^[%$>]|^#!"), 0.95, "shell_command"),
        (t.rlike(rf"(?i)^({'|'.join(T.CLI_WORDS)})\b"), 0.9, "cli_command"),
        (t.rlike(r"^[~./]|(?i)/(usr|bin|home|etc|var|opt|tmp)/"), 0.85, "file_path"), (t.rlike(r"\b\w+_\w+\b"), 0.9, "snake_case"),
        (t.rlike(rf"\b({'|'.join(T.CODE_WORDS)})\b"), 0.85, "code_keyword"), ((solid > 0) & (letters / solid < 0.5), 0.8, "too_many_symbols"),
        (t.rlike(r",\s*\z"), 0.8, "ends_with_comma"), (t.rlike(r"^\d+\z"), 1.0, "purely_numeric"),
    ]
    return reduce(lambda w, r: w.when(r[0], no(r[1], r[2])), rules, F).otherwise(yes)


def is_heading(text: str) -> bool:
    """What heading_class says of one trimmed line, outside Spark."""
    words, solid = text.split(), re.sub(r"\s", "", text)
    named = re.match(r"(?i)(Chapter|Section|Part|Appendix)\b", text)
    code = (r"[{}\[\]=;`]", r"^[%$>]|^#!", rf"(?i)^({'|'.join(T.CLI_WORDS)})\b", r"^[~./]|(?i:/(usr|bin|home|etc|var|opt|tmp)/)", r"\b\w+_\w+\b", rf"\b({'|'.join(T.CODE_WORDS)})\b", r",\s*$", r"^\d+$")
    if len(text) < 2 or len(words) > 12 or (re.search(r"[.!?]$", text) and not named) or any(re.search(p, text) for p in code):
        return False
    if solid and len(re.sub("[^a-zA-Z]", "", text)) / len(solid) < 0.5:
        return False
    signs = (
        (0.1, re.match("[A-Z]", text)), (0.15, len(words) <= 6), (0.25, re.match(r"(?i)(Chapter|Section|Part|Appendix|Module|Unit|Lesson|Topic)\b", text)),
        (0.2, re.match(r"\d+(\.\d+)+\s", text)), (0.2, text == text.upper() and 2 <= len(words) <= 8),
    )
    return sum((s for s, found in signs if found), 0.5) >= 0.6


def hint_of(text: Column) -> Column:
    """struct(suggestion, type, applicability, raw) of the first compiler hint, or null."""
    out = F
    for pattern, kind, sure in T.HINTS:
        found = F.struct(F.trim(F.regexp_extract(text, pattern, 1)).alias("suggestion"), F.lit(kind).alias("type"), F.lit(sure).alias("applicability"), F.regexp_extract(text, pattern, 0).alias("raw"))
        out = out.when(text.rlike(pattern), found)
    return out


def semver(version: Column) -> Column:
    """array of major, minor and patch; what is no number counts as 0."""
    parts = F.split(F.regexp_replace(F.trim(version), "^v", ""), r"\.")
    part = lambda i: F.coalesce(F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))
    return F.array(part(1), part(2), part(3))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def resized(vector: Column, dim: int) -> Column:
    """Cut, or filled with zeros."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


# -- small accessors -------------------------------------------------------------------------------------------------


def normal_separators(path: Column) -> Column:
    """A path with forward slashes only."""
    return F.translate(path, "\\", "/")


def short_hash(text: Column, size: int = 12) -> Column:
    """The first characters of a text's SHA-256."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, size)


def age_in_minutes(then: Column, now: Column) -> Column:
    """`3m`: the minutes between two times in milliseconds, rounded half up."""
    return F.concat(F.floor((now - then) / 60000 + 0.5).cast("string"), F.lit("m"))


def tool_path(arguments: Column) -> Column:
    """The file of a tool call whose arguments are JSON, an object or a string that holds one."""
    inner = F.coalesce(F.get_json_object(arguments, "$"), arguments)
    one = lambda name: F.coalesce(F.get_json_object(arguments, f"$.{name}"), F.get_json_object(inner, f"$.{name}"))
    return F.coalesce(one("filepath"), one("file_path"))


def latest_stable(versions: Column) -> Column:
    """The first version of a list without a pre-release part, else the last of the list."""
    return F.coalesce(F.try_element_at(F.filter(versions, lambda v: ~F.contains(v, F.lit("-"))), F.lit(1)), F.try_element_at(versions, F.lit(-1)))


def satisfies_minimum(version: Column, minimum: Column) -> Column:
    """Whether a version is at least another one."""
    return semver(version) >= semver(minimum)


def major_version(version: Column) -> Column:
    return semver(version)[0]


def quantised(vector: Column, quantile: float = 0.99) -> Column:
    """int8 codes of a vector: the quantile of its absolute values is 127, what lies beyond is cut."""
    own = F.array_sort(F.transform(vector, lambda e: F.abs(e.cast("double"))))
    top = lambda a: F.element_at(a, F.greatest(F.lit(1), F.ceil(F.size(a) * quantile).cast("int")))
    code = lambda e, t: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(e.cast("double") / F.when(t == 0, 1.0).otherwise(t) * 127).cast("int")))
    return F.when(F.size(vector) > 0, F.transform(F.array(top(own)), lambda t: F.transform(vector, lambda e: code(e, t)))[0]).otherwise(F.array().cast("array<int>"))
