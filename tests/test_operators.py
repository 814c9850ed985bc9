"""Cases that no table has."""

import math
import os
import random
import re
import time

from pyspark.sql import functions as F

from sagebrush import registry
from sagebrush.functions import text as X
from sagebrush.operators import candidates as A
from sagebrush.operators import chunks as C
from sagebrush.operators import documents as D
from sagebrush.operators import errors as E
from sagebrush.operators import fixes as H
from sagebrush.operators import graph as G
from sagebrush.operators import memory as M
from sagebrush.operators import search as S
from sagebrush.operators import session as V
from sagebrush.operators import skeletons as N
from sagebrush.operators import store as K
from sagebrush.operators import structure as U
from sagebrush.plans import inline as I
from sagebrush.sources import code as P
from sagebrush.sources import web as W


def test_jaccard_of_empty_sets(spark):
    rows = spark.sql("SELECT array() a, array('x') b").select(F.col("a").cast("array<string>").alias("a"), "b")
    assert rows.select(X.jaccard(F.col("a"), F.col("a")), X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("b"), F.col("b"))).first()[:] == (1.0, 0.0, 1.0)


def test_headings(spark):
    got = {r.id: r.c.reason for r in I.HEADINGS.df(spark).select("id", X.heading_class(F.col("line")).alias("c")).collect()}
    want = ["classified_as_heading"] * 3 + ["code_keyword", "cli_command", "file_path", "snake_case", "too_short", "classified_as_heading", "sentence_ending", "classified_as_heading", "too_many_symbols", "ends_with_comma", "too_many_words"]
    want[10] = "classified_as_heading"
    assert [got[k] for k in range(14)] == want
    assert D.clean_heading("databas e design") == "database design"
    assert D.clean_heading("**ﬁnal** _draft_") == "final draft"
    assert len(D.clean_heading("word " * 60)) <= 120


def test_chunks_keep_the_text_and_the_limit():
    own = D.Chunks(40, 8)
    text = "# A\n" + "One two three four. " * 60 + "\n## B\n```\n# no heading\n```\ntail"
    got = list(own.chunk(text, "T"))
    assert [i for i, *_ in got] == list(range(len(got)))
    assert {p for _, p, _ in got} == {"T > A", "T > A > B"}
    assert all(own.tokens(c) <= 40 + 2 * 8 + 2 for *_, c in got)
    assert "# no heading" in got[-1][2]
    assert list(own.chunk("", "T")) == list(own.chunk("  \n ", "T")) == []


def test_cycles_and_depths(spark):
    ranks = {r.node: r for r in G.ranks(spark.createDataFrame([(c,) for c in "abcde"], "node string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")).collect()}
    assert [ranks[x].depth for x in "abcde"] == [0, 1, 1, 2, 0]
    assert [ranks[x].in_cycle for x in "abcde"] == [False, True, True, False, False]
    assert ranks["d"].n_transitive == 3 and ranks["e"].is_root and ranks["e"].is_leaf


def test_imports(spark):
    got = {(r.src, r.raw): r.dst for r in G.resolved(I.IMPORTS.df(spark), I.FILES.df(spark)).collect()}
    assert got["src/a.ts", "./b"] == "src/b.ts" and got["src/a.ts", "./lib"] == "src/lib/index.ts" and got["src/b.ts", "../src/util"] == "src/util.js" and got["src/b.ts", "./gone"] is None
    status = {(r.src, r.raw, r.symbol): r.status for r in G.validated(I.IMPORTS.df(spark), I.FILES.df(spark), I.EXPORTS.df(spark)).collect()}
    assert status["src/a.ts", "./b", "Y"] == "ok" and status["src/a.ts", "react", "useState"] == "external" and status["src/a.ts", "./lib", "L"] == "not_exported"
    assert status["src/b.ts", "./gone", "g"] == "file_not_found" and status["src/b.ts", "./a", None] == "side_effect"


def test_parsers(spark):
    got = {lang: [(r.file, r.line, r.code) for r in E.parsed(I.outputs(I.OUTPUTS[lang]).df(spark), lang).orderBy("id", "nth").collect()] for lang in ("python", "rust", "cpp", "nextjs")}
    assert got["python"] == [("b.py", 9, "PY_VALUE_ERROR")]
    assert got["rust"] == [("src/main.rs", 4, "E0425")]
    assert [c for *_, c in got["cpp"]] == ["CPP_ERROR", "CPP_ERROR", "CPP_LINKER_ERROR"]
    assert [c for *_, c in got["nextjs"]] == ["NEXT_HYDRATION", "NEXT_MODULE_NOT_FOUND", "NEXT_CLIENT_BOUNDARY", "NEXT_SERVER_ERROR", "NEXT_IMAGE"]
    counts = {lang: [r[1:] for r in E.test_counts(I.outputs(I.TESTS[lang]).df(spark), lang).orderBy("id").collect()] for lang in I.TESTS}
    assert counts["go"] == [(2, 1)] and counts["java"] == [(7, 3), (5, 2)] and counts["php"] == [(7, 3)] and counts["cpp"] == [(8, 2), (4, 0)]


def test_greedy_dedupe_keeps_the_slot(spark):
    rows = [(1, 1, 0.5, 10, "a b c d e"), (1, 2, 0.9, 11, "a b c d e"), (1, 3, 0.4, 12, "x y z"), (2, 1, 0.1, 13, "")]
    got = S.deduped(spark.createDataFrame(rows, "query_id int, pos int, score double, id long, content string")).orderBy("query_id", "slot").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 11), (1, 12), (2, 13)]


def test_fusion_of_lists(spark):
    one = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    two = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id long, score double")
    got = {r.id: r.score for r in S.fused([one, two], 10).collect()}
    assert max(got, key=got.get) == 2 and abs(got[1] - 0.5) < 1e-12
    assert S.fused([one, two.limit(0)], 1).first().score == 1.0


def test_memory_gate(spark):
    rows = [(1, 1, "the build uses gradle wrapper", "fact"), (1, 2, "the build uses gradle wrapper now", "fact"), (1, 3, "short", "fact"), (1, 4, "deploys happen on friday mornings", "odd")]
    assert [r.pos for r in V.quality_gate(spark.createDataFrame(rows, "session int, pos int, content string, kind string"), ["fact"]).collect()] == [1]


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta", "go"), (2, "gamma", "rust")], "id long, content string, collection string")
    store = C.ChunkStore(spark, f"{tmp_path}/c", "id")
    store.add(rows)
    store.add(rows.where("id = 2"))
    back = store.read()
    assert back.count() == 3 and K.scroll(back, [{"key": "content", "text": "Beta"}]).first().id == 1


def test_pages_and_files(spark, tmp_path):
    text, title, blocks = W.clean("<title>T</title><nav>menu</nav><article>Hi <b>you</b><pre class='language-py'>print('a long enough block')</pre></article>", 100)
    assert text.startswith("Hi you") and title == "T" and blocks == [{"language": "py", "code": "print('a long enough block')"}]
    assert W.clean(None, 10) == ("", "", [])
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "outer").mkdir()
    for name in ("a.md", "b.bin", "node_modules/c.md", ".hidden.md", ".git/d.md", "outer/.e.md", "outer/node_modules.md"):
        (tmp_path / name).write_text("# Title\nx")
    got = [r.path.rsplit("/", 1)[1] for r in W.files(spark, str(tmp_path)).collect()]
    assert sorted(got) == ["a.md", "node_modules.md"]


def test_streams_equal_batches(spark, tmp_path):
    from sagebrush.streaming import sessions

    rows = [(s, p, "user" if (s + p) % 2 else "assistant") for s in range(3) for p in range(6)]
    schema = "session long, pos long, role string"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = sessions.turn_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("turns").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = V.turns(spark.createDataFrame(rows, schema).withColumn("content", F.lit("x"))).select("session", "pos", "turn")
    assert sorted(map(tuple, spark.table("turns").collect())) == sorted(map(tuple, batch.collect()))


def test_extractions(spark):
    got = [tuple(r) for r in V.extractions(I.RESPONSES.df(spark)).orderBy("id", "nth").collect()]
    assert got == [(1, 0, "fact", "uses tabs", "user"), (2, 0, "fact", "no scope", "project")]


def test_certain_patches_apply(spark):
    texts = I.TEXTS.df(spark)
    got = {r.id: r for r in A.certain(I.FAULTS.df(spark), texts, I.SYMBOLS.df(spark)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert (got[1].line, got[1].new) == (3, "import { User } from './model/types';")
    assert (got[2].kind, got[2].line) == ("delete", 1) and (got[3].old, got[3].new) == ("./types", "./model/types")
    assert got[5].line == 5 and got[6].new == "const u = login(user)"
    rows = A.certain(I.FAULTS.df(spark), texts, I.SYMBOLS.df(spark)).join(I.FAULTS.df(spark).select("id", "file"), "id").join(texts, "file")
    after = {r.id: r.t.split("\n") for r in rows.select("id", H.patched(F.col("content"), F.col("kind"), F.col("line"), F.col("old"), F.col("new")).alias("t")).collect()}
    assert after[1][2] == got[1].new and after[2][0] == "import b from 'b';" and after[3][0] == "import { a } from './model/types';" and after[4][2].endswith(");") and len(after[5]) == 5


def test_relative_paths_and_import_lines(spark):
    rows = spark.createDataFrame([("src/a/b.py", "src/c/d.py"), ("x.py", "y.py"), ("a/b/c.ts", "z.ts"), ("a.ts", "a/b.d.ts")], "s string, t string")
    assert [r[0] for r in rows.select(A.relative(F.col("s"), F.col("t"))).collect()] == ["../c/d", "./y", "../../z", "./a/b.d"]
    lines = rows.limit(1).select(*[A.import_line(F.lit(k), F.lit("./m/n"), F.lit("S")).alias(k) for k in ("python", "go", "rust", "java", "csharp", "php", "swift", "cobol")]).first()
    assert tuple(lines) == ("from m.n import S", '\t"m/n"', "use crate::m::n::S;", "import m.n.S;", "using m.n;", "use m\\n\\S;", "import n", None)


def test_choices(spark):
    got = {}
    for r in A.choices(I.FAULTS.df(spark), I.TEXTS.df(spark)).orderBy("id", "nth").collect():
        got.setdefault(r.id, []).append(r)
    assert sorted(got) == [7, 8, 9, 10, 11]
    assert [r.code for r in got[7]] == ["const u = lgin(user?)", "if (user) {\n  const u = lgin(user)\n}", "const u = lgin(user!)"]
    assert [r.code for r in got[8]] == ["let size: string = 1; as number", "let size: number = 1;"]
    assert [r.code for r in got[10]] == ["if (f(u {)", "if (f(u )"] and got[11][0].rationale == "Close bracket matching line 6"
    assert [r.insert_line for r in got[9]] == [1, 1] and got[7][0].insert_line is None


def test_surroundings_and_braces(spark):
    text = "\n".join(f"l{k}" for k in range(1, 21))
    row = spark.createDataFrame([(text,)], "t string").select(A.around(F.col("t"), F.lit(3)).alias("a"), A.around(F.col("t"), F.lit(20)).alias("b"), A.around(F.col("t"), F.lit(99)).alias("c")).first()
    assert row.a.split("\n")[2] == " >>> 3: l3" and row.a.count("\n") == 7 and row.b.split("\n")[-1] == " >>> 20: l20" and row.c == ""
    assert {r.file: r.evidence for r in A.checked(spark.createDataFrame([("a", "{}"), ("b", "{{}")], "file string, content string")).collect()} == {"a": "basic structure valid", "b": "unbalanced braces: 1"}


def test_functions_of_texts():
    py = "import x\n\ndef f(a):\n    y = a\n\n    return y\n\nz = 1"
    assert U.text_spans(py, "python") == [(3, 6, "f")] and U.text_spans(py, "cobol") == [] and U.text_spans("", "python") == []
    ts = "const n = 1;\nfunction g(a) {\n  const k = { a };\n  return k;\n}\nconst h = (x) => {\n  y();\n}"
    assert U.text_spans(ts, "typescript") == [(2, 5, "g"), (6, 8, "h")] == U.text_spans(ts, "javascript")
    assert U.text_spans("func (s *S) Run(x int) {\n  a()\n}", "go") == [(1, 3, "Run")]
    assert U.text_spans("\n".join(["fn main() {"] + ["x;"] * 99), "rust") == [(1, 51, "main")]
    # what is nested or on one line; a body that goes on after an empty line; a head without a body
    assert U.text_spans("function a() {\n  function b() { c(); }\n  if (x) { y } else { z }\n}\nfunction d() {}", "javascript") == [(1, 4, "a"), (2, 2, "b"), (5, 5, "d")]
    assert U.text_spans("class A:\n    def f(self):\n        def g():\n            pass\n\n        x\n    def h(self):\n    pass\ndef k():\n\n\n", "python") == [(2, 6, "f"), (3, 4, "g"), (7, 8, "h"), (9, 12, "k")]
    assert U.text_spans("} function a() {\n x\n}\nfunction b()\n{\n}", "javascript") == [(4, 6, "b")]


def test_functions_around_places(spark):
    """Cases over seven languages: a place in the body finds its function, one outside of all gets lines around it."""
    files = [
        ("a.ts", "import { db } from './db';\n\nconst load = async (id: string) => {\n  if (!id) {\n    throw id;\n  }\n  return 1;\n};\n\nexport default load;", "typescript"),
        ("b.py", "class S:\n    def __init__(self):\n        self.a = 1\n\n    def get(self, k):\n        if k:\n            raise k\n        return 1\n", "python"),
        ("c.rs", "struct A {}\n\nimpl A {\n    pub fn new() -> Self {\n        A {}\n    }\n\n    pub fn run(&self) -> R {\n        let c = 1;\n    }\n}", "rust"),
        ("d.java", "public class C {\n    @Get\n    public R<U> find(Long id) {\n        if (id == null) {\n            return null;\n        }\n    }\n}", "java"),
        ("e.php", "<?php\nclass C {\n    public function index($r) {\n        return 1;\n    }\n}", "php"), ("f.hs", "\n".join(f"line {k}" for k in range(1, 41)), "haskell"), ("g.ts", None, "typescript"),
    ]
    places = [(1, "a.ts", 5), (2, "b.py", 7), (3, "c.rs", 9), (4, "d.java", 4), (5, "e.php", 4), (6, "f.hs", 20), (7, "g.ts", None), (8, "lost.ts", 3), (9, "b.py", 1), (10, "a.ts", 5), (11, "a.ts", 10)]
    got = {r.id: r for r in U.enclosing_functions(spark.createDataFrame(places, "id long, file string, line long"), spark.createDataFrame(files, "file string, content string, language string")).collect()}
    assert {k: r.name for k, r in got.items()} == {1: "load", 2: "get", 3: "run", 4: "find", 5: "index", 6: None, 7: None, 8: None, 9: None, 10: "load", 11: "load"}
    assert (got[1].start_line, got[1].end_line) == (3, 8) and got[1].code.split("\n")[2] == " >>> 5:     throw id;" and got[1].code.startswith("     3: const load")
    assert (got[6].start_line, got[6].end_line) == (5, 35) and got[7].code == " >>> 1: " and got[9].end_line == 9 and got[2].code.endswith("     8:         return 1\n     9: ")


def test_headings_of_whole_texts(spark):
    text = "**Chapter 2: Big **Ideas**\n\n  **1.2 Data Flow**\n\nPart IV. End\nALL CAPS LINE\n3. Short Title Here\n4. This is a sentence ends.\n2.1 Another Title\n**Bold heading**\n**if bold**\nAppendix A: More"
    assert U.marked_headings(text).split("\n") == [
        "# Chapter 2: Big Ideas", "## 1.2 Data Flow", "# Part IV: End", "## ALL CAPS LINE", "## 3. Short Title Here", "4. This is a sentence ends.",
        "## 2.1 Another Title", "## Bold heading", "**if bold**", "# Appendix A: More",
    ]
    assert U.clean_document("# **Intro**\ntext\n## pip install numpy\n### Chapter 1: Go") == "# Intro\ntext\n**pip install numpy**\n### Chapter 1: Go"
    assert U.text_markdown("MY TITLE\n\nSome words:\nx:") == "## MY TITLE\n### Some words\nx:"
    assert U.marked_headings(None) is U.clean_document(None) is U.text_markdown(None) is None
    lines = [*(t for _, t in I.HEADINGS.rows), "Chapter 1: Go", "2.3 Trees", "a", "WHY NOT", "see /usr/bin/x"]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select("t", X.heading_class(F.col("t")).is_heading.alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: X.is_heading(t) for t in lines}


def test_structural_chunks_with_pages(spark):
    toc = spark.createDataFrame([(1, 1, 2, "early", 1), (1, 2, 1, "One", 3), (1, 3, 2, "A", 4), (1, 4, 3, "Deep", None), (1, 5, 1, "Two", None), (2, 1, 2, "lone", 1)], "doc_id long, pos long, level int, title string, page int")
    got = {(r.doc_id, r.nth): r.content for r in U.structural_chunks(toc, spark.createDataFrame([(1, "T"), (2, "U")], "doc_id long, title string")).collect()}
    assert got[1, 0] == "Document: T\nThis document contains 2 chapters:\n\n1. One (page 3) — 2 sections\n2. Two"
    assert got[1, 1] == "Chapter: One\nStarts at page 3\n\nSections:\n- A (page 4)\n  - Deep" and got[1, 2] == "Chapter: Two"


def test_context_of_several_titles(spark):
    schema = "query_id int, pos int, id long, score double, content string, doc_title string, section string, chunk_type string"
    rows = [(1, 1, 1, 0.9, "alpha text", "A", "s1", "content"), (1, 2, 2, 0.8, "beta words", "B", None, "structural"), (1, 3, 3, 0.1, "gone", "B", None, "content"), (2, 1, 4, 0.6, "one", "C", "", "content")]
    got = {r.query_id: (r.n, r.formatted) for r in S.assembled(spark.createDataFrame(rows, schema), "zz").collect()}
    rule = "\n\n---\n\n"
    assert got[1] == (2, rule.join(['\n── From "A" ──', "[A > s1] [Score: 0.90]\n\nalpha text", '\n── From "B" ──', "[B] [Structure] [Score: 0.80]\n\nbeta words"]))
    assert got[2] == (1, "[Source: C] [Score: 0.60]\n\none")


def test_cases_of_callables(spark):
    rows = N.cases(I.CALLABLES.df(spark), I.CLASSES.df(spark))
    names = [r.name for r in rows.where("file = 'm.py'").orderBy("nth").collect()]
    assert names[0] == "load returns expected output" and names[1] == "load handles path=empty string" and names[-3:] == ["Box can be instantiated", "Box.__init__ works correctly", "Box.open works correctly"]
    assert not any("self" in n or "_own" in n for n in names) and "load handles deep=null" in names
    assert rows.where("file = 'a.ts' and kind = 'async_error'").count() == 1
    script = N.javascript_files(rows, "vitest").first().content
    assert script.startswith("import { describe, test, expect, vi } from 'vitest';") and "const result = await send();" in script and script.endswith("});")
    compile(N.python_files(rows).first().content.replace("Box constructor", "Box"), "m", "exec")


def test_scripts_are_read(spark):
    mods = P.script_modules(I.SOURCES.df(spark))
    imports = [tuple(r) for r in P.listed(mods, "imports").orderBy("pos").select("kind", "raw", "default_symbol", F.array_join("symbols", ","), "is_external", "line").collect()]
    assert imports == [("default_and_named", "react", "React", "useState as useS", True, 1), ("side_effect", "./side", None, "", False, 2), ("type_only_named", "../t", None, "T", False, 3)]
    exports = [(r.kind, r.symbols, r.source) for r in P.listed(mods, "exports").orderBy("pos").collect()]
    assert exports == [("inline_named", ["a"], None), ("inline_named", ["b"], None), ("inline_named", ["c"], None), ("default", ["Main"], None), ("re_export_named", ["a as z"], "./re"), ("re_export_star", [], "./all")]
    defined = [(r.kind, r.name, r.is_exported) for r in P.listed(mods, "definitions").orderBy("pos").collect()]
    assert defined == [("variable", "a", True), ("variable", "b", True), ("variable", "c", True), ("class", "Main", True), ("function", "fn", False), ("variable", "t", False), ("type_alias", "U", False)]
    assert mods.where("file <> 'a.ts' and size(imports) + size(exports) + size(definitions) = 0").count() == 2


def test_python_and_patterns(spark):
    got = {r.file: r for r in P.python_modules(I.MODULES.df(spark)).collect()}
    m = got["m.py"]
    assert (m.functions[0].name, m.functions[0].is_async, m.functions[0].returns, m.functions[0].decorators) == ("f", True, "str", ["deco(1)"])
    assert [(p.name, p.type) for p in m.functions[0].params] == [("a", "int"), ("b", None)] and m.classes[0].bases == ["B"] and m.exports == ["f"]
    assert [(i.raw, i.is_external, i.symbols) for i in m.imports] == [("os", True, []), ("..p", False, ["x", "y"])]
    assert got["bad.py"].error and got["none.py"].error is None and got["none.py"].functions == []
    found = P.pattern_module(I.GO.rows[0][1], [P.Pattern(r'^import\s+"([^"]+)"', "module", ["source"])], [P.Pattern(r"^func\s+([A-Z]\w*)", "named", ["functionName"])], [P.Pattern(r"^func\s+(\w+)", "function"), P.Pattern("(")])
    assert [(i["raw"], i["is_external"], i["line"]) for i in found["imports"]] == [("fmt", False, 2), ("github.com/x/y", True, 3)] and found["packages"] == ["github"]
    assert [e["symbols"] for e in found["exports"]] == [["Run"]] and [d["name"] for d in found["definitions"]] == ["Run"]


def test_explanations(spark):
    from sagebrush import registry

    got = {r.id: tuple(r)[1:] for r in registry.queries()["explained_errors"](spark, "").collect()}
    assert got[1] == (1, "x is odd", "pip install x", "# x") and got[2] == (2, "an error", "look", None)


def test_blocks_of_memory(spark):
    row = spark.sql("SELECT 'fix it' t, array('a', 'b') s, 'next' n, array(named_struct('turn', 3, 'text', 'no')) c, array('x', 'y') d, '' none")
    c = F.col
    got = row.select(M.anchor(c("t"), c("s"), c("n"), c("c"), c("d")), M.anchor(c("none"), c("s"), c("n"), c("c"), c("d")), M.recovery(c("t"), F.lit("bad"), F.lit("other")), M.recovery(c("none"), F.lit("bad"), c("none"))).first()
    assert got[0] == '[TASK] fix it\n[STATUS] ✓ a → ✓ b\n[STEP] next\n[CORRECTIONS]\n  User (turn 3): "no"\n[DO NOT] x. y.' and got[1] == ""
    assert got[2].split("\n") == ["", "[RECOVERY] bad", "Alternative: other", "Continue with the CURRENT task: fix it.", "Do NOT change topic or search for unrelated content."]
    assert got[3].split("\n")[2] == "Continue with your CURRENT task."


def test_synchronisation(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "session long, pos long, content string")
    known = rows((1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "k"), (4, 0, "a"), (4, 1, "b"), (4, 2, "c"), (4, 3, "d"), (5, 0, None))
    seen = rows((1, 0, "a"), (1, 1, "changed"), (1, 2, "c"), (2, 0, "z"), (4, 0, "a"), (5, 0, None), (6, 0, "new"))
    got = sorted((tuple(r) for r in M.synchronised(known, seen).collect()), key=lambda r: r[:2])
    assert got == [(1, 0, "a", "known"), (1, 1, "b", "known"), (1, 2, "c", "appended"), (2, 0, "z", "reset"), (4, 0, "a", "reset"), (5, 0, None, "known"), (6, 0, "new", "appended")]


def test_fallbacks_of_parsers(spark):
    def of(language, *texts):
        rows = E.parsed(I.outputs(list(texts)).df(spark), language).orderBy("id", "nth").collect()
        return [(r.file, r.line, r.code, r.message, r.category) for r in rows]

    assert of("typescript", "a.js:1\n/b/c.ts:22\nTypeError: no such import\nRangeError: x", "RangeError: no place") == [("/b/c.ts", 22, "TypeError", "TypeError: no such import", "import")]
    assert of("python", 'File "a.py", line 3\nTypeError: bad value', "KeyError: 'x'") == [("a.py", 3, "PY_TYPE_ERROR", "TypeError: bad value", "runtime")]
    thrown = 'Exception in thread "main" java.lang.IllegalStateException: oh\n  at a.B.c(B.java:7)\n  at a.D.e(D.java:9)'
    name = "java.lang.IllegalStateException"
    assert of("java", thrown, thrown.split("\n")[0]) == [("B.java", 7, name, f"{name}: oh", "runtime"), ("", 0, name, f"{name}: oh", "runtime")]
    assert of("csharp", "Unhandled exception. System.IO.FileException: type gone", "error NU1101: no package") == [("", 0, "RUNTIME_EXCEPTION", "System.IO.FileException: type gone", "runtime"), ("", 0, "NU1101", "no package", "dependency")]
    assert of("php", "Problem 1\n - needs php 9") == [("composer.json", 0, "COMPOSER_ERROR", "needs php 9", "dependency")]
    assert of("cpp", "undefined reference to `foo'") == [("", 0, "CPP_LINKER_ERROR", "undefined reference to 'foo'", "linker")]
    nest = of("nestjs", *I.OUTPUTS["nestjs"])
    assert [r[2] for r in nest] == ["TS2322", "NEST_DI_RESOLVE", "NEST_CIRCULAR_DEP", "NEST_UNKNOWN_EXPORT", "TypeError"] and nest[1][0] is None and nest[-1][:2] == ("src/app.js", 12)
    assert [r[2] for r in of("reactnative", *I.OUTPUTS["reactnative"])] == ["RN_MODULE_RESOLVE", "RN_INVARIANT", "RN_NATIVE_NULL", "RN_DEV_SERVER", "RN_XCODE", "RN_GRADLE"]


def test_scope_results(spark):
    schema = "id long, pos long, doc_title string, section_path string, chunk_type string, chunk_index long, content string"
    rows = [(k, k, "A", f"s{k}", "content", 10 - k, f"t{k}") for k in range(4)] + [(8, 8, "A", "s3", "summary", 0, "covered"), (9, 9, "A", None, "summary", None, "other"), (7, 4, "B", "s", None, 1, "b")]
    df = spark.createDataFrame(rows, schema)
    assert [r.id for r in K.scope_result(df, 2).orderBy("nth").collect()] == [3, 2, 9]
    assert [r.id for r in K.scope_result(df, 4).orderBy("nth").collect()] == [3, 2, 1, 0]
    assert [tuple(r) for r in K.other_books(df).collect()] == [(1, "B", 1)] and K.scope_result(df.limit(0)).count() == 0
    code = spark.createDataFrame([(1, 1, "B", "x > y", None, 5, "```a```"), (2, 2, "A", None, None, 1, "```b```"), (3, 3, "B", "", None, 2, "```c```"), (4, 4, "A", "z", None, 1, "no code")], schema)
    assert [(r.id, r.shown) for r in K.code_examples(code).orderBy("nth").collect()] == [(3, "\n```c```"), (1, " (y)\n```a```"), (2, "\n```b```")]


def test_titles_of_texts_without_a_line(spark, tmp_path):
    texts = [None, "", " ", "\n \n\t\r\n", "\t\n \r\n  My title \t\r\nB", "\u00a0\u3000\n\u2003é x\ufeff", "x" * 120, f"{'y' * 99}  z\n", "a"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.title, r.text) for r in registry.queries()["text_documents"](spark, str(tmp_path)).collect()}
    titles = [None, None, None, None, "My title", "é x", "x" * 100, f"{'y' * 99} ", "a"]
    assert got == {k: (t, texts[k]) for k, t in enumerate(titles)}


def test_near_duplicate_pairs_cross_lang_and_source(spark, tmp_path):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(300)}" for _ in range(40)] for _ in range(6)]
    texts = [" ".join(w[: 40 - rng.randrange(6)] + [f"own{k}"] * rng.randrange(2)) for k in range(8) for w in base]
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "s", "t", "u"][k % 4]) for k, t in enumerate(texts)] + [(90, None, "en", "s"), (91, "", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set(t.split()) for t in texts]
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    want = {k: v for k, v in want.items() if v > 0.8}
    got = registry.queries()["near_duplicate_pairs_all"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) > 50


def test_bm25_weights_of_all_terms(spark, tmp_path):
    texts = ["the cat and the dog", "the dog", "The bird; a", None, ""]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = [[w for w in re.split("[^a-z0-9]+", (t or "").lower()) if len(w) > 1] for t in texts]
    mean, want = sum(map(len, own)) / len(own), {}
    for k, ws in enumerate(own):
        for w in set(ws):
            tf, df = ws.count(w), sum(w in x for x in own)
            idf = math.log((len(own) - df + 0.5) / (df + 0.5) + 1)
            want[k, w] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    got = {(r.doc_id, r.term): r.weight for r in registry.queries()["bm25_weights_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_similar_pairs_of_common_words_make_few_candidates(spark):
    """All pairs by brute force; texts that share common words only are told apart before pairs are written."""
    import random

    from sagebrush.operators import similar as SP

    rng, texts = random.Random(5), []
    words = [f"w{k}" for k in range(150)]
    for n in (1, 3, 5, 10, 40, 40, 40, 60, 60):
        texts += [rng.sample(words, n) for _ in range(12)]
    wide = [f"x{k}" for k in range(700)]
    texts += [rng.sample(wide, 350) for _ in range(6)]
    for t in list(texts):
        if rng.random() < 0.5:
            texts.append([w for w in t if rng.random() > 0.05] + rng.sample(words, max(1, len(t) // 25)))
        if rng.random() < 0.2:
            texts += [t[::-1], t + t]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(-1, None), (-2, "!?"), (None, rows_text := " ".join(texts[0])), (-3, rows_text), (-3, rows_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(k, set((t or "").split()) if t != "!?" else set()) for k, t in rows if k is not None]
    want = sorted((a, b, round(len(s & t) / len(s | t), 9)) for a, s in sets for b, t in sets if a < b and s and t and len(s & t) / len(s | t) > 0.8)
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in SP.similar_pairs(docs, 0.8, []).collect())
    assert got == want and len(want) > 50
    hashed = docs.where("doc_id >= 0").select(F.col("doc_id").alias("cid"), F.size(F.array_distinct(F.split("text", " "))).alias("n"), F.transform(F.array_distinct(F.split("text", " ")), lambda w: F.xxhash64(w)).alias("h"))
    own = [(a, b) for a, b, _ in want if a >= 0]
    made = SP._alike(hashed, 0.8).collect()
    assert {tuple(sorted(r)) for r in made} >= set(own) and len(made) == len({tuple(r) for r in made}) < 2 * len(own)


def test_similar_pairs_move_each_set_a_few_times(spark, monkeypatch):
    """Near copies of large sets: what is shuffled grows with the sets, not with their pairs, and no shuffle file stays."""
    from sagebrush.operators import similar as SP

    rng, texts = random.Random(7), []
    for g, n in enumerate((130, 40, 3)):
        base = [f"g{g}w{k}" for k in range(400)]
        texts += [[w if rng.random() > 0.04 else f"own{rng.randrange(10**9)}" for w in base] for _ in range(n)]
    texts += [t[::-1] for t in texts[:5]]
    rows = [(k, " ".join(t), ["de", "en"][k % 7 == 0], ["s", None][k % 50 == 9]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).localCheckpoint()
    sets = [set(t) for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    want = {k: round(v, 9) for k, v in want.items() if v > 0.8}
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    def files():
        return {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    was, before = moved(), files()
    pairs = SP.similar_pairs(docs, 0.8, [])
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    got = pairs.collect()
    assert moved() - was < 10 * sum(len(r[1]) for r in rows)
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == want and len(got) == len(want) > 7000
    # groups and blocks in many parts, prefixes in rounds, texts of equal blocks only
    monkeypatch.setattr(SP, "GROUP", 16)
    monkeypatch.setattr(SP, "BLOCK", 12)
    monkeypatch.setattr(SP, "PART", 9)
    monkeypatch.setattr(SP, "PAIRS", 100)
    monkeypatch.setattr(SP, "ROUND", 6000)
    got = SP.similar_pairs(docs, 0.8, ["lang", "source"]).collect()
    want = {(a, b): v for (a, b), v in want.items() if rows[a][2:] == rows[b][2:] and rows[a][3] is not None}
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == want and len(got) == len(want) > 3000


def test_terms_are_counted_in_their_texts(spark):
    """Counts of terms need no shuffle; texts of one id and length still count as one, as in the SQL."""
    from collections import Counter

    texts = [(1, "b a b c"), (2, ""), (3, None), (4, "x"), (5, "a a a")]
    rows = lambda t: spark.createDataFrame(t, "doc_id long, text string").select("doc_id", X.tokens(F.concat_ws(" ", F.regexp_replace("text", r"(\w)", "$1$1"))).alias("t"))
    got = S.counted(rows(texts), "doc_id")
    assert {(r.doc_id, r.len, r.term, r.tf) for r in got.collect()} == {(k, len((t or "").split()), w * 2, n) for k, t in texts for w, n in Counter((t or "").split()).items()}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = S.counted(rows([*texts, (4, "x"), (5, "a")]), "doc_id").collect()
    assert {(r.len, r.term, r.tf) for r in twice if r.doc_id in (4, 5)} == {(1, "xx", 2), (3, "aa", 3), (1, "aa", 1)} and len(twice) == 6
