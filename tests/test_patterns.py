"""Patterns by automaton against the nested loop, and catalogs read from files."""

import json
import random
import re

from pyspark.sql import functions as F

from sagebrush.operators import errors as E
from sagebrush.operators import patterns as P


def test_what_patterns_require():
    sets = lambda p: sorted(sorted(s) for s in P.required(p))
    assert sets(r"Cannot find name '(\w+)'") == [["cannot find name '"]] and sets("(?:abc|def)+x*ghij?") == [["abc", "def"], ["ghi"]]
    assert sets(r"[abc]+\d") == sets("ab|cd") == sets("(") == sets("abc|[x]") == sets("") == []
    assert sets("(?<name>hello) (?=world)") == [["hello"], ["world"]] and sets("(?!world)xyz") == [["xyz"]] and sets("abcédef") == [["abc"], ["def"]]


def test_matches_equal_the_nested_loop(spark):
    rng = random.Random(2)
    words = ["error", "Cannot", "find", "module", "name", "type", "é", "42", "'x'", "(", "ABC"]
    lines = [None, "", *(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(400))]
    patterns = [None, "", "error.*name", "(?i)cannot find (module|name|type)", r"(?:error|ABC) \d+", r"\d{2}", "name$|^type", "(error )+find", "type(?! name)", "(?i)abc", "abc", "é 42", r"\(.*'x'", "zzz", "(?<a>find) (?<b>mod)"]
    rules = [(k * 3, p) for k, p in enumerate(patterns)]
    want = sorted((i, r) for i, t in enumerate(lines) for r, p in rules if t is not None and p is not None and re.search(p.replace("(?<a", "(?P<a").replace("(?<b", "(?P<b"), t))
    made, own = spark.createDataFrame(list(enumerate(lines)), "id long, text string"), spark.createDataFrame(rules, "rule long, pattern string")
    got = P.matches(made.withColumn("nth", F.lit(1)), own).select("id", "rule").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 300
    first = {r.id: r.rule for r in P.first_matches(made, own).collect()}
    assert first == {i: min(r for j, r in want if j == i) for i, _ in want}
    # most candidates match, and far fewer patterns are run than there are
    run = P.candidates(made, own).count()
    assert run < 2.5 * len(want) and run < 0.5 * len(lines) * len(patterns)
    assert P.matches(made, own.limit(0)).count() == P.matches(made.limit(0), own).count() == 0


def test_catalogs_of_files(spark, tmp_path):
    rule = lambda k, match, **x: {"id": k, "category": "c", "severity": "error", "match": match, "captures": ["name"], "rootCause": f"{k} {{name}}", "prescription": "p", "codeBlock": None, "conditions": [], **x}
    own, mine = tmp_path / "own", tmp_path / "mine"
    own.mkdir()
    mine.mkdir()
    (own / "go.json").write_text(json.dumps({"technology": "go", "version": 1, "patterns": [rule("A", r"undefined: (\w+)"), rule("B", r"unused (\w+)")]}))
    (own / "py.json").write_text(json.dumps({"technology": "python", "patterns": [rule("C", r"name '(\w+)'", conditions=[{"when": "name equals x", "rootCause": "is x"}])]}, indent=2))
    (own / "bad.json").write_text("{")
    (own / "note.txt").write_text("no catalog")
    (mine / "go.json").write_text(json.dumps({"technology": "go", "patterns": [rule("D", r"undefined: (\w+)")]}))
    assert sorted(r.id for r in P.load_rules(spark, str(own)).collect()) == ["A", "B", "C"]
    rules = P.load_rules(spark, str(own), str(mine))
    assert sorted(r.id for r in rules.collect()) == ["C", "D"]
    numbered = rules.withColumn("pos", F.when(F.col("id") == "C", 1).otherwise(2).cast("long"))
    messages = spark.createDataFrame([(1, "go", "undefined: foo"), (2, "python", "name 'x'"), (3, "go", "name 'x'"), (4, "go", None)], "id long, technology string, message string")
    assert dict(map(tuple, E.diagnosed(messages, numbered).collect())) == {1: 2, 2: 1}
    assert {r.id: r.root_cause for r in E.explained(messages, numbered).collect()} == {1: "D foo", 2: "is x"}
