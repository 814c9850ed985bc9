"""Keyed state and sinks: any cut of the rows into batches, replays and kills give what the table gives."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sagebrush import registry, ship
from sagebrush.operators import session as V
from sagebrush.sources.snapshots import Snapshots
from sagebrush.streaming import memory as M
from sagebrush.streaming import sessions, sinks

SF = "/root/testdata/sf0.001"
EVENT = "session long, pos long, ts timestamp, kind string, text string, turn long, top string"


@pytest.fixture
def streams(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ship(spark)
    M.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def fed(spark, rows, schema, folder, cuts, run):
    """Feeds rows cut into batches to a stream, which is stopped and started again between them; gives all that came out."""
    source, out = f"{folder}/in", f"{folder}/out"
    for k, part in enumerate(cuts(rows)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        made = run(spark.readStream.schema(schema).parquet(source))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def cut(n):
    return lambda rows: [rows[len(rows) * k // n : len(rows) * (k + 1) // n] for k in range(n)]


def plain_memory(rows):
    """Lists that lose their first entry when they are too long, one session after the other."""
    out, state = [], {}
    for s, pos, _, kind, text, turn, top in sorted(rows, key=lambda r: (r[0], r[1])):
        m = state.setdefault(s, {"task": "", "status": [], "step": "", "fix": [], "no": [], "found": []})
        text, similar = text or "", None
        if kind == "task":
            m |= {"task": text, "status": [], "step": "", "no": []}
        elif kind == "reset":
            m |= {"task": "", "status": [], "step": "", "fix": [], "no": [], "found": []}
        elif kind == "step":
            m["step"] = text
        elif kind == "status":
            m["status"] = (m["status"] + [text])[-5:]
        elif kind == "correction":
            m["fix"] = (m["fix"] + [(text, turn)])[-5:]
        elif kind == "do_not":
            m["no"] = ([t for t in m["no"] if t != text] + [text])[-3:]
        elif kind == "search":
            mine, similar = {w for w in text.lower().split() if len(w) > 2}, 0
            for q, t in m["found"]:
                other = {w for w in q.lower().split() if len(w) > 2}
                share = (1.0 if not mine and not other else 0.0) if not mine or not other else len(mine & other) / len(mine | other)
                similar += t == top and share > 0.2
            m["found"] = (m["found"] + [(text, top)])[-20:]
        out.append((s, pos, M.anchor(m["task"], m["status"], m["step"], m["fix"], m["no"]), len(m["found"]), similar))
    return sorted(out)


def happenings(n, seed):
    rng, t = random.Random(seed), datetime.datetime(2024, 1, 1)
    kinds = ["task", "status", "status", "step", "correction", "do_not", "search", "search", "search", "reset"]
    rows = []
    for pos in range(n):
        kind = rng.choices(kinds, [1, 6, 6, 3, 4, 4, 8, 8, 8, 0.3])[0]
        text = rng.choice([None, "", " ".join(rng.choices(["build", "tree", "graph", "error", "of"], k=3))])
        rows.append((rng.randrange(4), pos, t + datetime.timedelta(seconds=pos), kind, text, pos // 3, rng.choice(["a", "b", None])))
    return rows


@pytest.mark.parametrize("batches", [1, 4])
def test_working_memory_in_any_cut(streams, tmp_path, batches):
    rows = happenings(260, batches)
    want = plain_memory(rows)
    if batches == 1:
        table = M.working_memory(streams.createDataFrame(rows, EVENT)).collect()
        assert sorted((r.session, r.pos, r.anchor, r.searches, r.similar) for r in table) == want and any((r.similar or 0) >= 3 for r in table)
        assert M.working_memory(streams.createDataFrame([], EVENT)).count() == 0
    got = fed(streams, rows, EVENT, tmp_path, cut(batches), M.working_memory).collect()
    assert sorted((r.session, r.pos, r.anchor, r.searches, r.similar) for r in got) == want and not any(r.expired for r in got)


def test_idle_sessions_end(streams, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    rows = [(1, 0, at(0), "task", "old", 0, None), (2, 1, at(1), "task", "other", 0, None), (2, 2, at(500), "status", "on", 0, None), (3, 3, at(1000), "task", "new", 0, None), (1, 4, at(1001), "status", "back", 0, None)]
    run = lambda s: M.working_memory(s.withWatermark("ts", "0 seconds"), 100_000)
    got = fed(streams, rows, EVENT, tmp_path, lambda r: [r[:2], r[2:3], r[3:4], r[4:]], run).collect()
    ended = {(r.session, r.pos, r.anchor) for r in got if r.expired}
    assert (1, 0, "[TASK] old") in ended and (2, 2, "[TASK] other\n[STATUS] ✓ on") in ended
    # what comes after the end starts anew
    assert [r.anchor for r in got if r.session == 1 and r.pos == 4] == [""]


def test_tool_results(spark):
    rows = [("write_file", "a/b.ts", "✓ written"), ("write_file", "b.ts", "Error: x"), ("edit_file", None, "applied"), ("run_bash", None, "hello"), ("run_bash", None, "success"), ("run_bash", None, "blocked"), ("build_and_test", None, "found 3 errors"), ("build_and_test", None, "0 errors"), ("build_and_test", None, "FAIL"), ("start_server", None, None), ("test_endpoint", None, "fail"), ("other", None, "x")]
    made = M.tool_events(spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "session long, pos long, tool string, file string, result string").withColumn("ts", F.lit(None).cast("timestamp")))
    got = {}
    for r in made.orderBy("pos").collect():
        got.setdefault(r.pos // 2, []).append(r.text)
    fix, check = "Fix the build errors", "Verify the changes work correctly"
    assert got == {0: ["b.ts written"], 1: ["Failed to write b.ts"], 2: [" edited"], 4: ["Command succeeded"], 5: ["Command failed"], 6: ["Build: 3 errors", fix], 7: ["Build succeeded", check], 8: ["Build failed", fix], 9: ["Server started"], 10: ["Endpoint test failed"]}
    said = spark.range(1).select(M.repetition_warning(F.lit(3), F.lit(4)).alias("a"), M.repetition_warning(F.lit(2), F.lit(4)).alias("b")).first()
    assert "searched 4 similar" in said.a and said.b is None


# -- sinks -----------------------------------------------------------------------------------------------------------

OUTCOME = "event_id long, ts timestamp, language string, error_code string, strategy string, passed boolean"


def outcomes(n, seed=1):
    rng, t = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(k, t + datetime.timedelta(minutes=k), rng.choice("xy"), rng.choice("ab"), rng.choice("pq"), rng.choice([True, True, True, False])) for k in range(n)]


def promoted(spark, rows):
    return sorted(map(tuple, V.promoted(spark.createDataFrame(rows, OUTCOME)).collect()))


def test_outcomes_in_any_cut_and_replayed(spark, tmp_path, monkeypatch):
    rows = outcomes(150)
    for n in (1, 3, 11):
        sink = sinks.OutcomeSink(spark, f"{tmp_path}/s{n}")
        for k, part in enumerate(cut(n)(rows)):
            made = spark.createDataFrame(part, OUTCOME)
            if n == 3:
                # the batch is killed before its version is out, and comes again; then it comes a third time
                with monkeypatch.context() as m:
                    m.setattr(Snapshots, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
                    with pytest.raises(KeyboardInterrupt):
                        sink.take(made, k)
            assert sink.take(made, k) and not sink.take(made, k)
            assert sorted(map(tuple, sink.promotions().collect())) == promoted(spark, rows[: len(rows) * (k + 1) // n]) or n == 11
        assert sorted(r.event_id for r in sink.outcomes().collect()) == list(range(150))
        assert sorted(map(tuple, sink.promotions().collect())) == promoted(spark, rows)


def test_stream_of_outcomes(streams, tmp_path):
    rows, sink = outcomes(80, 3), sinks.OutcomeSink(streams, f"{tmp_path}/sink")
    for part in cut(3)(rows):
        streams.createDataFrame(part, OUTCOME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sink.start(streams.readStream.schema(OUTCOME).parquet(f"{tmp_path}/in"), f"{tmp_path}/at").awaitTermination()
    assert sink.outcomes().count() == 80 and sorted(map(tuple, sink.promotions().collect())) == promoted(streams, rows)


@pytest.mark.parametrize("batches", [1, 5])
def test_promotion_stream_in_any_cut(streams, tmp_path, batches):
    rows = outcomes(120, 7)
    got = fed(streams, rows, OUTCOME, tmp_path, cut(batches), sessions.promotion_stream)
    last = got.groupBy("language", "error_code").agg(F.max_by("strategy", "event_id").alias("strategy"))
    assert sorted(map(tuple, last.collect())) == promoted(streams, rows)


@pytest.mark.parametrize("batches", [1, 4])
def test_extraction_queue(streams, tmp_path, batches):
    """Three failures in a row close a session; likeness is judged against what was accepted before the answer."""
    item = lambda *texts: json.dumps([{"type": "fact", "content": t} for t in texts])
    schema = "session long, pos long, response string"
    rows = [
        (1, 0, item("the build uses gradle", "the build uses gradle")), (1, 1, "```json\n" + item("the build uses gradle", "tests run in parallel mode") + "\n```"), (1, 2, None), (1, 3, "no json"), (1, 4, None), (1, 5, None), (1, 6, None), (1, 7, item("never looked at again")),
        (2, 8, item("short", "deploys happen on friday mornings", "a fourth thing is cut", "this is too many")), (2, 9, json.dumps([{"type": "odd", "content": "of another kind"}, {"type": "fact"}, {"type": "fact", "content": "kept with a scope", "scope": "user"}])),
    ]
    want = [(1, 0, 0, "the build uses gradle", "project"), (1, 0, 1, "the build uses gradle", "project"), (1, 1, 1, "tests run in parallel mode", "project"), (2, 8, 1, "deploys happen on friday mornings", "project"), (2, 8, 2, "a fourth thing is cut", "project")]
    run = lambda s: sinks.extraction_queue(s, ("fact",))
    got = fed(streams, rows, schema, tmp_path, cut(batches), run) if batches > 1 else run(streams.createDataFrame(rows, schema))
    found = sorted((r.session, r.pos, r.nth, r.content, r.scope) for r in got.collect())
    assert found[:5] == want and [x[3:] for x in found[5:]] == [("kept with a scope", "user")]


def test_registered_stream_queries(spark):
    for name in ("session_anchors", "streamed_outcomes"):
        assert registry.queries()[name](spark, SF).count() > 0
