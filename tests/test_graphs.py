"""Components, depths and reach of random graphs, made at once and kept up under change, against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from sagebrush.operators import graph as G


def reach_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    every = set()
    for start in out:
        seen, stack = set(), [start]
        while stack:
            for x in out.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        every |= {(start, x) for x in seen}
    return every


def plain_ranks(nodes, edges):
    pairs = reach_of(edges)
    ring = {a: min(b for x, b in pairs if x == a and (b, a) in pairs) for a in nodes if (a, a) in pairs}
    name = lambda x: ring.get(x, x)
    dag = {(name(a), name(b)) for a, b in edges if name(a) != name(b)}
    depth, turn = {name(x): 0 for x in nodes}, True
    while turn:
        turn = False
        for a, b in dag:
            if depth[b] < depth[a] + 1:
                depth[b], turn = depth[a] + 1, True
    return {x: (depth[name(x)], len({a for a, b in edges if b == x}), len({b for a, b in edges if a == x}), sum(b == x for _, b in pairs), x in ring) for x in nodes}, ring


def made(spark, edges, kind="string"):
    return spark.createDataFrame([(a, b) for a, b in edges], f"src {kind}, dst {kind}")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_ranks(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(40)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range((35, 55, 90)[seed])} | {("n00", "n00")}
    # a long tail into a cycle, and a cycle in a row
    edges |= {(f"t{k}", f"t{k + 1}") for k in range(9)} | {("t9", "n01"), ("n01", "c0"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0")}
    nodes += [f"t{k}" for k in range(10)] + ["c0", "c1", "c2", "alone"]
    want, ring = plain_ranks(nodes, edges)
    graph = made(spark, [*edges, *list(edges)[:5], (None, "n01"), ("n01", None)])
    assert dict(map(tuple, G.cycles(graph).collect())) == ring
    got = {r.node: (r.depth, r.n_dependents, r.n_dependencies, r.n_transitive, r.in_cycle) for r in G.ranks(spark.createDataFrame([(x,) for x in nodes], "node string"), made(spark, edges)).collect()}
    assert got == want


def test_graphs_without_edges(spark):
    none = made(spark, [])
    assert G.cycles(none).collect() == [] and G.strong_components(made(spark, [("a", "a")])).collect() == []
    assert {r.node: (r.depth, r.n_transitive, r.is_root) for r in G.ranks(spark.createDataFrame([("a",), ("b",)], "node string"), none).collect()} == {"a": (0, 0, True), "b": (0, 0, True)}


def test_reach_under_change(spark):
    rng = random.Random(9)
    nodes = [f"f{k:02}" for k in range(16)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    graph = G.ReachGraph.of(made(spark, edges))
    for step in range(5):
        if step == 3:
            file, targets = "f03", ["f05", "f11"]
            graph, edges = graph.replace_file(file, targets), {e for e in edges if e[0] != file} | {(file, t) for t in targets}
        elif step == 4:
            graph, edges = graph.remove_file("f05"), {e for e in edges if "f05" not in e}
        elif step % 2:
            gone = rng.sample(sorted(edges), 5)
            graph, edges = graph.remove(made(spark, [*gone, ("no", "edge")])), edges - set(gone)
        else:
            new = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(4)}
            graph, edges = graph.add(made(spark, new)), edges | new
        want = reach_of(edges)
        assert {tuple(r) for r in graph.reach.collect()} == want and graph.reach.count() == len(want)
        assert {tuple(r) for r in graph.edges.collect()} == edges
    # a change at the rim looks at few pairs
    rim = graph.add(made(spark, [("new", "f01")]))
    assert rim.touched <= len(nodes) + 1 and rim.reach.where(F.col("node") == "new").count() >= 1


def test_reach_through_a_hub_is_counted_without_its_pairs(spark):
    # 12 nodes lead into a ring of 4, which leads to 12 more; a path goes around it, another ring has a tail of its own
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r0"), ("s0", "s1"), ("s1", "s2"), ("s2", "s0"), ("s1", "out3"), ("in5", "s1")]
    edges = {*ring, *((f"in{k}", "r1") for k in range(12)), *(("r2", f"out{k}") for k in range(12)), ("in0", "x"), ("x", "out0"), ("y", "x"), ("out1", "z"), ("in2", "in3")}
    nodes = sorted({x for e in edges for x in e})
    want, _ = plain_ranks(nodes, edges)
    graph = made(spark, edges)
    parts = G.condensed(spark.createDataFrame([(x,) for x in nodes], "node string"), graph, G.cycles(graph))
    assert dict(map(tuple, G.reach_counts(parts, 3).collect())) == {x: r[3] for x, r in want.items()}
    size = parts[0].groupBy(F.col("component").alias("node")).agg(F.count("*").alias("size"))
    _, _, pairs = G.listed_pairs(size, parts[1].select(F.col("ca").alias("src"), F.col("cb").alias("dst")), 3)
    # of the 200 pairs or so only those that go through no hub are listed
    assert {tuple(r) for r in pairs.collect()} >= {("y", "x"), ("y", "out0")} and pairs.count() < 20


def test_components_in_a_row_are_not_found_one_a_round(spark, monkeypatch):
    # rings of two, each leading to the next, in the order of their names
    edges = [e for k in range(6) for e in ((f"a{k}", f"b{k}"), (f"b{k}", f"a{k}"))] + [(f"b{k}", f"a{k + 1}") for k in range(5)]
    rounds, spread = [], G._spread
    monkeypatch.setattr(G, "_spread", lambda *a, **b: rounds.append(1) or spread(*a, **b))
    assert dict(map(tuple, G.strong_components(made(spark, edges)).collect())) == {f"{c}{k}": f"a{k}" for c in "ab" for k in range(6)}
    # two searches a round; one component a round takes 12
    assert len(rounds) <= 10


def test_components_are_right_when_colours_are_not_waited_for(spark, monkeypatch):
    monkeypatch.setattr(G, "STEPS_FIRST", 3)
    rng = random.Random(2)
    nodes = [f"n{k:02}" for k in range(40)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)} | {("n01", "c0"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0")}
    _, ring = plain_ranks(sorted({x for e in edges for x in e}), edges)
    assert dict(map(tuple, G.cycles(made(spark, edges)).collect())) == ring
