"""Graphs of files: neighbours, closure, components, ranks, upkeep under change, and the resolution of imports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, stored

#: Endings that an import may leave out, in the order in which they are tried.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]


def last_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, symbols, pos); of repeated ones the last holds."""
    return edges.groupBy("src", "dst").agg(F.max_by("symbols", "pos").alias("symbols"))


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, reach): everything that can be reached along (src, dst), a node itself only through a cycle.

    Paths double in length each round; each round's new pairs alone are joined on, and are written to the shared folder.
    """
    known = stored(edges.where("src is not null and dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("reach")).distinct(), "closure")
    new = known
    for _ in range(most_rounds):
        step = new.alias("a").join(known.alias("b"), F.col("a.reach") == F.col("b.node")).select("a.node", "b.reach")
        step = step.union(known.alias("a").join(new.alias("b"), F.col("a.reach") == F.col("b.node")).select("a.node", "b.reach"))
        new = stored(step.distinct().join(known, ["node", "reach"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        known = stored(known.union(new), "closure")
    raise RuntimeError("closure did not end")


def dependents(edges: DataFrame) -> DataFrame:
    """(file, dependent): everything that needs a file, directly or not."""
    return closure(edges).select(F.col("reach").alias("file"), F.col("node").alias("dependent"))


#: Steps of a search along edges that are one job.
HOPS = 3
#: Steps for which colours are waited for at first.
STEPS_FIRST = 36
#: One in so many nodes, at least, gives its colour at first.
SEEDS = 500
#: Rounds of trimming that are one job.
TRIMS = 3
#: Share of the edges that, left by a job of trimming, ends it.
TRIMMED = 0.8
#: Layers of a graph of components that are one job.
LAYERS = 3
#: Steps from pair to pair that are one job.
STEPS = 3
#: Members that make a component a hub, through which reach is counted and not listed.
HUB = 100


def _spread(labels: DataFrame, edges: DataFrame, fresh: Column | None = None, most_steps: int = 30_000) -> tuple[DataFrame, bool]:
    """(node, label) after labels went along (src, dst) as far as they get smaller: each node has the least that reaches it. And whether that is so, or labels only went `most_steps` steps.

    A round is a few steps in one job. Only labels that are fresh, new in the last step, are sent on; at first those that
    the condition `fresh` names, or all. Null labels are none yet.
    """
    now = stored(labels.withColumn("fresh", F.col("label").isNotNull() if fresh is None else fresh), "labels")
    for _ in range(0, most_steps, HOPS):
        step = now
        for _ in range(HOPS):
            # what is sent is built into the hash tables: edges and labels are streamed past it without a sort
            said = step.where("fresh").select(F.col("node").alias("src"), "label")
            sent = edges.join(said.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("got"))
            less = F.col("got").isNotNull() & (F.col("label").isNull() | (F.col("got") < F.col("label")))
            step = step.join(sent.hint("shuffle_hash"), "node", "left").select("node", F.least("label", "got").alias("label"), less.alias("fresh"))
        last, now = now, stored(step, "labels")
        drop(last)
        settled = now.where("fresh").isEmpty()
        if settled:
            break
    return now.select("node", "label"), settled


def _numbered(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, id) of the nodes that edges (src, dst) enter and leave, least those with many edges; and a bound below which lie a few of them.

    Nodes of many edges are likely members of large components. Among nodes of like degree the number is by the hash of
    the node, so that components that lie in a row have their numbers in no order.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o > 0 and i > 0")
    few = F.lit(63) - F.floor(F.log2("o") + F.log2("i"))
    ids = stored(degree.select("node", (F.shiftleft(few.cast("long"), 56) + F.monotonically_increasing_id()).alias("id")), "ids")
    classes = sorted(map(tuple, ids.groupBy(F.shiftright("id", 56).alias("few")).count().collect()))
    seen, many, bound = 0, sum(n for _, n in classes), 0
    for k, n in classes:
        seen, bound = seen + n, (k + 1) << 56
        if seen * SEEDS >= many:
            break
    return ids, bound


def strong_components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, component) of all nodes on a cycle of two or more; the component is named by its least member.

    Every node takes the least node that reaches it as its colour, at first of a few that have many edges, then of all.
    The nodes of a colour that reach the node it is named by are a component. Edges between colours, and those of
    components found, go; what is left is trimmed of edges that start or end where none ends or starts, and is done again.
    Colours that have a long way are not waited for: what is found on cycles by then becomes one node, which shortens
    the way. A round costs what the edges left cost, and no pair of nodes is ever held that no edge joins.
    """
    own = stored(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst"), "edges")
    ids, bound = _numbered(own)
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("a")), ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    left = stored(own.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges")
    many, most_steps, merged = left.count(), STEPS_FIRST, []
    for _ in range(most_rounds):
        if not many:
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        seeds = F.col("node") if bound is None else F.when(F.col("node") < bound, F.col("node"))
        colour, settled = _spread(nodes.withColumn("label", seeds), left, most_steps=most_steps)
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
        same = stored(left.join(a, "src").join(b, "dst").where("ca <=> cb").select("src", "dst", "ca"), "edges")
        # backwards from the named node, within its colour: what it reaches this way is labelled by it, all else by itself
        back = same.where("ca is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = colour.where("label is not null").select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(1).alias("label"))
        reached, whole = _spread(start, back, F.col("label") == 0, most_steps)
        done = stored(reached.where("label = 0").select("node").join(colour, "node").select(F.col("node").alias("id"), F.col("label").alias("to")), "components")
        merged.append(done.where("id <> to"))
        if settled and whole:
            gone = done.select(F.col("id").alias("src"))
            rest = same.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        else:
            a, b = done.select(F.col("id").alias("src"), F.col("to").alias("a")), done.select(F.col("id").alias("dst"), F.col("to").alias("b"))
            rest = (same if settled else left).join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()
            most_steps *= 2
        last, left, bound = left, stored(rest, "edges"), None
        drop(last, same)
        # trimming costs less than colours as long as it takes much away; long tails that are left take a colour of their own
        many = left.count()
        while many:
            trimmed = left
            for _ in range(TRIMS):
                starts, ends = trimmed.select(F.col("src").alias("dst")).distinct(), trimmed.select(F.col("dst").alias("src")).distinct()
                trimmed = trimmed.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")
            last, left = left, stored(trimmed, "edges")
            drop(last)
            before, many = many, left.count()
            if many > TRIMMED * before:
                break
    else:
        raise RuntimeError("components did not settle")
    if not merged:
        return own.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    # what a node became one with may itself have become one with another later
    found = merged.pop()
    for early in reversed(merged):
        later = found.select(F.col("id").alias("to"), F.col("to").alias("last"))
        found = stored(found.union(early.join(later, "to", "left").select("id", F.coalesce("last", "to"))), "components")
    found = found.union(found.select("to", "to").distinct()).join(ids, "id").select("node", "to")
    return found.join(found.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): members of cycles, also of those of one node; the component is named by its least member."""
    many = stored(strong_components(edges), "components")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(many, "node", "left_anti")
    return many.unionByName(loops.withColumn("component", F.col("node")))


def condensed(nodes: DataFrame, edges: DataFrame, ring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component, cyclic) of all nodes, and the edges (ca, cb) between components: a graph without cycles."""
    named = nodes.select("node").distinct().join(ring, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("cyclic"))
    named = stored(named, "named")
    a = named.select(F.col("node").alias("src"), F.col("component").alias("ca"))
    b = named.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    return named, stored(edges.select("src", "dst").join(a, "src").join(b, "dst").where("ca <> cb").select("ca", "cb").distinct(), "dag")


def depths(nodes: DataFrame, edges: DataFrame, most_rounds: int = 10_000, ring: DataFrame | None = None, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(node, depth): the longest path from a root, cycles counting as one node; nodes in no path from a root have 0.

    Components are taken away from the roots on, layer by layer, a few in one job: a node's depth is the layer in which
    its last edge went. Each edge is joined once, in the layer of its start.
    """
    named, dag = parts or condensed(nodes, edges, cycles(edges) if ring is None else ring)
    degree = dag.groupBy(F.col("cb").alias("component")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("int")
    now = stored(named.select("component").distinct().join(degree, "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("n"), none.alias("depth")), "wait")
    for first in range(0, most_rounds, LAYERS):
        if now.where("depth is null").isEmpty():
            return named.join(now.select("component", "depth"), "component").select("node", "depth")
        step = now
        for depth in range(first, first + LAYERS):
            ready = F.col("depth").isNull() & (F.col("n") == 0)
            cut = dag.join(step.where(ready).select(F.col("component").alias("ca")).hint("shuffle_hash"), "ca").groupBy(F.col("cb").alias("component")).agg(F.count("*").alias("cut"))
            step = step.join(cut.hint("shuffle_hash"), "component", "left").select("component", (F.col("n") - F.coalesce("cut", F.lit(0))).alias("n"), F.when(ready, depth).otherwise(F.col("depth")).alias("depth"))
        last, now = now, stored(step, "wait")
        drop(last)
    raise RuntimeError("depths did not settle")


def _grown(start: DataFrame, edges: DataFrame, barred: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """Pairs (node, reach, others) and what comes of them as their nodes go back along (src, dst); those that match `barred` are left out with all that come of them."""
    keys = [c for c in start.columns if c != "node"]
    free = (lambda d: d) if barred is None else (lambda d: d.join(barred, barred.columns, "left_anti"))
    new = stored(free(start.distinct()).withColumn("k", F.lit(STEPS)), "pairs")
    parts = [new]
    for _ in range(most_rounds):
        known = reduce(DataFrame.unionByName, parts).select("node", *keys)
        step, steps = new.where(F.col("k") == STEPS).select("node", *keys), []
        for k in range(1, STEPS + 1):
            step = free(edges.select("src", F.col("dst").alias("node")).join(step, "node").select(F.col("src").alias("node"), *keys).distinct())
            steps.append(step.withColumn("k", F.lit(k)))
        found = reduce(DataFrame.unionByName, steps).groupBy("node", *keys).agg(F.min("k").alias("k"))
        # null keys are values like others here
        same = reduce(lambda a, b: a & b, [found[c].eqNullSafe(known[c]) for c in ("node", *keys)])
        new = stored(found.join(known, same, "left_anti"), "pairs")
        if new.isEmpty():
            return known
        parts.append(new)
    raise RuntimeError("pairs did not end")


def listed_pairs(size: DataFrame, dag: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What reach along (src, dst) is without all its pairs: (node, hub) to each hub, (node, hub) from one hub, and the pairs (node, reach) left.

    A component of `hub` members or more (node, size) is a hub. What reaches a hub reaches all that the hub reaches:
    those pairs are not listed. A pair that is left has only pairs that are left on its paths, so these are found edge by
    edge. One hub counts for each component: its own, or the least that reaches it.
    """
    hubs = stored(size.where(F.col("size") >= hub).select("node"), "hubs")
    to = _grown(hubs.select("node", F.col("node").alias("hub")), dag)
    marked = size.select("node").join(hubs.select("node", F.col("node").alias("label")), "node", "left")
    spread, settled = _spread(marked, dag)
    if not settled:
        raise RuntimeError("labels did not settle")
    through = spread.withColumnRenamed("label", "hub").where("hub is not null")
    own = hubs.select("node", F.col("node").alias("own"))
    through = stored(through.join(own, "node", "left").select("node", F.coalesce("own", "hub").alias("hub")), "through")
    start = dag.join(through.withColumnRenamed("node", "dst"), "dst", "left").select(F.col("src").alias("node"), F.col("dst").alias("reach"), "hub")
    return to, through, _grown(start, dag, to).select("node", "reach")


def reach_counts(parts: tuple[DataFrame, DataFrame], hub: int = HUB) -> DataFrame:
    """(node, n): how many nodes reach a node; itself only through a cycle. Pairs are of components, and none goes through a hub."""
    named, dag = parts
    size = stored(named.groupBy("component").agg(F.count("*").alias("size"), F.max("cyclic").alias("cyclic")).withColumnRenamed("component", "node"), "sizes")
    edges = dag.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
    if size.where(F.col("size") >= hub).isEmpty():
        pairs, more = closure(edges), None
    else:
        to, through, pairs = listed_pairs(size, edges, hub)
        weight = to.join(size.select("node", "size"), "node").groupBy("hub").agg(F.sum("size").alias("weight"))
        more = through.join(weight, "hub").select("node", "hub", "weight")
    above = pairs.join(size.select("node", "size"), "node").groupBy(F.col("reach").alias("node")).agg(F.sum("size").alias("above"))
    own = size.join(above, "node", "left")
    # a hub is among what reaches it, and counts there by its cycle
    n = F.coalesce("above", F.lit(0)) + F.when(F.col("cyclic"), F.col("size")).otherwise(0)
    if more is not None:
        own = own.join(more, "node", "left")
        n = n + F.coalesce("weight", F.lit(0)) - F.when(F.col("hub") == F.col("node"), F.col("size")).otherwise(0)
    return named.join(own.select(F.col("node").alias("component"), n.alias("n")), "component").select("node", "n")


def ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: depth, dependents (direct, transitive), dependencies, root, leaf, hub (three or more), in a cycle."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    out_degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_dependencies"))
    in_degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_dependents"))
    # components are worked out once, for dependents, cycles and depths
    parts = condensed(nodes, edges, cycles(edges))
    rows = depths(nodes, edges, parts=parts)
    for part in (out_degree, in_degree, reach_counts(parts).withColumnRenamed("n", "n_transitive"), parts[0].select("node", F.col("cyclic").alias("in_cycle"))):
        rows = rows.join(part, "node", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "node", F.col("depth").cast("long").alias("depth"), n("n_dependencies").alias("n_dependencies"), n("n_dependents").alias("n_dependents"), n("n_transitive").alias("n_transitive"),
        (n("n_dependents") == 0).alias("is_root"), (n("n_dependencies") == 0).alias("is_leaf"), (n("n_dependents") >= 3).alias("is_hub"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
    )


# -- graphs that change ----------------------------------------------------------------------------------------------


@dataclass
class ReachGraph:
    """Edges (src, dst) and all pairs (node, reach) along them, kept up as edges come and go; `touched` is the number of pairs looked at by the last change."""

    edges: DataFrame
    reach: DataFrame
    touched: int = 0

    @staticmethod
    def of(edges: DataFrame) -> ReachGraph:
        own = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
        return ReachGraph(own, closure(own))

    def _around(self, edges: DataFrame) -> DataFrame:
        """(node, reach) of all that may go along one of some edges: what reaches its start, with what its end reaches."""
        before = self.reach.select(F.col("reach").alias("src"), "node").unionByName(edges.select("src", F.col("src").alias("node")))
        after = self.reach.select(F.col("node").alias("dst"), "reach").unionByName(edges.select("dst", F.col("dst").alias("reach")))
        return edges.join(before.distinct(), "src").join(after.distinct(), "dst").select("node", "reach").distinct()

    def add(self, edges: DataFrame) -> ReachGraph:
        """With more edges. New pairs go along at least one of them: those are found round by round, from the pairs new in the last one."""
        new = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct().join(self.edges, ["src", "dst"], "left_anti"), "new")
        every, reach, looked = stored(self.edges.union(new), "edges"), self.reach, 0
        fresh = stored(new.select(F.col("src").alias("node"), F.col("dst").alias("reach")).join(reach, ["node", "reach"], "left_anti"), "fresh")
        while not fresh.isEmpty():
            reach = stored(reach.union(fresh), "reach")
            a, b = fresh.alias("a"), reach.alias("b")
            longer = a.join(b, F.col("a.reach") == F.col("b.node")).select("a.node", "b.reach").union(b.join(a, F.col("b.reach") == F.col("a.node")).select("b.node", "a.reach")).distinct()
            looked += fresh.count()
            fresh = stored(longer.join(reach, ["node", "reach"], "left_anti"), "fresh")
        return ReachGraph(every, reach, looked)

    def remove(self, edges: DataFrame) -> ReachGraph:
        """Without some edges. Pairs that may have gone along them are taken out; those that other edges still give come back, round by round."""
        gone = stored(edges.select("src", "dst").distinct().join(self.edges, ["src", "dst"], "left_semi"), "gone")
        left = stored(self.edges.join(gone, ["src", "dst"], "left_anti"), "edges")
        doubt = stored(self._around(gone).join(self.reach, ["node", "reach"], "left_semi"), "doubt")
        sure = stored(self.reach.join(doubt, ["node", "reach"], "left_anti"), "reach")
        looked = doubt.count()
        # one step along an edge that is left, then nothing or a pair that is sure
        step = left.select(F.col("src").alias("node"), F.col("dst").alias("over")).join(sure.select(F.col("node").alias("over"), "reach"), "over").select("node", "reach")
        back = stored(doubt.join(left.select(F.col("src").alias("node"), F.col("dst").alias("reach")).union(step), ["node", "reach"], "left_semi"), "back")
        while not back.isEmpty():
            sure, doubt = stored(sure.union(back), "reach"), stored(doubt.join(back, ["node", "reach"], "left_anti"), "doubt")
            step = left.select(F.col("src").alias("node"), F.col("dst").alias("over")).join(back.select(F.col("node").alias("over"), "reach"), "over").select("node", "reach")
            back = stored(doubt.join(step, ["node", "reach"], "left_semi"), "back")
        return ReachGraph(left, sure, looked)

    def replace_file(self, file: str, targets: list[str]) -> ReachGraph:
        """After a file's imports changed: its edges are those to the targets now."""
        spark = self.edges.sparkSession
        now = spark.createDataFrame([(file, t) for t in targets], "src string, dst string")
        old = self.edges.where(F.col("src") == file)
        done = self.remove(old.join(now, ["src", "dst"], "left_anti"))
        more = done.add(now)
        return ReachGraph(more.edges, more.reach, done.touched + more.touched)

    def remove_file(self, file: str) -> ReachGraph:
        """Without a file and all its edges."""
        return self.remove(self.edges.where((F.col("src") == file) | (F.col("dst") == file)))


def normal_path(path):
    """A path without `./` and with each `dir/..` taken away, by a fold over its parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(kept, "/")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (src, raw, pos) with the file meant: the first candidate that exists; null for packages and unknown files."""
    folder = F.regexp_extract("src", "^(.*/)?[^/]*$", 1)
    base = F.when(F.col("raw").startswith("."), normal_path(F.concat(folder, F.col("raw"))))
    wanted = imports.withColumn("base", base)
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.concat("base", F.lit(e)).alias("file")) for k, e in enumerate(ENDINGS)])
    found = wanted.where("base is not null").select("src", "raw", "pos", F.explode(every).alias("c")).join(files.select("file"), F.col("c.file") == F.col("file"))
    first = found.groupBy("src", "raw", "pos").agg(F.min_by("file", "c.k").alias("dst"))
    return wanted.drop("base").join(first, ["src", "raw", "pos"], "left")


def validated(imports: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """Each imported symbol's status: external, file_not_found, side_effect, ok or not_exported."""
    out = resolved(imports, files).withColumn("symbol", F.explode_outer("symbols"))
    out = out.withColumn("symbol", F.trim(F.substring_index("symbol", " as ", 1)))
    own = exports.select(F.col("file").alias("dst"), "symbol", F.lit(True).alias("known")).distinct()
    out = out.join(own, ["dst", "symbol"], "left")
    status = F.when(~F.col("raw").startswith("."), "external").when(F.col("dst").isNull(), "file_not_found").when(F.col("symbol").isNull(), "side_effect").when(F.col("known"), "ok").otherwise("not_exported")
    return out.select("src", "raw", "symbol", "dst", status.alias("status"))


def export_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, added, removed) of files whose exports (file, symbols) changed."""
    both = before.select("file", F.col("symbols").alias("b")).join(after.select("file", F.col("symbols").alias("a")), "file", "full")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    out = both.select("file", F.array_sort(F.array_except(a, b)).alias("added"), F.array_sort(F.array_except(b, a)).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, edges, hubs, roots, leaves, files in cycles."""
    r = ranks(nodes, edges)
    return r.agg(F.count("*").alias("files"), F.sum("n_dependencies").alias("edges"), *[F.count_if(c).alias(n) for c, n in (("is_hub", "hubs"), ("is_root", "roots"), ("is_leaf", "leaves"), ("in_cycle", "cyclic"))])


def origin_trace(errors: DataFrame, imports: DataFrame, hops: int = 5) -> DataFrame:
    """errors (id, file, symbol) with the last file of the chain of imports of the symbol, at most `hops` long.

    Each hop is one equi-join; a file met before ends the chain.
    """
    edge = imports.where("dst is not null").select(F.col("src").alias("at"), F.explode("symbols").alias("symbol"), "dst", "pos")
    edge = edge.withColumn("symbol", F.trim(F.substring_index("symbol", " as ", 1))).groupBy("at", "symbol").agg(F.min_by("dst", "pos").alias("dst"))
    now = errors.select("id", "file", "symbol", F.col("file").alias("at"), F.array("file").alias("seen"))
    for _ in range(hops):
        now = now.join(edge, ["at", "symbol"], "left")
        go = F.col("dst").isNotNull() & ~F.array_contains("seen", F.coalesce("dst", F.lit("")))
        now = now.select("id", "file", "symbol", F.when(go, F.col("dst")).otherwise(F.col("at")).alias("at"), F.when(go, F.concat("seen", F.array("dst"))).otherwise(F.col("seen")).alias("seen"))
    return now.select("id", "file", "symbol", F.when(F.col("at") != F.col("file"), F.col("at")).alias("origin"), (F.size("seen") - 1).cast("long").alias("hops"))


def exported(exports: DataFrame) -> DataFrame:
    """(file, symbols) of exports (file, pos, symbols): all symbols of a file in order, each once."""
    own = exports.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "symbols"))).alias("x"))
    return own.select("file", F.array_distinct(F.flatten(F.transform("x", lambda e: e.symbols))).alias("symbols"))


def analyser_of(path):
    """How a file is read: as a script, by its language's patterns, or not at all."""
    return F.when(path.rlike(r"\.(js|mjs|cjs|jsx|ts|tsx|mts|cts)$"), "script").when(path.rlike(r"\.(py|go|rs|java|kt|cs|php|cpp|cc|c|h|hpp)$"), "patterns")


def neighbours(edges: DataFrame, file: str) -> DataFrame:
    """(file, direction) of what a file needs and what needs it."""
    out = edges.where(F.col("src") == file).select(F.col("dst").alias("file"), F.lit("dependency").alias("direction"))
    return out.union(edges.where(F.col("dst") == file).select("src", F.lit("dependent"))).distinct()
