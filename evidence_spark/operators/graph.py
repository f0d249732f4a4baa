"""Graph operators over edge tables; every iteration is a frontier join over all graphs at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .definitions import jump_roots
from .fixpoint import frontier_loop


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, node): nodes reachable from each seed over edges(src, dst); the seed itself only if on a cycle."""
    e = edges.select("src", "dst").distinct()
    start = seeds.select("seed", "node").join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
    return frontier_loop(
        start, lambda f, _: f.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct(),
        ["seed", "node"], max_rounds, "reach")


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct rows of pairs(a, b) whose ``b`` is reached from ``a`` over edges(src, dst); a node reaches itself only on a cycle.

    A stretch without a branch (every edge the only one out of its node and the only one into the next) is one step: its
    nodes get a place by doubling, and two of them compare by place.  All other edges lead from the end of a stretch to the
    beginning of one, so only stretches are searched, and rounds grow with branchings, not with nodes.  Circles that nothing
    enters or leaves are walked edge by edge."""
    c = F.col
    e = edges.select("src", "dst").distinct()
    outs, ins = e.groupBy("src").agg(F.count("*").alias("outs")), e.groupBy("dst").agg(F.count("*").alias("ins"))
    link = (c("outs") == 1) & (c("ins") == 1) & (c("src") != c("dst"))
    e = materialize(e.join(outs, "src").join(ins, "dst").select("src", "dst", link.alias("link")), "edges")
    places = jump_roots(e.filter("link").select(c("dst").alias("node"), c("src").alias("parent")))

    def place(df: DataFrame, node: str, head: str, at: str) -> DataFrame:
        known = places.select(c("node").alias(node), c("root").alias(head), c("depth").alias(at))
        return df.join(known, node, "left").withColumn(head, F.coalesce(head, node)).withColumn(at, F.coalesce(at, F.lit(0)))

    steps = e.join(places.select(c("node").alias("dst")), "dst", "left_anti")
    steps = materialize(place(steps, "src", "head", "_at").select(c("head").alias("src"), "dst").distinct(), "stretches")
    asked = materialize(place(place(pairs.select("a", "b").distinct(), "a", "ha", "pa"), "b", "hb", "pb"), "asked")
    near = (c("ha") == c("hb")) & (c("pa") < c("pb"))
    rest = asked.filter(~near).join(steps.select(c("dst").alias("hb")).distinct(), "hb", "left_semi")
    far = reachable(steps, rest.select(c("ha").alias("seed"), c("ha").alias("node")).distinct())
    far = rest.join(far.select(c("seed").alias("ha"), c("node").alias("hb")), ["ha", "hb"], "left_semi")
    return asked.filter(near).select("a", "b").unionByName(far.select("a", "b"))


def hop_distance(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, node, hops): shortest hop counts, the seed at 0."""
    e = edges.select("src", "dst").distinct()
    return frontier_loop(
        seeds.select("seed", "node").withColumn("hops", F.lit(0)),
        lambda f, n: f.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(n)),
        ["seed", "node"], max_rounds, "hops")


def counters(forward: DataFrame, negative: DataFrame, nodes: DataFrame, goals: DataFrame) -> DataFrame:
    """(node, counter): nodes negated by a node or by anything it reaches, if they lead to a goal."""
    seeds = nodes.select(F.col("node").alias("seed"), "node")
    held = seeds.unionByName(reachable(forward, seeds))
    back = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    to_goal = reachable(back, goals.select(F.lit(1).alias("seed"), "node")).select("node").unionByName(goals.select("node")).distinct()
    hit = held.join(negative, F.col("node") == F.col("src")).select(F.col("seed").alias("node"), F.col("dst").alias("counter")).distinct()
    return hit.join(to_goal.withColumnRenamed("node", "counter"), "counter", "left_semi")


def components(pairs: DataFrame) -> DataFrame:
    """(node, comp): connected components of undirected pairs(a, b), named by their smallest node.

    Star contraction: every node points at the smallest neighbour of its current group, then pointers are followed
    (jumping), so rounds grow with the log of the diameter.  A hub's neighbours are pre-aggregated by a partial min.
    """
    edges = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "cc")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        merged = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("next"))
        # Hook: what a node learns, its old root learns too.
        roots = merged.groupBy(F.col("comp").alias("node")).agg(F.min("next").alias("root"))
        hooked = materialize(merged.join(roots, "node", "left").select("node", F.col("comp").alias("old"), F.least("next", F.coalesce("root", "next")).alias("next")), "cc")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = materialize(hooked.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("far", "next")).alias("comp")), "cc")
        if after.filter("comp <> old").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")


def requirements(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(graph_id, req): concepts with a forward edge into the graph's goal."""
    return edges.join(goals, (edges.graph_id == goals.graph_id) & (F.col("dst") == F.col("goal"))).select(
        edges.graph_id, F.col("src").alias("req")).distinct()


def diagnose(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per graph: requirements, blocked ones, orphan instances, unsupported concepts, idle axioms, missing sources.

    nodes(graph_id, node, layer, is_axiom, source); edges are forward edges; node names are unique across graphs.
    """
    reqs = requirements(edges, goals)
    starts = nodes.filter("layer = 'instance' OR is_axiom").select(F.col("node").alias("seed"), "node")
    reach = reachable(edges, starts.select(F.lit(1).alias("seed"), "node")).select("node")
    supported = reach.unionByName(nodes.filter("is_axiom").select("node")).distinct()
    blocked = reqs.join(supported.withColumnRenamed("node", "req"), "req", "left_anti").groupBy("graph_id").agg(F.count("*").alias("blocked"))
    outgoing = edges.select(F.col("src").alias("node")).distinct()
    orphan = nodes.filter("layer = 'instance'").join(outgoing, "node", "left_anti").groupBy("graph_id").agg(F.count("*").alias("orphans"))
    bare = nodes.filter("layer = 'concept'").join(supported, "node", "left_anti").groupBy("graph_id").agg(F.count("*").alias("unsupported"))
    idle = nodes.filter("is_axiom").join(outgoing, "node", "left_anti").groupBy("graph_id").agg(F.count("*").alias("idle_axioms"))
    nosrc = nodes.filter("layer = 'instance' AND source IS NULL").groupBy("graph_id").agg(F.count("*").alias("missing_sources"))
    out = graphs.select("graph_id").join(reqs.groupBy("graph_id").agg(F.count("*").alias("requirements")), "graph_id", "left")
    for part in (blocked, orphan, bare, idle, nosrc):
        out = out.join(part, "graph_id", "left")
    return out.na.fill(0)


def shortest_path(edges: DataFrame, asks: DataFrame, max_hops: int | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """(a, b, hops, path) for asks(a, b) over edges(src, rel, dst) walked both ways; path items tell node, relation
    and direction.  Among equally short paths the smallest is kept, node by node."""
    e = edges.filter(~F.col("rel").isin(list(skip))) if skip else edges
    both = e.select("src", "rel", "dst", F.lit(True).alias("fwd")).unionByName(
        e.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), F.lit(False).alias("fwd"))).distinct()
    # One frontier per distinct start, or per distinct target if they are fewer; the other ends are looked up at the end.
    # From a target a path grows at its front: of equally short ones the smallest begins with the smallest item.
    item = F.struct(F.col("dst").cast("string").alias("node"), F.col("rel").alias("rel"), F.col("fwd").alias("fwd"))
    start, end = ("b", "a") if asks.select("b").distinct().count() < asks.select("a").distinct().count() else ("a", "b")
    at, far, path = ("dst", "src", F.concat(F.array(item), "path")) if start == "b" else ("src", "dst", F.concat("path", F.array(item)))

    def step(f: DataFrame, n: int) -> DataFrame:
        grown = f.join(both, F.col("node") == F.col(at)).select(start, F.col(far).alias("node"), path.alias("path"))
        return grown.groupBy(start, "node").agg(F.min("path").alias("path")).withColumn("hops", F.lit(n))

    none = F.array().cast("array<struct<node:string,rel:string,fwd:boolean>>")
    seeds = asks.select(start).distinct().select(start, F.col(start).alias("node"), none.alias("path"), F.lit(0).alias("hops"))
    found = frontier_loop(seeds, step, [start, "node"], label="path", limit=max_hops)
    return asks.join(found.withColumnRenamed("node", end), ["a", "b"]).select("a", "b", "hops", "path")


def chain_root(parents: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, root, depth) following parents(node, parent) until no parent or a stop word; of several parents the
    smallest counts; a node that runs into a cycle has no root.  All chains are walked at once: as every node of a chain
    is walked too, a round in which no walk ends leaves only cycles."""
    p = parents.select("node", "parent")
    if stop is not None:
        p = p.join(stop.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", "parent")
    p = materialize(p.groupBy("node").agg(F.min("parent").alias("parent")), "chain-parents")
    at = materialize(p.select("node", F.col("parent").alias("cur"), F.lit(1).alias("depth")), "chain")
    done = []
    for depth in count(2):
        ahead = p.select(F.col("node").alias("cur"), F.col("parent").alias("up"))
        moved = materialize(at.join(ahead, "cur", "left"), "chain")
        ended = moved.filter("up IS NULL")
        done.append(ended.select("node", F.col("cur").alias("root"), "depth"))
        if ended.isEmpty():
            break
        at = moved.filter("up IS NOT NULL").select("node", F.col("up").alias("cur"), F.lit(depth).alias("depth"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def neighbor_boost(scores: DataFrame, edges: DataFrame, weight: float, width: int | None = None, top: int = 3) -> DataFrame:
    """(node, boosted): score plus ``weight`` times the sum of the best ``top`` neighbour scores over ``top``; with ``width``
    only among so many neighbours of lowest degree."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("nb")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct()
    kept = both
    if width is not None:
        degree = both.groupBy(F.col("node").alias("nb")).agg(F.count("*").alias("deg"))
        low = Window.partitionBy("node").orderBy("deg", "nb")
        kept = both.join(degree, "nb").withColumn("rn", F.row_number().over(low)).filter(F.col("rn") <= width)
    nb = kept.join(scores.select(F.col("node").alias("nb"), F.col("score").alias("nb_score")), "nb")
    best = Window.partitionBy("node").orderBy(F.desc("nb_score"), "nb")
    sums = nb.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= top).groupBy("node").agg(F.sum("nb_score").alias("s"))
    return scores.join(sums, "node", "left").select("node", (F.col("score") + F.lit(weight) * (F.coalesce("s", F.lit(0.0)) / top)).alias("boosted"))


def causal_chain(depends: DataFrame, effects: DataFrame, causes: DataFrame) -> DataFrame:
    """(seed, node, hops): the nearest cause(s) found by walking depends(src, dst) from each effect."""
    hops = hop_distance(depends, effects.select(F.col("node").alias("seed"), "node")).filter("hops > 0")
    hit = hops.join(causes.select("node"), "node", "left_semi")
    near = hit.groupBy("seed").agg(F.min("hops").alias("hops"))
    return hit.join(near, ["seed", "hops"]).select("seed", "node", "hops")


def topological_levels(steps: DataFrame, depends: DataFrame) -> DataFrame:
    """(plan, step, level): steps whose dependencies are all placed form the next level.  A plan with a cycle or a
    dependency that does not exist yields no row."""
    own = materialize(steps.select("plan", "step").distinct(), "topo")
    every = materialize(depends.select("plan", "step", "needs").distinct(), "topo")
    missing = materialize(every.join(own.select("plan", F.col("step").alias("needs")), ["plan", "needs"], "left_anti").select("plan").distinct(), "topo")
    left, d = own.join(missing, "plan", "left_anti"), every.join(missing, "plan", "left_anti")
    placed = []
    for level in count():
        # Only what still waits for a step that is not placed is read and written again, so a round costs what is left.
        waits = d.select("plan", "step", F.lit(True).alias("waits")).distinct()
        both = materialize(left.join(waits, ["plan", "step"], "left").withColumn("level", F.lit(level)), "topo")
        ready, left = both.filter("waits IS NULL").drop("waits"), both.filter("waits").select("plan", "step")
        if ready.isEmpty():
            break
        placed.append(ready)
        if left.isEmpty():
            break
        # A plan of which nothing is ready has a cycle; its edges stay as they are.
        d = materialize(d.join(ready.select("plan", F.col("step").alias("needs")), ["plan", "needs"], "left_anti"), "topo")
    cyclic = left.select("plan").distinct()
    out = placed[0] if placed else left.withColumn("level", F.lit(0)).limit(0)
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.join(cyclic, "plan", "left_anti")
