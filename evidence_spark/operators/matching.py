"""Maximum bipartite matching of evidence to requirements, many graphs at once.

Graphs of a bounded number of edges are solved inside tasks, one after another as their sorted edges come in.  Larger
graphs are solved in frames: layers from the free evidence, then a maximal set of disjoint shortest augmenting paths at
once, so that the number of phases grows with the square root of the requirements and not with their number.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A graph of at most so many edges is solved inside one task.
SMALL_GRAPH = 100_000


def match_graph(edges: list[tuple]) -> dict:
    """{right: left} of one graph's (left, right) edges: layers by breadth, then disjoint shortest paths by depth."""
    near: dict = {}
    for left, right in edges:
        near.setdefault(left, []).append(right)
    taken, mate = {}, {}  # right -> left, left -> right
    while True:
        layer, depth, deepest = [x for x in near if x not in mate], {}, None
        for x in layer:
            depth[x] = 0
        while layer and deepest is None:
            ahead = []
            for x in layer:
                for y in near[x]:
                    other = taken.get(y)
                    if other is None:
                        deepest = depth[x]
                    elif other not in depth:
                        depth[other] = depth[x] + 1
                        ahead.append(other)
            layer = ahead
        if deepest is None:
            return taken
        rest = {x: iter(near[x]) for x in depth if depth[x] <= deepest}
        for start in [x for x in depth if depth[x] == 0]:
            path, via = [start], []
            while path:
                x = path[-1]
                for y in rest[x]:
                    other = taken.get(y)
                    if other is None:
                        for a, b in zip(path, [*via, y], strict=True):
                            taken[b], mate[a] = a, b
                        path = []
                    elif depth.get(other) == depth[x] + 1 and other in rest:
                        via.append(y)
                        path.append(other)
                    else:
                        continue
                    break
                else:
                    path.pop()
                    if via:
                        via.pop()


def _in_tasks(edges: DataFrame) -> DataFrame:
    """(graph_id, req, ev) of graphs whose edges fit in a task."""
    kinds = dict(edges.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, types = None, [], None

        def out() -> pa.RecordBatch:
            found = match_graph(rows)
            return pa.RecordBatch.from_arrays([pa.array([group] * len(found), types[0]), pa.array(found.keys(), types[2]), pa.array(found.values(), types[1])], names=["graph_id", "req", "ev"])

        for batch in batches:
            types = [c.type for c in batch.columns]
            for graph, ev, req in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if graph != group and rows:
                    yield out()
                    rows = []
                group = graph
                rows.append((ev, req))
        if rows:
            yield out()

    dealt = edges.select("graph_id", "ev", "req").repartition(width(edges.sparkSession), "graph_id").sortWithinPartitions("graph_id", "ev", "req")
    return dealt.mapInArrow(run, f"graph_id {kinds['graph_id']}, req {kinds['req']}, ev {kinds['ev']}")


def _layers(e: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(links, ends): links(graph_id, ev, req, depth) of the layered graph, where ``ev`` lies at ``depth`` and ``req`` is first
    reached from there, and the free requirements of each graph's last layer; none if no graph has an augmenting path."""
    frontier = e.select("graph_id", "ev").distinct().join(m, ["graph_id", "ev"], "left_anti")
    depth, seen, links, ends = 0, None, [], None
    while True:
        hop = e.join(frontier, ["graph_id", "ev"])
        if seen is not None:
            hop = hop.join(seen, ["graph_id", "req"], "left_anti")
        hop = materialize(hop.select("graph_id", "ev", "req", F.lit(depth).alias("depth")), "match-hop")
        if hop.isEmpty():
            break
        links.append(hop)
        new = hop.select("graph_id", "req").distinct()
        seen = new if seen is None else seen.unionByName(new)
        free = new.join(m, ["graph_id", "req"], "left_anti").withColumn("depth", F.lit(depth))
        taken = new.join(m, ["graph_id", "req"]).select("graph_id", "ev")
        free = materialize(free, "match-free")
        if not free.isEmpty():
            ends = free if ends is None else ends.unionByName(free)
            taken = taken.join(free.select("graph_id").distinct(), "graph_id", "left_anti")
        frontier = taken
        depth += 1
    if ends is None:
        return None
    layered = links[0]
    for part in links[1:]:
        layered = layered.unionByName(part)
    return layered, ends


def _disjoint_paths(links: DataFrame, ends: DataFrame, m: DataFrame) -> DataFrame:
    """(graph_id, req, ev) pairs of disjoint shortest augmenting paths, none of which can be added to.

    Every free end walks back layer by layer.  Where several want one evidence, that of least priority takes it; each
    round drops the vertices of the finished paths and of the walks that found nothing left, until no walk goes through."""
    flips, open_links, walks, turn = None, links, ends, 0
    while True:
        order = F.xxhash64("graph_id", "req", F.lit(turn))
        at = walks.select("graph_id", "req", "depth", F.struct(order.alias("o"), F.col("req").alias("end")).alias("walk"))
        steps, lost = None, None
        while True:
            wish = at.join(open_links, ["graph_id", "req", "depth"])
            # Each evidence takes the walk of least priority, then each walk one evidence that took it.
            held = wish.groupBy("graph_id", "ev").agg(F.min(F.struct("walk", "req", "depth")).alias("w"))
            step = held.groupBy("graph_id", "w.walk").agg(F.min(F.struct(F.col("ev"), F.col("w.req").alias("req"), F.col("w.depth").alias("depth"))).alias("s"))
            step = materialize(step.select("graph_id", "walk", "s.ev", "s.req", "s.depth"), "match-step")
            dead = at.join(wish.select("graph_id", "walk").distinct(), ["graph_id", "walk"], "left_anti").select("graph_id", "req")
            lost = materialize(dead if lost is None else lost.unionByName(dead), "match-lost")
            if step.isEmpty():
                break
            steps = step if steps is None else steps.unionByName(step)
            owned = m.select("graph_id", "ev", F.col("req").alias("next"))
            at = step.filter("depth > 0").join(owned, ["graph_id", "ev"]).select("graph_id", F.col("next").alias("req"), (F.col("depth") - 1).alias("depth"), "walk")
        if steps is None:
            break
        done = steps.filter("depth = 0").select("graph_id", "walk")
        made = materialize(steps.join(done, ["graph_id", "walk"]).select("graph_id", "req", "ev"), "match-paths")
        if made.isEmpty() and lost.isEmpty():
            break
        flips = made if flips is None else flips.unionByName(made)
        gone = made.select("graph_id", "req").unionByName(lost)
        open_links = materialize(open_links.join(made.select("graph_id", "ev"), ["graph_id", "ev"], "left_anti").join(gone, ["graph_id", "req"], "left_anti"), "match-open")
        walks = materialize(walks.join(gone, ["graph_id", "req"], "left_anti"), "match-walks")
        turn += 1
        if walks.isEmpty():
            break
    return flips


def _in_frames(e: DataFrame, phases: list[int] | None = None) -> DataFrame:
    """(graph_id, req, ev) of graphs of any size; ``phases`` collects how many paths each phase has found."""
    by_req = e.groupBy("graph_id", "req").agg(F.min("ev").alias("ev"))
    m = materialize(by_req.groupBy("graph_id", "ev").agg(F.min("req").alias("req")).select("graph_id", "req", "ev"), "match")
    while True:
        found = _layers(e, m)
        if found is None:
            return m
        flips = materialize(_disjoint_paths(*found, m), "match-flips")
        kept = m.join(flips.select("graph_id", "ev"), ["graph_id", "ev"], "left_anti").join(flips.select("graph_id", "req"), ["graph_id", "req"], "left_anti")
        if phases is not None:
            phases.append(flips.count())
        m = materialize(kept.unionByName(flips), "match")


def assign_evidence(pairs: DataFrame, reqs: DataFrame, axioms: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(graph_id, req, ev): as many requirements filled as can be, one evidence for each.

    pairs(graph_id, ev, req), reqs(graph_id, req), axioms(graph_id, req).  An axiom asks for no evidence and stands for
    itself.  Which of several largest assignments comes out is not defined.  Null ids match nothing."""
    own = axioms.join(reqs, ["graph_id", "req"], "left_semi").select("graph_id", "req").distinct()
    e = pairs.join(reqs, ["graph_id", "req"], "left_semi").join(own, ["graph_id", "req"], "left_anti")
    e = materialize(e.select("graph_id", "ev", "req").dropna().distinct(), "match-edges")
    large = materialize(e.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("graph_id"), "match-large")
    m = _in_tasks(e.join(large, "graph_id", "left_anti"))
    if not large.isEmpty():
        m = m.unionByName(_in_frames(materialize(e.join(large, "graph_id", "left_semi"), "match-edges")))
    ev = dict(pairs.dtypes)["ev"]
    return m.unionByName(own.select("graph_id", "req", F.col("req").cast(ev).alias("ev")))
