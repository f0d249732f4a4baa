"""Structural direction classifier for edges: does an edge support or counter?

An edge must not be seen while its own features are measured: what its ends reach is counted without it.  That differs
from the plain count only where no other way leads past the edge, so the closure over all edges is made once and only
the edges without a second way, and those on circles, are walked again, all at the same time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .fixpoint import frontier_loop
from .graph import reachable

#: Below this confidence nothing is said about an edge.
CONFIDENCE = 0.75


def reach_without(edges: DataFrame, forward: DataFrame) -> DataFrame:
    """(edge, a_reach, b_reach) of edges(edge, a, b): how many nodes ``a`` and ``b`` reach over forward(src, dst) without the
    edge (a, b).  A node counts among what it reaches only if it lies on a circle."""
    fwd = materialize(forward.select("src", "dst").dropna().distinct(), "forward")
    ends = edges.select(F.col("a").alias("n")).union(edges.select("b"))
    seeds = fwd.join(ends.distinct(), F.col("src") == F.col("n"), "left_semi").select("dst").union(ends).distinct()
    closure = materialize(reachable(fwd, seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node"))), "closure")
    sizes = closure.groupBy(F.col("seed").alias("n")).agg(F.count("*").alias("size"))
    pairs = edges.select("a", "b").distinct()
    live = materialize(pairs.join(fwd, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")), "left_semi"), "live")
    back = live.join(closure.select(F.col("seed").alias("b"), F.col("node").alias("a")), ["a", "b"]).withColumn("circle", F.lit(True))
    # Another way: a first step to c, which reaches b and does not lead back to a.
    step = live.join(fwd.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").filter("c <> b AND c <> a")
    way = step.join(closure.select(F.col("seed").alias("c"), F.col("node").alias("b")), ["c", "b"]).join(closure.select(F.col("seed").alias("c"), F.col("node").alias("a")), ["c", "a"], "left_anti")
    marked = live.join(way.select("a", "b").distinct().withColumn("way", F.lit(True)), ["a", "b"], "left").join(back, ["a", "b"], "left")
    marked = materialize(marked.select("a", "b", F.coalesce("way", F.lit(False)).alias("way"), F.coalesce("circle", F.lit(False)).alias("circle")), "ways")
    again = marked.filter("NOT way OR circle").select("a", "b", F.col("a").alias("seed")).union(marked.filter("circle").select("a", "b", F.col("b").alias("seed"))).distinct()

    def onward(f: DataFrame, _: int) -> DataFrame:
        ahead = f.join(fwd, F.col("node") == F.col("src")).filter("NOT (src = a AND dst = b)")
        return ahead.select("a", "b", "seed", F.col("dst").alias("node")).distinct()

    first = onward(again.withColumn("node", F.col("seed")), 0)
    walked = frontier_loop(first, onward, ["a", "b", "seed", "node"], label="without").groupBy("a", "b", "seed").agg(F.count("*").alias("n"))
    walked = again.join(walked, ["a", "b", "seed"], "left").select("a", "b", "seed", F.coalesce("n", F.lit(0)).alias("n"))

    def of(end: str) -> DataFrame:
        found = walked.filter(F.col("seed") == F.col(end)).select("a", "b", F.col("n").alias("without"))
        plain = pairs.join(sizes.select(F.col("n").alias(end), "size"), end, "left")
        return plain.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("without", "size", F.lit(0)).alias(f"{end}_reach"))

    return edges.select("edge", "a", "b").join(of("a"), ["a", "b"]).join(of("b"), ["a", "b"]).select("edge", "a_reach", "b_reach")


def direction_features(edges: DataFrame, nodes: DataFrame, goals: DataFrame, requirements: DataFrame, markers: Sequence[str] = (), evidence: DataFrame | None = None) -> DataFrame:
    """One row for each edge(edge, a, b, counters, forward): its label ``counters`` and the features of its ends.

    Degrees count all edges; ``nodes`` has node, layer and phrase.  Edges with an end that is no node are left out, and
    those that start at an ``evidence`` node, whose meaning is a matter of definition.  ``markers`` are parts of phrases."""
    c = F.col
    both = edges.select(c("a").alias("n")).union(edges.select("b")).groupBy("n").agg(F.count("*").alias("degree"))
    goal = goals.select(c("node").alias("b")).distinct().withColumn("b_goal", F.lit(1))
    need = requirements.select(c("node").alias("b")).distinct().withColumn("b_required", F.lit(1))
    kept = edges if evidence is None else edges.join(evidence.select(c("node").alias("a")).distinct(), "a", "left_anti")
    named = nodes.groupBy("node").agg(F.max(F.when(c("layer") == "concept", 1).otherwise(0)).alias("concept"), F.concat_ws(" ", F.array_sort(F.collect_set("phrase"))).alias("phrase"))
    rows = kept.select("edge", "a", "b", "counters")
    for end in ("a", "b"):
        rows = rows.join(named.select(c("node").alias(end), c("concept").alias(f"{end}_concept"), c("phrase").alias(f"{end}_phrase")), end)
        rows = rows.join(both.select(c("n").alias(end), c("degree").alias(f"{end}_degree")), end)
    rows = rows.join(goal, "b", "left").join(need, "b", "left").join(reach_without(kept.select("edge", "a", "b"), edges.filter("forward").select(c("a").alias("src"), c("b").alias("dst"))), "edge")
    said = [F.contains(f"{end}_phrase", F.lit(m)).cast("int").alias(f"{end}_says_{k}") for end in ("a", "b") for k, m in enumerate(markers)]
    zero = F.lit(0)
    return rows.select("edge", "a", "b", "counters", "a_degree", "b_degree", F.coalesce("b_goal", zero).alias("b_goal"), F.coalesce("b_required", zero).alias("b_required"), "a_concept", "b_concept", "a_reach", "b_reach", *said)


def direction_classifier(rows: DataFrame, confidence: float = CONFIDENCE, least: int = 20):
    """A model that scores rows of ``direction_features``, fitted on those with a label; none if they are fewer than
    ``least`` or all alike.  Call ``suggest`` with it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    labelled = rows.filter("counters IS NOT NULL").withColumn("label", F.col("counters").cast("double"))
    seen = labelled.agg(F.count("*").alias("n"), F.count_distinct("label").alias("kinds")).first()
    if seen.n < least or seen.kinds < 2:
        return None
    inputs = [c for c in rows.columns if c not in ("edge", "a", "b", "counters")]
    steps = [VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=0.05, maxIter=100)]
    return Pipeline(stages=steps).fit(labelled)


def suggest(model, rows: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(edge, p, relation): the probability that an edge counters; ``counters`` or ``supports`` where it is sure enough."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    relation = F.when(p >= confidence, "counters").when(p <= 1 - confidence, "supports").otherwise("abstain")
    return model.transform(rows).select("edge", p.alias("p"), relation.alias("relation"))
