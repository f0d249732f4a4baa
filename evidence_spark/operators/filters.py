"""Predicates and validators that yield rows with a reason instead of raising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def numeric_condition(claims: DataFrame, conds: DataFrame) -> DataFrame:
    """Adds ``verdict``: met / below / ambiguous / none / no_condition, decided by the first usable number.

    An uncertain number before any usable one makes the claim ambiguous; no usable number is "none", never a pass.
    """
    joined = claims.join(conds, "node", "left").withColumn("numbers", T.extract_numbers(F.col("text")))
    usable = F.filter("numbers", lambda x: ~x["certain"] | (F.col("unit") == "") | x["unit"].startswith(F.col("unit")))
    first = F.get(usable, F.lit(0))
    fails = (first["value"] < F.col("min")) | (first["value"] > F.col("max"))
    verdict = (
        F.when(first.isNotNull() & ~first["certain"], "ambiguous")
        .when(F.size("numbers") == 0, "none")
        .when(F.col("unit").isNull(), "no_condition")
        .when(first.isNull(), "none")
        .when(F.coalesce(fails, F.lit(False)), "below")
        .otherwise("met")
    )
    return joined.withColumn("verdict", verdict)


def topic_related(topics: DataFrame, docs: DataFrame, topic_key: str, doc_key: str) -> DataFrame:
    """Documents that name at least half of a topic's distinct words."""
    need = topics.groupBy(topic_key).agg(F.count("*").alias("n"))
    hits = topics.join(docs, "word").groupBy(topic_key, doc_key).agg(F.count("*").alias("hits"))
    return hits.join(need, topic_key).filter(F.col("hits") >= F.floor((F.col("n") + 1) / 2)).drop("n")


def usable_phrase(c: Column, starts: Sequence[str], ends: Sequence[str]) -> Column:
    bad = F.lit(False)
    for s in starts:
        bad = bad | c.startswith(s)
    for e in ends:
        bad = bad | c.endswith(e)
    return ~bad


def unknown_terms(
    asked: DataFrame, keys: Sequence[str], vocab: DataFrame, max_words: int = 4, share: float = 0.4, min_vocab: int = 300
) -> DataFrame:
    """Per question: distinct terms, unknown ones, and whether they make it off topic."""
    known = vocab.select("word").distinct().withColumn("known", F.lit(1))
    counts = asked.join(known, "word", "left").groupBy(*keys).agg(
        F.count("*").alias("terms"), F.count_if(F.col("known").isNull()).alias("unknown"))
    size = vocab.select("word").distinct().agg(F.count("*").alias("vocab"))  # one row
    off = (F.col("unknown") > 0) & (F.col("vocab") >= min_vocab) & (
        (F.col("terms") <= max_words) | (F.col("unknown") >= share * F.col("terms")))
    return counts.join(F.broadcast(size)).select(*keys, "terms", "unknown", off.alias("off_topic"))


def validate_graph(graph: DataFrame, node: DataFrame, alias: DataFrame, edge: DataFrame) -> DataFrame:
    """violation(graph_id, code, detail) for every broken rule of the graph tables.

    graph(graph_id, goal, forward_rels, negative_rels, grounds_rels), node(graph_id, node_id, layer, is_axiom,
    source_of), alias(graph_id, node_id), edge(graph_id, src, rel, dst).
    """
    def rows(df: DataFrame, code: str, detail: str) -> DataFrame:
        return df.select("graph_id", F.lit(code).alias("code"), F.col(detail).cast("string").alias("detail"))

    ids = node.select("graph_id", "node_id")
    ends = edge.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    rels = graph.select("graph_id", F.explode(F.array_distinct(F.concat("forward_rels", "negative_rels", "grounds_rels"))).alias("rel"))
    goals = graph.filter(F.col("goal").isNotNull()).join(
        node.select("graph_id", F.col("node_id").alias("goal"), "layer", "is_axiom"), ["graph_id", "goal"], "left")
    overlap = graph.withColumn("both", F.array_intersect("forward_rels", "negative_rels")).select(
        "graph_id", F.explode("both").alias("rel"))
    parts = [
        rows(graph.filter(F.col("goal").isNull()).withColumn("d", F.lit("goal")), "missing_key", "d"),
        rows(ends.join(ids, ["graph_id", "node_id"], "left_anti"), "undefined_node", "node_id"),
        rows(edge.select("graph_id", "rel").distinct().join(rels, ["graph_id", "rel"], "left_anti"), "unknown_relation", "rel"),
        rows(edge.filter("src = dst").select("graph_id", "src").distinct(), "self_loop", "src"),
        rows(goals.filter("layer IS NULL OR layer <> 'concept'"), "goal_not_concept", "goal"),
        rows(goals.filter("is_axiom"), "goal_is_axiom", "goal"),
        rows(ids.join(alias.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_anti"), "no_alias", "node_id"),
        rows(node.filter(F.col("source_of").isNotNull()).select("graph_id", F.col("source_of").alias("node_id")).distinct()
             .join(ids, ["graph_id", "node_id"], "left_anti"), "source_missing_node", "node_id"),
        rows(overlap, "overlapping_roles", "rel"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_events(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """violation(event_id, code): unknown type, bad quantity, a revision without a target or aimed forward."""
    checks = F.array_compact(F.array(
        F.when(~F.col("op").isin(list(kinds)), "unknown_type"),
        F.when(F.col("qty").isNull() | (F.col("qty") < 0), "bad_quantity"),
        F.when((F.col("op") == "revise") & F.col("target").isNull(), "revise_without_target"),
        F.when((F.col("op") == "revise") & (F.col("target") >= F.col("seq")), "revise_forward"),
    ))
    return events.select("ctx", "seq", F.explode(checks).alias("code"))
