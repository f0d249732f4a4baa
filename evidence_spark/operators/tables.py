"""Operators on graph tables and versioned collections: includes, overlays, duplicates, current versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def include_edges(graphs: DataFrame, edges: DataFrame, includes: DataFrame) -> DataFrame:
    """(graph_id, src, rel, dst) borrowed by includes(host, guest).

    A relation the host knows keeps its name; otherwise it takes the host's first name of the same role (grounds,
    forward, negative); a relation without a role is dropped.
    """
    roles = ["grounds_rels", "forward_rels", "negative_rels"]
    host = graphs.select(F.col("graph_id").alias("host"), *[F.col(r).alias(f"h_{r}") for r in roles])
    guest = graphs.select(F.col("graph_id").alias("guest"), *[F.col(r).alias(f"g_{r}") for r in roles])
    j = includes.join(host, "host").join(guest, "guest").join(edges.withColumnRenamed("graph_id", "guest"), "guest")
    known = F.array_contains(F.concat(*[f"h_{r}" for r in roles]), F.col("rel"))
    name = F.when(known, F.col("rel"))
    for r in roles:
        name = name.when(F.array_contains(f"g_{r}", F.col("rel")), F.get(f"h_{r}", F.lit(0)))
    return j.select(F.col("host").alias("graph_id"), "src", name.alias("rel"), "dst").filter(F.col("rel").isNotNull())


def include_conflicts(nodes: DataFrame, includes: DataFrame) -> DataFrame:
    """Concepts of the same name whose alias digest differs between host and guest: nodes(graph_id, node, aliases)."""
    a = nodes.select(F.col("graph_id").alias("host"), "node", F.col("aliases").alias("ha"))
    b = nodes.select(F.col("graph_id").alias("guest"), "node", F.col("aliases").alias("ga"))
    return includes.join(a, "host").join(b, ["guest", "node"]).filter("ha <> ga").select("host", "guest", "node")


def dup_knowledge(nodes: DataFrame, min_shared: int = 3, included: DataFrame | None = None) -> DataFrame:
    """(graphs, shared): node names found in the same set of at least two graphs; names of a null class do not count.

    The set of graphs per name is bounded by the number of graphs, a small table.
    """
    null = nodes.filter("is_null").select("node").distinct()
    real = nodes.filter("NOT is_null").select("graph_id", "node").distinct().join(null, "node", "left_anti")
    if included is not None:
        real = real.join(included, ["graph_id", "node"], "left_anti")
    sets = real.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("graph_id")), ",").alias("graphs"), F.count("*").alias("n"))
    return sets.filter("n >= 2").groupBy("graphs").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)


def select_current(versions: DataFrame, title: str, effective: str, key: str) -> DataFrame:
    """Latest effective version per exact title; ties go to the larger key."""
    return versions.groupBy(title).agg(F.max_by(key, F.struct(effective, key)).alias(key), F.max(effective).alias(effective))


def filter_precedents(cases: DataFrame, citation: str, article: Column) -> DataFrame:
    """Cases whose citation field, without white space, contains the article key."""
    squeezed = F.regexp_replace(F.col(citation), r"\s", "")
    return cases.filter(squeezed.contains(article))


def overlay(base: DataFrame, learned: DataFrame, denied: DataFrame, keys: list[str]) -> DataFrame:
    """Base and learned rows without repeats and without what was denied."""
    return base.select(*keys).unionByName(learned.select(*keys)).dropDuplicates(keys).join(denied.select(*keys).distinct(), keys, "left_anti")
