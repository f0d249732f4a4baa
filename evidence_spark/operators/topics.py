"""Collected topic records as a graph: claims, facts and sources with the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components


def topic_groups(names: DataFrame) -> DataFrame:
    """(topic, root) from names(topic, alias): topics that share an alias, or are one, directly or over others, are one group,
    named by its smallest topic, so that a new record changes a name only where it joins groups."""
    pairs = names.select(F.col("topic").alias("a"), F.col("alias").alias("b")).dropna().distinct()
    groups = components(pairs).select(F.col("node").alias("topic"), "comp")
    topics = names.select("topic").dropna().distinct().join(groups, "topic", "left").withColumn("comp", F.coalesce("comp", "topic"))
    roots = topics.groupBy("comp").agg(F.min("topic").alias("root"))
    return topics.join(roots, "comp").select("topic", "root")


def _id(kind: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def topic_graph(records: DataFrame, goal: str = "goal") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of records(rec, topic, alias, source, url, title, sentence), a row for each alias or sentence that a
    record has (the other one null).

    nodes(node_id, kind, phrase, source): a claim for each group of topics, with all its names; a fact for each distinct
    sentence of a group, whose id is made of the sentence, with the address of the first record that has it; a
    source for each group and source, with the title and address of its last record.  edges(src, rel, dst): facts fulfil
    their claim, sources prove the facts they state, claims fulfil ``goal``.  Records without a topic or source are left
    out; a source or topic of any size is only ever counted or reduced to first and last rows."""
    c = F.col
    rows = records.filter("topic IS NOT NULL AND source IS NOT NULL")
    names = rows.filter("alias IS NOT NULL").select("topic", "alias").unionByName(rows.select("topic", c("topic").alias("alias"))).distinct()
    groups = materialize(topic_groups(names), "topic-groups")
    rows = materialize(rows.join(groups, "topic"), "topic-records")
    claim, origin = _id("claim", "root"), _id("source", "root", "source")
    fact = _id("fact", "root", F.substring(F.sha2("sentence", 256), 1, 16))
    # How many sources a claim has and the first two of them, from the distinct sources of each group.
    sources = rows.select("root", "source").distinct()
    two = F.slice(F.array_sort(F.collect_list("source")), 1, 2)
    first = sources.groupBy("root", F.pmod(F.xxhash64("source"), F.lit(64)).alias("share")).agg(F.count("*").alias("n"), two.alias("some"))
    told = first.groupBy("root").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, 2).alias("some"))
    told = told.select("root", F.concat(c("n").cast("string"), F.lit(" sources: "), F.array_join("some", ", "), F.when(c("n") > 2, " and others").otherwise("")).alias("source"))
    claims = names.join(groups, "topic").select("root", c("alias").alias("phrase")).distinct().join(told, "root")
    facts = rows.filter("sentence IS NOT NULL").groupBy("root", "sentence").agg(F.min(F.struct("source", "rec", "url")).alias("m"))
    last = rows.groupBy("root", "source").agg(F.max(F.struct("rec", "title", "url")).alias("m"))
    nodes = claims.select(claim.alias("node_id"), F.lit("claim").alias("kind"), "phrase", "source")
    nodes = nodes.unionByName(facts.select(fact.alias("node_id"), F.lit("fact").alias("kind"), c("sentence").alias("phrase"), c("m.url").alias("source")))
    nodes = nodes.unionByName(last.select(origin.alias("node_id"), F.lit("source").alias("kind"), F.coalesce("m.title", "source").alias("phrase"), c("m.url").alias("source")))
    stated = rows.filter("sentence IS NOT NULL").select("root", "source", "sentence").distinct()
    edges = facts.select(fact.alias("src"), F.lit("fulfils").alias("rel"), claim.alias("dst"))
    edges = edges.unionByName(stated.select(origin.alias("src"), F.lit("proves").alias("rel"), fact.alias("dst")))
    edges = edges.unionByName(groups.select("root").distinct().select(claim.alias("src"), F.lit("fulfils").alias("rel"), F.lit(goal).alias("dst")))
    return nodes, edges
