"""Queries for the readers (S2, S3, S5, S6, S10): rows of the given tables are written in the format, read back and
compared with SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers as RD
from .job_plans import drain, replay
from .registry import Tables, query


def folder(t: Tables, label: str) -> str:
    return f"{shared_dir(t.spark)}/evidence_spark/source-{label}-{uuid.uuid4().hex}"


@query("s2_read_explain_graphs", """SELECT 'o' || l_orderkey AS graph_id, 'p' || l_partkey AS name, min(l_returnflag) AS excerpt1, min(l_linestatus) AS excerpt2 FROM lineitem GROUP BY l_orderkey, l_partkey""")
def s2(t: Tables) -> DataFrame:
    """One graph for each order, its parts as nodes."""
    parts = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"))
    node = F.struct(F.concat(F.lit("p"), "l_partkey"), F.struct(F.array("a", "b").alias("excerpts")))
    graphs = parts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(node)).alias("nodes"))
    path = folder(t, "explain")
    graphs.select(F.concat(F.lit("o"), "l_orderkey").alias("name"), "nodes").write.json(path)
    return RD.read_explain_graphs(t.spark, path, multi_line=False)


@query("s3_read_overlay", """SELECT CAST(doc_id AS VARCHAR) AS node, source AS phrase, quality = 1 AS confirmed FROM labels JOIN documents USING (doc_id) WHERE quality = 1 OR toxic = 1 OR quality = 0""")
def s3(t: Tables) -> DataFrame:
    """Labels as verdicts on phrases; broken lines among them are left out."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").cast("string").alias("node"), F.col("source").alias("phrase"), F.when(F.col("quality") == 1, "confirmed").otherwise("denied").alias("verdict"))
    path = folder(t, "overlay")
    rows.select(F.to_json(F.struct("node", "phrase", "verdict")).alias("value")).union(rows.limit(5).select(F.lit('{"node": broken'))).write.text(path)
    confirmed, denied = RD.split_overlay(RD.read_overlay(t.spark, path))
    return confirmed.withColumn("confirmed", F.lit(True)).unionByName(denied.withColumn("confirmed", F.lit(False)))


@query("s5_read_dictionary", """SELECT p_name AS word, 1 AS sense, p_type AS definition FROM part WHERE p_size > 10 UNION ALL SELECT p_name, 2, p_brand FROM part WHERE p_size > 10""")
def s5(t: Tables) -> DataFrame:
    """Part names as words with two senses; those of small size are written as verbs and not read."""
    pos = F.when(F.col("p_size") > 10, "noun").otherwise("verb")
    senses = F.array(F.struct(F.col("p_type").alias("definition")), F.struct(F.col("p_brand").alias("definition")))
    path = folder(t, "lexicon")
    t.part.select(F.col("p_name").alias("word"), pos.alias("pos"), senses.alias("sense")).write.format("xml").option("rootTag", "lexicon").option("rowTag", "entry").save(path)
    return RD.read_dictionary(t.spark, path)


@query("s6_read_cases", """SELECT 'c' || conv_id AS id, 'en' AS language, CAST(turn AS INTEGER) AS n, text AS say, role AS label, CASE WHEN role = 'user' THEN 'record' ELSE 'answer' END AS act FROM conversations""")
def s6(t: Tables) -> DataFrame:
    """Conversations as nested dialogue cases."""
    act = F.when(F.col("role") == "user", "record").otherwise("answer")
    turn = F.struct(F.col("turn").cast("int").alias("n"), F.col("text").alias("say"), F.col("role").alias("label"), F.struct(act.alias("act")).alias("expect"))
    path = folder(t, "cases")
    t.conversations.groupBy("conv_id").agg(F.collect_list(turn).alias("turns")).select(F.concat(F.lit("c"), "conv_id").alias("id"), F.lit("en").alias("language"), "turns").write.json(path)
    return RD.read_cases(t.spark, path, multi_line=False)


@query("s10_append_turns", """SELECT conv_id, turn, role, text FROM conversations""")
def s10(t: Tables) -> DataFrame:
    """Every turn is sent twice, over several batches, and stored once."""
    stream, root = replay(t, t.conversations.union(t.conversations), "turns", 2)
    drain(RD.append_turns(stream, f"{root}/out", f"{root}/ck"), root)
    return t.spark.read.parquet(f"{root}/out")
