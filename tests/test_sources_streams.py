import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from evidence_spark.operators import dialogue as D
from evidence_spark.operators import ledger as L
from evidence_spark.plans.catalog import ORACLES, QUERIES
from evidence_spark.plans.ledger_plans import ledger, turn_words
from evidence_spark.plans.registry import Tables
from evidence_spark.sources import readers as RD

SMALL = "/root/testdata/sf0.001"


def test_readers(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (root / "g").mkdir()
    (root / "g" / "bill.txt").write_text('role: split\n[concepts]\nshare: "each pays" | "split it"  # note\nbill@receipt: "the bill"\n[edges]\nbill -proves-> share, total\n')
    g = RD.read_graphs(spark, str(root / "g"))
    assert {(r.src, r.rel, r.dst) for r in g["edge"].collect()} == {("bill", "proves", "share"), ("bill", "proves", "total")}
    assert [r.phrase for r in g["alias"].filter("node_id = 'share'").orderBy("ord").collect()] == ["each pays", "split it"]
    assert {(r.node_id, r.source) for r in g["node"].collect()} == {("share", None), ("bill", "receipt")} and g["header"].first()["value"] == "split"
    (root / "o.jsonl").write_text('{"node": "a", "phrase": "p", "verdict": "ok"}\n{broken\n')
    assert RD.read_overlay(spark, str(root / "o.jsonl")).count() == 1
    (root / "d.xml").write_text("<l><entry><word>tea</word><pos>noun</pos><sense><definition>a drink</definition></sense><sense><definition>a meal</definition></sense></entry>"
                                "<entry><word>go</word><pos>verb</pos><sense><definition>move</definition></sense></entry></l>")
    assert [(r.word, r.sense) for r in RD.read_dictionary(spark, str(root / "d.xml")).collect()] == [("tea", 1), ("tea", 2)]
    (root / "c.json").write_text(json.dumps({"id": "x", "language": "en", "turns": [{"n": 1, "say": "hi", "label": "hold", "expect": {"act": "hold"}}]}))
    assert RD.read_cases(spark, str(root / "c.json")).first()["act"] == "hold"
    (root / "e.json").write_text(json.dumps({"name": "g", "nodes": {"n": {"excerpts": ["x" * 99, "second", "third"]}}}))
    row = RD.read_explain_graphs(spark, str(root / "e.json"), width=60).first()
    assert len(row["excerpt1"]) == 60 and row["excerpt2"] == "second"
    assert RD.content_manifest(spark, str(root / "g")).first()["lf"] == 6


def test_append_turns_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b")], "conv_id bigint, turn bigint, text string")
    for _ in range(2):
        rows.write.mode("append").parquet(root + "/in")
        s = spark.readStream.schema(rows.schema).parquet(root + "/in")
        RD.append_turns(s, root + "/out", root + "/ck").start().awaitTermination(120)
    assert spark.read.parquet(root + "/out").count() == 2


def test_stream_state_equals_batch(spark):
    t = Tables(spark, SMALL)
    got = {tuple(r) for r in QUERIES["t1_stream_state"](spark, SMALL).select("ctx", "value", "status", "events").collect()}
    assert got == {tuple(r) for r in L.current_state(ledger(t)).select("ctx", "value", "status", "events").collect()}


def test_stream_activation_equals_batch(spark):
    t = Tables(spark, SMALL)
    end = turn_words(t).groupBy("conv").agg(F.max("turn").alias("end"))
    live = QUERIES["t2b_stream_activation"](spark, SMALL).join(end, "conv")
    now = live.withColumn("a", F.col("activation") * F.pow(F.lit(0.75), F.col("end") - F.col("turn"))).filter("a >= 0.02")
    assert {(r.conv, r.node, round(r.a, 9)) for r in now.collect()} == {(r.conv, r.node, round(r.activation, 9)) for r in D.activation(turn_words(t)).collect()}


def test_stream_late_equals_batch(spark):
    got = {tuple(r) for r in QUERIES["t6_stream_late_effective"](spark, SMALL).select("ctx", "value", "reason").collect()}
    assert got == {tuple(r) for r in QUERIES["e7_state_as_of"](spark, SMALL).select("ctx", "value", "reason").collect()}


def test_catalog():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 170
    assert all(n == n.lower() for n in QUERIES)


def test_stream_activation_has_no_python_state(spark, tmp_path):
    from evidence_spark.streaming import jobs as S

    stream = spark.readStream.schema("conv long, node string, turn long").parquet(str(tmp_path))
    plan = S.stream_activation(stream)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan
