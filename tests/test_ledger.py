import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidence_spark.operators import ledger as L
from evidence_spark.operators.scan import prefix_scan

ROWS = "ctx int, seq bigint, op string, qty bigint"


def test_prefix_scan_equals_plain_window(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), i, rng.choice([None, 1, -2, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, seq bigint, v bigint")
    got = prefix_scan(df, ["k"], "seq", {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "l": ("last", F.col("v")), "p": ("last<", F.col("v"))}, block=16)
    w = Window.partitionBy("k").orderBy("seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "seq", "v", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.min("v").over(upto).alias("m"), F.last("v", True).over(upto).alias("l"), F.last("v", True).over(before).alias("p"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def state(spark, rows):
    return {r["ctx"]: (r["value"], r["status"]) for r in L.current_state(spark.createDataFrame(rows, ROWS)).collect()}


def test_current_state(spark):
    rows = [(1, 1, "set", 10), (1, 2, "remove", 4), (1, 3, "add", 2), (1, 4, "planned", 7), (2, 1, "add", 3), (3, 1, "set", 1), (3, 2, "remove", 2), (3, 3, "add", 9)]
    assert state(spark, rows) == {1: (8, "ok"), 2: (None, "missing_baseline"), 3: (None, "invalid")}


def test_transfer_and_correction(spark):
    ev = [(1, "has", 1, None, 5), (2, "has", 2, None, 3), (3, "transfer", 1, 2, 2)]
    rows = L.transfer_rows(spark.createDataFrame(ev, "seq bigint, kind string, holder int, other int, qty bigint"))
    assert {r["ctx"]: r["value"] for r in L.current_state(rows).collect()} == {1: 3, 2: 5}
    facts = spark.createDataFrame([(1, 1, "set", 5, None), (1, 2, "remove", 2, None), (1, 3, "revise", 1, 2), (1, 4, "revise", 4, 9)], ROWS + ", target bigint")
    assert L.current_state(L.apply_corrections(facts)).first()["value"] == 4


def as_of(spark, rows, day):
    t0 = datetime(2024, 1, 1)
    made = [(1, s, k, b, a, d, None if e is None else t0 + timedelta(days=e)) for s, k, b, a, d, e in rows]
    df = spark.createDataFrame(made, "ctx int, seq bigint, kind string, before bigint, after bigint, delta bigint, effective_at timestamp_ntz")
    r = L.state_as_of(df, F.lit(t0 + timedelta(days=day)).cast("timestamp_ntz")).first()
    return r["value"], r["reason"]


def test_as_of(spark):
    late = [(1, "quantity", 5, 7, 2, 3), (2, "quantity", 7, 6, -1, 1)]
    assert as_of(spark, late, 2) == (4, None) and as_of(spark, late, 3) == (6, None)
    assert as_of(spark, [(1, "value", None, 5, None, 3), (2, "value", 5, 9, None, 1)], 2) == (None, "time_order_state_conflict")
    assert as_of(spark, [(1, "quantity", 1, 2, 1, None)], 2) == (None, "untimed_state_change")
