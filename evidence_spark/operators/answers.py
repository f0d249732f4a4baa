"""Answers from current state: totals, comparisons, unique bindings.  A missing side never becomes a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total(state: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Sum over a group if it has at least two distinct members and every value is known."""
    g = state.groupBy(group).agg(F.count_distinct(member).alias("members"), F.count(value).alias("known"), F.sum(value).alias("s"))
    return g.select(group, "members", "known", F.when((F.col("members") >= 2) & (F.col("known") == F.col("members")), F.col("s")).alias("total"))


def compare(asks: DataFrame, state: DataFrame) -> DataFrame:
    """asks(a, b) -> more / fewer / same, null when a side is missing."""
    left = asks.join(state.select(F.col("who").alias("a"), F.col("value").alias("av")), "a", "left")
    both = left.join(state.select(F.col("who").alias("b"), F.col("value").alias("bv")), "b", "left")
    out = F.when(F.col("av") > F.col("bv"), "more").when(F.col("av") < F.col("bv"), "fewer").when(F.col("av") == F.col("bv"), "same")
    return both.select("a", "b", out.alias("outcome"))


def attribute_compare(asks: DataFrame, entries: DataFrame) -> DataFrame:
    """Shared attributes of a pair that differ in value."""
    rows = entries.select("id", F.explode("attrs").alias("attr", "v"))
    a = asks.join(rows.select(F.col("id").alias("a"), "attr", F.col("v").alias("av")), "a")
    return a.join(rows.select(F.col("id").alias("b"), "attr", F.col("v").alias("bv")), ["b", "attr"]).filter("av <> bv").select("a", "b", "attr", "av", "bv")


def unique_answer(bindings: DataFrame) -> DataFrame:
    """An answer exists only if exactly one distinct binding matches (two-step distinct, so a hot ask spreads)."""
    return bindings.groupBy("ask").agg(F.count_distinct("binding").alias("bindings"), F.min("binding").alias("b")).select(
        "ask", "bindings", F.when(F.col("bindings") == 1, F.col("b")).alias("answer"))
