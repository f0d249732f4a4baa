"""Vector columns: hashed gram vectors and symmetric quantisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T


def signed_hash_vectors(df: DataFrame, key: str, text: str, dim: int = 4096) -> DataFrame:
    """Sparse (key, slot, inner, outer): inner is the share of signed weight, outer the clipped presence."""
    grams = df.select(key, F.explode_outer(T.weighted_grams(F.col(text))).alias("g"))
    slot, sign = T.signed_hash(F.col("g.gram"), dim)
    cells = grams.select(key, slot.alias("slot"), sign.alias("sign"), F.col("g.n").alias("n"))
    sums = cells.groupBy(key, "slot").agg(
        F.sum(F.col("n") * F.col("sign")).alias("signed"), F.sum("sign").alias("present"), F.sum("n").alias("weight")
    )
    totals = cells.groupBy(key).agg(F.sum("n").alias("total"))
    return sums.join(totals, key).select(
        key, "slot", F.round(F.col("signed") / F.col("total"), 9).alias("inner_weight"),
        F.greatest(F.lit(-1), F.least(F.lit(1), F.col("present"))).cast("int").alias("outer_weight"),
    )


def quantize(df: DataFrame, vector: str, group: Sequence[str], bits: int = 8) -> DataFrame:
    """Adds ``scale`` (one per group) and ``q`` (array<int>): x is about q * scale."""
    top = 2 ** (bits - 1) - 1
    peak = F.array_max(F.transform(F.col(vector), lambda x: F.abs(x.cast("double"))))
    scales = df.groupBy(*group).agg((F.max(peak) / top).alias("scale"))
    return df.join(scales, list(group)).withColumn(
        "q", F.transform(vector, lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.round(
            F.try_divide(x.cast("double"), F.col("scale"))))).cast("int")))


def dequantize(q, scale):
    return F.transform(q, lambda x: x * scale)
