"""SQL surface: helpers in the session's function registry and table functions."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def coverage(inner: Column, outer: Column) -> Column:
    """Share of the inner text's gram weight found in the outer text; in the row, for short texts."""

    def share(bag: Column, held: Column) -> Column:
        shared = F.aggregate(F.filter(bag, lambda x: F.array_contains(held, x["gram"])), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        return shared / F.aggregate(bag, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])

    return T.bind(F.struct(T.weighted_grams(inner).alias("b"), F.array_distinct(T.gram_list(outer)).alias("o")), lambda s: share(s["b"], s["o"]))


def geometric_coverage(a: Column, b: Column) -> Column:
    return F.sqrt(coverage(a, b) * coverage(b, a))


class CharGrams:
    def eval(self, text: str):
        from collections import Counter
        import re

        if text is None:
            return
        base = re.sub(r"\d+(?:\.\d+)?", "§", text).strip(" ")
        marked = "\x02" + re.sub(r"[\W_]+", "\x03\x02", base) + "\x03"
        counts = Counter(marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1))
        yield from counts.items()


def passage_labels(passages, text: str, classifier=None):
    """Adds ``labels`` by a user's pandas function (Series of text -> Series of string arrays); without one nothing is guessed."""
    if classifier is None:
        return passages.withColumn("labels", F.array().cast("array<string>"))
    return passages.withColumn("labels", F.pandas_udf(classifier, "array<string>", F.PandasUDFType.SCALAR)(F.col(text)))


def register(spark: SparkSession) -> None:
    """char_grams(text) as a table function, decayed_activation(max(turn), now), text helpers as SQL functions."""
    spark.udtf.register("char_grams", F.udtf(CharGrams, returnType="gram string, n int"))
    # Only the last hit counts under the cap of one, so the aggregate is a function of max(turn).
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION decayed_activation(last BIGINT, now BIGINT) RETURNS DOUBLE RETURN CASE WHEN pow(0.75D, now - last) >= 0.02 THEN pow(0.75D, now - last) ELSE 0D END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION mask_numbers(t STRING) RETURNS STRING RETURN regexp_replace(t, '\\d+(?:\\.\\d+)?', '§')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION joined_text(t STRING) RETURNS STRING RETURN lower(regexp_replace(t, '[^0-9A-Za-z가-힣]', ''))")
