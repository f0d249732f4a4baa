"""Measurement jobs: overlap, interception, absorption, gates, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import match as M


def sentence_overlap(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Pairs sharing whole sentences (clean, lower case), with the number of distinct shared ones.

    The join key is a 128-bit sentence id; each side is made distinct first, so repeats cost nothing.
    """
    def ids(df: DataFrame, key: str) -> DataFrame:
        s = F.explode(T.sentences(F.col("text")))
        return df.select(key, s.alias("s")).select(key, M.text_id(F.lower("s")).alias("sid")).distinct()

    return ids(a, a_key).join(ids(b, b_key), "sid").groupBy(a_key, b_key).agg(F.count("*").alias("shared"))


def theft_audit(own: DataFrame, candidates: DataFrame, give_up: int = 8) -> DataFrame:
    """Sources of candidates(q, source, pure) that would take a question from a right source of own(q, owner, base); too many
    takers are reported as given up."""
    takers = candidates.join(own, "q").filter("pure >= base")
    counts = takers.groupBy("q", "owner").agg(F.count("*").alias("winners"))
    return takers.join(counts, ["q", "owner"]).select("q", "owner", "source", "winners", (F.col("winners") > give_up).alias("given_up"))


def alias_absorption(aliases: DataFrame) -> DataFrame:
    """(node, absorption, aliases, missing_aliases): mean over other nodes' phrases of the best own-alias coverage."""
    asked = aliases.select(F.col("node").alias("asked"), F.col("phrase").alias("asked_phrase"))
    pairs = M.coverage_pairs(aliases, "phrase", asked, "asked_phrase", 0.0, prefix=False).select("it", "ot", M.coverage().alias("cov"))
    # Best coverage of each asked text per owner first; copies of a phrase are attached afterwards.
    owner = aliases.select("node", M.text_id(F.col("phrase")).alias("it"))
    best = pairs.join(owner, "it").groupBy("node", "ot").agg(F.max("cov").alias("cov"))
    hits = M.attach(best, "ot", asked, "asked_phrase", ["asked"]).filter("asked <> node")
    sums = hits.groupBy("node").agg(F.sum("cov").alias("sum_cov"))
    counts = aliases.groupBy("node").agg(F.count("*").alias("aliases"))
    total = aliases.agg(F.count("*").alias("total"))  # one row
    return counts.join(sums, "node", "left").join(F.broadcast(total)).select(
        "node", F.round(F.coalesce("sum_cov", F.lit(0.0)) / (F.col("total") - F.col("aliases")), 6).alias("absorption"),
        "aliases", (F.col("aliases") < 3).alias("missing_aliases"))


def gate_report(results: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Accuracy on answerable cases per bucket and overall; a hold is not correct.

    results(dims..., answerable, outcome in correct / wrong / hold).  Grouping sets are pre-aggregated map-side.
    """
    view = results.select(*dims, "answerable", "outcome")
    rows = view.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("cases"),
        F.count_if(F.col("answerable")).alias("answerable"),
        F.count_if(F.col("answerable") & (F.col("outcome") == "correct")).alias("correct"),
        F.count_if(F.col("outcome") == "wrong").alias("wrong"),
    )
    return rows.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("answerable").cast("double")))


def regression_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): fixed / broken / same, from two boolean ``right`` columns; missing rows count as wrong."""
    b = before.select(key, F.col("right").alias("was"))
    a = after.select(key, F.col("right").alias("now"))
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return b.join(a, key, "full_outer").select(
        key, F.when(~was & now, "fixed").when(was & ~now, "broken").otherwise("same").alias("change"))


def latency_summary(cases: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, nearest-rank p90, max and total over cases without error."""
    ok = cases.filter(~F.col("error"))
    return ok.groupBy(*by).agg(
        F.expr(f"percentile({value}, 0.5)").alias("median"),
        F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {value})").alias("p90"),
        F.max(value).alias("max"), F.count("*").alias("cases"))


def bucketed_digest(df: DataFrame, row: Column) -> DataFrame:
    """One digest of all rows, independent of their order.

    Rows are hashed and equal rows counted; digests then fold in three levels by hash prefix (six and three hex digits,
    then all), so a group holds one row in sixteen million of the distinct rows, and later at most 4096 digests.
    """
    hashed = df.select(F.sha2(row, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    level = hashed.select(F.col("h").alias("key"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("digest"))
    for digits in (6, 3, 0):
        folded = F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256)
        level = level.groupBy(F.substring("key", 1, digits).alias("key")).agg(folded.alias("digest"))
    return level.select("digest")
