"""Logged conversations to training texts: snapshots that a longer log contains are collapsed before rendering.

A chat client logs the whole conversation after every turn, so most logs are prefixes of later ones.  Every turn gets a
rolling hash of all turns up to it, the running sum of hashes that include the turn's place.  A conversation whose last
hash is the hash of an inner turn of another one is a prefix of it and goes by an anti-join; of equal ones the smallest
id stays.  No two conversations are ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Turns of one block; a conversation of any length is hashed block by block, so that it spreads over tasks.
BLOCK = 256
SUMS = ("s1", "s2", "s3", "s4")


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def _sums_before(blocks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """For each block what the blocks of its conversation before it add up to."""
    past = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("conv", "block", *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"before_{c}") for c in columns))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, place, s1 to s4): the hash of the first ``place`` turns, as four sums of 32-bit parts, for every place.

    ``turns`` has conv, turn, role, text.  Places follow turn, then role, then text, nulls first."""
    rows = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).cast("long"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    counts = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.withColumn("k", F.row_number().over(inside)).join(_sums_before(counts, ("n",)), ["conv", "block"])
    said = (F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    placed = placed.select("conv", "block", (F.col("k") + F.col("before_n")).alias("place"), *(x.alias(f"x{i}") for i, x in enumerate(said)))
    one, two = F.xxhash64("place", "x0", "x1", "x2", "x3"), F.xxhash64("x3", "x2", "x1", "x0", "place")
    marked = placed.select("conv", "block", "place", _low(one).alias("s1"), _high(one).alias("s2"), _low(two).alias("s3"), _high(two).alias("s4"))
    totals = marked.groupBy("conv", "block").agg(*(F.sum(s).alias(s) for s in SUMS))
    running = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.join(_sums_before(totals, SUMS), ["conv", "block"])
    return both.select("conv", "place", *((F.sum(s).over(running) + F.col(f"before_{s}")).alias(s) for s in SUMS))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that no longer one begins with; ``n_copies`` counts equal logs,
    the smallest id stands for them."""
    marks = materialize(prefix_hashes(turns), "prefixes")
    lengths = marks.groupBy("conv").agg(F.max("place").alias("n_turns"))
    marks = marks.join(lengths, "conv")
    whole = marks.filter("place = n_turns").groupBy("place", *SUMS).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    inner = marks.filter("place < n_turns").select("place", *SUMS).distinct()
    return whole.join(inner, ["place", *SUMS], "left_anti").select("conv", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv, text): the turns of each conversation in order, each as its role in marks, a line break, its text and an
    end mark.  A null role is written as unknown, a null text as nothing.  A conversation is one text, so one row."""
    said = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("t"), "turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("x"), "text")))
    line = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))
    return turns.groupBy("conv").agg(F.array_join(F.transform(said, line), "").alias("text"))


def chat_texts(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, n_turns, n_copies, text) of every maximal conversation.

    Turns without a conversation id belong to none and are left out; equal turn numbers are ordered by role and text;
    repeated turns are turns like others; other columns are not looked at; an empty table gives no rows."""
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).filter("conv IS NOT NULL")
    kept = maximal(turns)
    return kept.join(render(turns.join(kept.select("conv"), "conv", "left_semi")), "conv").select(F.col("conv").alias(conv_col), "n_turns", "n_copies", "text")


ORACLE = """
WITH c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
e AS (SELECT min(conv_id) AS conv_id, l, count(*) AS n_copies FROM c GROUP BY l)
SELECT conv_id, len(l) AS n_turns, n_copies,
  array_to_string(['<|' || coalesce(x.r, 'unknown') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10) for x in l], '') AS text
FROM e WHERE NOT EXISTS (
  SELECT 1 FROM e AS b WHERE b.l[1] = e.l[1] AND len(b.l) > len(e.l) AND b.l[1:len(e.l)] = e.l)
"""
