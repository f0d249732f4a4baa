"""Nearest vectors within a group.

Vectors of length one have a distance that is a metric and falls as the cosine grows, so distances to a pivot bound the
distances of vectors: a block or tile whose bound lies beyond the k-th best found so far is never compared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a block; a task holds two blocks.  Vectors of a tile, the unit of a matrix product.
BLOCK = 8192
TILE = 256
BINS = 256
#: Scores are compared as rounded to six digits; bounds give way by more than that.
SLACK = 2e-6
ROWS = "id bigint, other bigint, score double, formed bigint, possible bigint"


class _Block:
    """Vectors of one block in order of their distance to the pivot, in tiles with a centre and a radius."""

    def __init__(self, ids: list, far: list, vectors: np.ndarray, bar: list):
        order = np.lexsort((ids, far))
        self.ids, self.far, self.v = np.array(ids)[order], np.array(far)[order], vectors[order]
        self.bar = np.array(bar, np.float64)[order]
        self.tiles = [slice(a, min(a + TILE, len(ids))) for a in range(0, len(ids), TILE)]
        self.centre = np.array([self.v[t].mean(axis=0) for t in self.tiles])
        self.radius = np.array([np.sqrt(((self.v[t] - c) ** 2).sum(axis=1).max()) for t, c in zip(self.tiles, self.centre, strict=True)])
        self.low, self.high = (np.array([f(self.far[t]) for t in self.tiles]) for f in (np.min, np.max))


def _bound(a: _Block, i: int, b: _Block) -> np.ndarray:
    """For each tile of ``b`` a distance that no vector of it falls below, seen from tile ``i`` of ``a``."""
    by_centre = np.sqrt(((b.centre - a.centre[i]) ** 2).sum(axis=1)) - b.radius - a.radius[i]
    by_pivot = np.maximum(b.low - a.high[i], a.low[i] - b.high)
    return np.maximum(np.maximum(by_centre, by_pivot), 0.0)


def _nearest_in(a: _Block, b: _Block, k: int) -> tuple[list, int]:
    """((id, other, score) columns of the k best of ``b`` for each vector of ``a``, as far as they can be among the k best
    of all; tile pairs formed)."""
    out, formed = [], 0
    for i, tile in enumerate(a.tiles):
        ids, n = a.ids[tile], tile.stop - tile.start
        best = np.full((n, k), -np.inf)
        other = np.full((n, k), np.iinfo(np.int64).max)
        bar = a.bar[tile]
        bound = _bound(a, i, b)
        for j in np.argsort(bound, kind="stable"):
            # Distance d of unit vectors is a cosine of 1 - d * d / 2.
            if 1 - bound[j] ** 2 / 2 < np.maximum(best[:, -1], bar).min() - SLACK:
                break
            formed += 1
            s = np.round(a.v[tile] @ b.v[b.tiles[j]].T, 6)
            theirs = b.ids[b.tiles[j]]
            s[ids[:, None] == theirs[None, :]] = -np.inf
            s = np.concatenate([best, s], axis=1)
            who = np.concatenate([other, np.broadcast_to(theirs, (n, len(theirs)))], axis=1)
            order = np.lexsort((who, -s), axis=1)[:, :k]
            best, other = np.take_along_axis(s, order, 1), np.take_along_axis(who, order, 1)
        keep = np.isfinite(best) & (best >= bar[:, None] - SLACK)
        out.append((np.repeat(ids, keep.sum(axis=1)), other[keep], best[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)], formed


def _compare(dealt: DataFrame, k: int) -> DataFrame:
    """ROWS of dealt(g, i, j, role, id, far, bar, v): block i asks, block j answers; where both are one, roles are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def out() -> pa.RecordBatch:
            blocks = {role: _Block(ids, far, np.stack(v), bar) for role, (ids, far, bar, v) in held.items()}
            asks, answers = blocks.get(0), blocks.get(1, blocks.get(0))
            if asks is None:
                return pa.RecordBatch.from_pylist([], schema=made)
            columns, formed = _nearest_in(asks, answers, k)
            n = len(columns[0])
            counts = [pa.array([None] * n + [x], pa.int64()) for x in (formed, len(asks.tiles) * len(answers.tiles))]
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(c), pa.nulls(1, pa.array(c).type)]) for c in columns), *counts], schema=made)

        made = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("score", pa.float64()), ("formed", pa.int64()), ("possible", pa.int64())])
        for batch in batches:
            vectors = [np.asarray(x) for x in np.split(np.asarray(batch["v"].flatten(), np.float64), np.cumsum(batch["v"].value_lengths())[:-1])] if batch.num_rows else []
            for g, i, j, role, key, far, bar, v in zip(*(batch[c].to_pylist() for c in ("g", "i", "j", "role", "id", "far", "bar")), vectors, strict=True):
                if group != (g, i, j):
                    if held:
                        yield out()
                    group, held = (g, i, j), {}
                for column, value in zip(held.setdefault(role, ([], [], [], [])), (key, far, bar, v), strict=True):
                    column.append(value)
        if held:
            yield out()

    dealt = dealt.select("g", "i", "j", "role", "id", "far", "bar", "v").repartition(4 * width(dealt.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(run, ROWS)


def nearest_rows(df: DataFrame, key: str, vector: str, group: str, k: int, block: int = BLOCK) -> DataFrame:
    """ROWS: candidates (id, other, score) that hold the k nearest of each vector, and rows without an id that count the
    tile pairs ``formed`` of those ``possible``."""
    c = F.col
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = df.select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("id"), norm.alias("norm"), vector).filter("g IS NOT NULL AND id IS NOT NULL AND norm > 0")
    unit = unit.select("g", "id", F.transform(vector, lambda x: x.cast("double") / c("norm")).alias("v"))
    # A pivot and the number of blocks for each group; blocks are ranges of the distance to it, split by a hash where
    # there are more of them than ranges.
    groups = unit.groupBy("g").agg(F.ceil(F.count("*") / (block / 2)).cast("int").alias("blocks"), F.min_by("v", F.xxhash64("id")).alias("pivot"))
    dot = F.aggregate(F.zip_with("v", "pivot", lambda x, y: x * y), F.lit(0.0).cast("double"), lambda a, x: a + x)
    placed = unit.join(groups, "g").withColumn("far", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))).drop("pivot")
    placed = materialize(placed, "vectors")
    cuts = placed.filter("blocks > 1").groupBy("g").agg(F.percentile_approx("far", [x / BINS for x in range(1, BINS)], 10_000).alias("cuts"))
    ranges = F.least("blocks", F.lit(BINS))
    bin_of = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < c("far")))
    share = F.pmod(F.xxhash64("id"), F.ceil(c("blocks") / ranges)).cast("int")
    placed = placed.join(cuts, "g", "left").select("g", "id", "v", "far", (F.floor(bin_of * ranges / BINS) * F.ceil(c("blocks") / ranges) + share).cast("int").alias("i"))
    placed = materialize(placed, "vectors")
    none = F.lit(-2.0)
    own = _compare(placed.select("g", "i", c("i").alias("j"), F.lit(0).alias("role"), "id", "far", none.alias("bar"), "v"), k)
    own = materialize(own, "nearest")
    # The k-th best inside its own block is what a vector asks for from the others.
    last = own.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k).select("id", "bar")
    asks = placed.join(last, "id", "left").select("g", "i", "id", "far", F.coalesce("bar", none).alias("bar"), "v")
    asks = materialize(asks, "vectors")
    reach = asks.groupBy("g", "i").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.min("bar").alias("least"))
    other = reach.select("g", c("i").alias("j"), c("low").alias("low2"), c("high").alias("high2"))
    gap = F.greatest(c("low2") - c("high"), c("low") - c("high2"), F.lit(0.0))
    # One row for each two blocks of a group, no vectors.
    pairs = reach.join(other, "g").filter(c("i") != c("j")).filter(1 - gap * gap / 2 >= c("least") - SLACK).select("g", "i", "j")
    pairs = materialize(pairs, "blocks")
    one = asks.join(pairs, ["g", "i"]).select("g", "i", "j", F.lit(0).alias("role"), "id", "far", "bar", "v")
    two = asks.withColumnRenamed("i", "j").join(pairs, ["g", "j"]).select("g", "i", "j", F.lit(1).alias("role"), "id", "far", "bar", "v")
    return own.unionByName(_compare(one.unionByName(two), k))


def nearest(df: DataFrame, key: str, vector: str, group: str, k: int, block: int = BLOCK) -> DataFrame:
    """(key, other, score, k): exact top-k cosine neighbours inside the same group; equal scores by the smaller neighbour.

    Vectors without an id or group, and those of length zero, have no neighbours.  A group spreads: pairs of its blocks
    are dealt out by group and both blocks, and only blocks whose distances to the pivot allow for a better neighbour
    than the k-th one inside the own block meet."""
    near = nearest_rows(df, key, vector, group, k, block).filter("id IS NOT NULL")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    top = near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    return top.select(F.col("id").alias(key), "other", "score", "k")
