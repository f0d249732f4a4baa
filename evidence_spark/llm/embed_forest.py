"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Every tree cuts the vectors again and again across a random projection; those within a margin of a cut go to both sides.
The margin is at least what a pair at the threshold is apart in a projection, and a cut goes where it saves most work. A
node that no cut makes cheaper, as a group of near copies, stays whole.  Vectors are compared only inside leaves, all of them in double precision, and the links of all trees are
united.  A pair that meets in several leaves is counted in the first one only, which the two lists of leaves tell, so
no list of pairs is ever made: a leaf returns a count and a root for each of its vectors.

The cuts come from a bounded sample, every vector is put in every tree.  Equal vectors are one class with a size.  A
leaf that is too large for one task is dealt out as pairs of blocks, each block compared with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, in_arrow, ship

TREES, SPILL, LEAF = 8, 0.1, 512
#: The sample for the cuts: so many vectors, and so many numbers at most; a tree is at most so deep.
SAMPLE, SAMPLE_NUMBERS, DEEPEST = 20_000, 1 << 22, 10
#: Shares of a node at which cuts are tried, the middle first; a cut must leave at most so much of the node's pairs.
CUTS, GAIN = np.array(sorted(range(10, 91, 5), key=lambda q: abs(q - 50))) / 100, 0.9
#: A leaf with more rows is dealt out in blocks of this size.
BLOCK = 2048


class Forest:
    """Random directions and cuts: one direction for each tree and level, an interval around a cut for each node.

    An interval has at least the share ``spill`` of its node and the width ``margin``: as directions are normal, the
    projections of two vectors differ by their distance in root mean square, in any number of dimensions.  A node of at
    most ``least`` rows of the sample is not cut; one that isn't cut at a level goes down on the left as it is."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int, margin: float, least: float):
        self.depth, self.trees = depth, trees
        self.directions = np.random.default_rng(seed).normal(size=(trees, max(depth, 1), sample.shape[1]))
        self.low = np.zeros((trees, 1 << depth))
        self.high = np.zeros((trees, 1 << depth))
        for t in range(trees):
            at = sample @ self.directions[t].T
            inside = {1: np.arange(len(sample))}
            for level in range(depth):
                for node in range(1 << level, 2 << level):
                    rows = inside.pop(node)
                    values = at[rows, level]
                    cuts = self._cut(values, spill, margin) if len(rows) > least else (np.inf, np.inf)
                    self.low[t, node], self.high[t, node] = cuts
                    inside[2 * node], inside[2 * node + 1] = rows[values <= cuts[1]], rows[values >= cuts[0]]

    @staticmethod
    def _cut(values: np.ndarray, spill: float, margin: float) -> tuple[float, float]:
        """The interval that leaves fewest pairs on its two sides; infinite if that is not worth a cut."""
        values = np.sort(values)
        at = np.quantile(values, CUTS)
        low = np.minimum(at - margin / 2, np.quantile(values, np.maximum(CUTS - spill / 2, 0)))
        high = np.maximum(at + margin / 2, np.quantile(values, np.minimum(CUTS + spill / 2, 1)))
        left, right = np.searchsorted(values, high, "right"), len(values) - np.searchsorted(values, low, "left")
        pairs = (left / len(values)) ** 2 + (right / len(values)) ** 2
        best = int(pairs.argmin())
        return (low[best], high[best]) if pairs[best] <= GAIN else (np.inf, np.inf)

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """For each row of ``x`` the numbers of all its leaves, ascending; trees have ranges of numbers of their own."""
        found: list[list[int]] = [[] for _ in range(len(x))]
        for t in range(self.trees):
            at = x @ self.directions[t].T
            rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                values = at[rows, level]
                left, right = values <= self.high[t, nodes], values >= self.low[t, nodes]
                rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            for row, node in zip(rows.tolist(), nodes.tolist(), strict=True):
                found[row].append((t << self.depth) + node - (1 << self.depth))
        return [sorted(f) for f in found]


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes_of(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vec): ``key`` tells different vectors apart and is null where a vector can't be linked."""
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(kind).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                good = label is not None and bool(vec) and None not in vec
                x = np.array(vec if good else [0.0], np.float64) + 0.0
                square = float((x * x).sum())
                good = good and np.isfinite(square) and square > 0
                keys.append(xxhash.xxh3_128_hexdigest(x.tobytes()) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), batch.column(2)], names=["id", "label", "key", "vec"])

    return in_arrow(rows, run, f"id long, label string, key string, vec {kind}")


def met_before(codes: np.ndarray, code: int) -> np.ndarray:
    """A row of bits for each row of a leaf: the leaves with smaller numbers that it shares with any other row."""
    rows, at = np.nonzero((codes >= 0) & (codes < code))
    _, where, often = np.unique(codes[rows, at], return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    rows, bit = rows[often[where] > 1], shared[where[often[where] > 1]].astype(np.uint64)
    bits = np.zeros((len(codes), int(np.sum(often > 1)) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (rows, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return bits


def compare(x: np.ndarray, sizes: np.ndarray, codes: np.ndarray, blocks: np.ndarray, code: int, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of a leaf: linked vectors that it first meets here, and the smallest row it is joined
    to.  ``cross``: only rows of different blocks are compared."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    before = met_before(codes, code)
    ps, qs = [], []
    for a in range(0, n, 512):
        near = x[a : a + 512] @ x.T >= threshold
        near &= np.arange(n)[None, :] > np.arange(a, min(a + 512, n))[:, None]
        if cross:
            near &= blocks[None, :] != blocks[a : a + 512, None]
        p, q = np.nonzero(near)
        p += a
        for k in range(0, len(p), 20_000):
            pk, qk = p[k : k + 20_000], q[k : k + 20_000]
            first = ~(before[pk] & before[qk]).any(axis=1)
            np.add.at(links, pk[first], sizes[qk[first]])
            np.add.at(links, qk[first], sizes[pk[first]])
        # Only what joins new rows is kept for the roots, so no list of pairs grows.
        while len(p):
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = np.minimum(root, root[root])
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
        ps.append(np.arange(n))
        qs.append(root.copy())
    p, q = np.concatenate(ps), np.concatenate(qs)
    while True:
        low = np.minimum(root[p], root[q])
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        root = root[root]
        if (root[p] == root[q]).all():
            return links, root


def near_vectors(df: DataFrame, threshold: float = 0.93, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: vectors of the same label with a cosine of ``threshold`` or
    more, as found in the leaves of ``trees`` trees; none below it.

    A vector that is null, empty, zero or has null or non-finite numbers, or whose label is null, has no link; vectors of
    different lengths are not compared; equal vectors are linked; repeated ids are rows like others; a null id is larger
    than every id; other columns are not looked at."""
    spark = df.sparkSession
    ship(spark)
    every = materialize(classes_of(df, id_col, vec_col, label_col), "vectors")
    classes = every.filter("key IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("dim", F.size("vec")), "classes")
    leaves = None
    for dim, count in sorted((r.dim, r["count"]) for r in classes.groupBy("dim").count().collect()):  # lengths of vectors: few
        part = classes.filter(F.col("dim") == dim)
        most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))
        sample = [r.vec for r in part.orderBy(F.xxhash64("key"), "label").limit(most).select("vec").collect()]
        depth = max(0, min(DEEPEST, int(np.ceil(np.log2(max(count, 1) / leaf)))))
        margin = float(np.sqrt(max(0.0, 2 - 2 * threshold)))  # distance of unit vectors at the threshold
        forest = spark.sparkContext.broadcast(Forest(unit_rows(sample), depth, trees, spill, seed, margin, leaf * len(sample) / count))

        def put(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    piece = batch.slice(at, 1000)
                    codes = forest.value.leaves(unit_rows(piece.column(3).to_pylist()))
                    rows = pa.array(np.repeat(np.arange(len(codes)), [len(c) for c in codes]))
                    flat = [c for own in codes for c in own]
                    taken = [piece.column(i).take(rows) for i in range(5)]
                    known = [own[: i + 1] for own in codes for i in range(len(own))]  # up to this leaf
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(flat, pa.int64()), pa.array(known, pa.list_(pa.int64()))], names=["label", "rep", "size", "vec", "dim", "code", "codes"])

        kind = dict(classes.dtypes)["vec"]
        one = in_arrow(part.select("label", "rep", "size", "vec", "dim"), put, f"label string, rep long, size long, vec {kind}, dim int, code long, codes array<long>")
        leaves = one if leaves is None else leaves.union(one)
    c = F.col
    if leaves is None:
        return every.select(c("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), c("id").alias("component_id"), F.lit(True).alias("kept"))
    leaves = materialize(leaves, "leaves")
    large = leaves.groupBy("dim", "label", "code").agg(F.count(F.lit(1)).alias("rows")).filter(c("rows") > BLOCK)
    dealt = leaves.join(large, ["dim", "label", "code"], "left").withColumn("blocks", F.coalesce(F.ceil(c("rows") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), c("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("rows", "blocks", "other")

    def inside(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, code, x, y = (k.as_py() for k in key)
        lists = table.column("codes").to_pylist()
        codes = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for i, own in enumerate(lists):
            codes[i, : len(own)] = own
        reps = table.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")  # so that the root with the smallest row has the smallest id
        vectors = unit_rows(table.column("vec").to_pylist())[order]
        links, root = compare(vectors, table.column("size").to_numpy()[order], codes[order], table.column("block").to_numpy()[order], code, x != y, threshold)
        reps = reps[order]
        return pa.table({"rep": reps, "links": links, "root": reps[root]})

    found = dealt.groupBy("dim", "label", "code", "x", "y").applyInArrow(inside, "rep long, links long, root long").filter("links > 0 OR root <> rep")
    found = materialize(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("root <> rep").select(c("root").alias("a"), c("rep").alias("b")))
    whole = classes.select("label", "key", "rep", "size").join(links, "rep", "left").join(joined.select(c("id").alias("rep"), "component"), "rep", "left")
    whole = whole.select("label", "key", (c("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("least"))
    out = every.select("id", "label", "key").join(whole, ["label", "key"], "left")
    least = F.coalesce("least", "id")
    return out.select(c("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), c("id").eqNullSafe(least).alias("kept"))
