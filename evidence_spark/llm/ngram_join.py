"""Near-duplicate documents by Jaccard similarity of word shingles: a size-aware heavy-light join.

*Light sets* (few shingles) list all subsets of the size that two linked sets must have in common; equal subsets meet
as equal keys.  *Heavy sets* are put in inverted lists, one for each shingle of a prefix long enough that linked sets
share one of its shingles, and the lists are scanned.  The border between the two is the size up to which listing
subsets costs less than scanning, from the sizes and list lengths of the very data.

Prefixes take rare shingles first: shingles in many lists (passages that many documents share) are counted exactly and
moved to the end of the common order, which changes no result, as any order shared by all sets finds every pair.

Groups of many near copies make lists of which every two members are linked.  Their pairs are not listed: each member
is checked against one hub of its list first, and then members that the links found so far do not connect meet in
tasks, which check their sets and let out one link for each connection that it makes.  So every pair of sets is linked over
checked links or has been checked itself.  Before sets are compared, folded bit maps bound their difference, which throws
out almost all unlinked pairs exactly.

Sets are of 64-bit hashes; equal sets (whatever the texts) are one class with a 64-bit key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, width
from .common import UnitCache, components, in_arrow

_K = np.uint64(0x9E3779B97F4A7C15)
#: Lists longer than this are of frequent shingles; at most so many of those are moved back, the longest first.
LONG_LIST, MOST_FREQUENT = 20, 1 << 20
#: What it costs to check a candidate, in entries written.
CHECK_COST = 8
#: Classes are looked up by a broadcast of their ids up to so many, by a shuffle beyond.
SMALL = 1 << 20
FEW = 1 << 17
BITS = 1024
#: Lists up to this size are compared row by following row, longer ones by strips; those over ``LIST_BLOCK`` are dealt out.
SHORT, LIST_BLOCK = 32, 2048
#: Classes of one block of a group whose members meet with their sets, as pairs of blocks.
BLOCK = 1024
#: Sets up to this size are kept whole; subsets are listed of smaller ones only.
ALL_KEPT = 64


class Likeness:
    """Jaccard similarity of at least ``num`` / ``den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def common(self, a, b):
        """The fewest common shingles of linked sets of sizes ``a`` and ``b`` (numbers or columns of long)."""
        top = self.num * (a + b)
        if isinstance(top, Column):
            return F.ceil(top / F.lit(self.num + self.den)).cast("long")  # exact for sizes below 2 ** 40
        return -(-top // (self.num + self.den))

    def least(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def near_sizes(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def subsets(self, n: int, light: int) -> list[tuple[int, int]]:
        """(partner size, elements to leave out) for the light sizes that a set of size ``n`` may be linked to; equal
        sets are one class, so a common size of ``n`` for two sets of size ``n`` needs none."""
        sizes = range(self.least(n), min(light, n * self.den // self.num) + 1)
        return [(m, n - self.common(n, m)) for m in sizes if not (m == n and self.common(n, m) == n)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_WORDS = UnitCache(xxhash.xxh3_64_intdigest, 60_000)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles: ``words`` words each, or the whole text if it has fewer.

    Words are runs of anything but ASCII white space, with A to Z in lower case; none give no shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not parts:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(codes))
    out = np.full(len(codes) - width + 1, np.uint64(width))
    for j in range(width):
        out = out * _K + codes[j : len(codes) - width + 1 + j]
    return np.unique(mix(out))


def class_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def folded(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of ``BITS`` bits: two sets differ in at least as many shingles as bits."""
    parity = np.bincount((found >> np.uint64(11)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def profiles(docs: DataFrame, words: int, like: Likeness) -> DataFrame:
    """(id, n, cls, bits, front): class, folded bits and the first shingles of each document: twice the prefix, all of
    a small set."""

    def front(found: np.ndarray) -> np.ndarray:
        return found if len(found) <= ALL_KEPT else found[: 2 * like.prefix(len(found))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = batch.slice(at, 500).columns
                sets = [shingles(text, words) for text in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets]), pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                     _lists([folded(s) if len(s) else np.empty(0, np.int64) for s in sets]), _lists([front(s) for s in sets])],
                    names=["id", "n", "cls", "bits", "front"],
                )

    return in_arrow(docs, run, "id long, n long, cls long, bits array<long>, front array<long>")


def frequent(every: DataFrame, like: Likeness) -> np.ndarray:
    """The shingles of long lists, sorted: first of all prefixes, then of what stands behind in the sets that have one.

    Only an order is made of them, so how many are found never changes a result."""
    counted = every.select(F.explode(F.slice("front", F.lit(1), _prefix(like))).alias("w"))
    found = materialize(_long(counted), "frequent")
    if found.isEmpty():
        return np.empty(0, np.uint64)
    hot = _column(found)
    shared = every.sparkSession.sparkContext.broadcast(hot)  # at most MOST_FREQUENT numbers

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten().to_numpy()
            is_hot = _in(shared.value, flat.view(np.uint64))
            parts = [flat[a + p : b] for a, b, p in zip(ends, ends[1:], map(like.prefix, n.tolist()), strict=False) if is_hot[a : a + p].any()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts))], names=["w"])

    more = _long(in_arrow(every.select("n", "front"), behind, "w long"))
    return _column(found.union(more).groupBy("w").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "w").limit(MOST_FREQUENT))


def _prefix(like: Likeness) -> Column:
    return (F.col("n") - F.ceil(F.col("n") * like.num / F.lit(like.den)) + 1).cast("int")


def _long(shingles_of: DataFrame) -> DataFrame:
    return shingles_of.groupBy("w").count().filter(F.col("count") > LONG_LIST).orderBy(F.desc("count"), "w").limit(MOST_FREQUENT)


def _column(rows: DataFrame) -> np.ndarray:
    return np.sort(np.array([r.w for r in rows.select("w").collect()], np.int64).view(np.uint64))


def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def border(every: DataFrame, like: Likeness) -> int:
    """The largest size up to which listing subsets costs less than scanning lists, from the small sets' own lists."""
    lists = every.filter(F.col("n") <= ALL_KEPT).select(F.explode(F.slice("front", F.lit(1), _prefix(like))).alias("w")).groupBy("w").count()
    short = F.least("count", F.lit(LONG_LIST))
    met = lists.agg(F.sum(short * (short - 1)).alias("met"), F.sum("count").alias("all")).first()
    partners = (met["met"] or 0) / (met["all"] or 1)
    light = 0
    while light < ALL_KEPT // 2:
        n = light + 1
        if sum(comb(n, out) for _, out in like.subsets(n, n)) > like.prefix(n) * (1 + CHECK_COST * partners):
            break
        light = n
    return light


def entries(every: DataFrame, docs: DataFrame, words: int, like: Likeness, hot: np.ndarray, light: int) -> DataFrame:
    """(w, cls, n, pos): the keys of each document's set: shingles of its prefix with their place in the common order,
    or subsets (place -1).  A class that a task meets again is not repeated, as far as it remembers.

    What was kept of a set is enough unless frequent shingles fill it; then the text is read again."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def keys(front: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys of a set of size ``n`` from its first shingles; None if they are too few."""
        made, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        if n <= light:
            for m, out in like.subsets(n, light):
                gone = np.array(list(combinations(range(n), out)), np.int64).reshape(comb(n, out), out)
                left = front.sum(dtype=np.uint64, keepdims=True) - front[gone].sum(axis=1, dtype=np.uint64)
                made.append(mix(left + np.full(1, min(n, m) * 4096 + max(n, m), np.uint64) * _K))
                places.append(np.full(len(left), -1, np.int64))
        if n > light or n * like.den >= (light + 1) * like.num:  # heavy, or may be linked to a heavy one
            is_hot = _in(shared.value, front)
            rare = front[~is_hot]
            if len(rare) < like.prefix(n):
                if len(front) < n:
                    return None
                rare = np.concatenate([rare, front[is_hot]])
            made.append(rare[: like.prefix(n)])
            places.append(np.arange(like.prefix(n)))
        return np.concatenate(made), np.concatenate(places)

    def rows_of(sets: Iterator[tuple[int, int, np.ndarray]], seen: set[int]) -> Iterator[pa.RecordBatch]:
        w, cls, size, pos = [], [], [], []
        for key, n, front in sets:
            if key in seen or (found := keys(front, n)) is None:
                continue
            if len(seen) >= 500_000:
                seen.clear()
            seen.add(key)
            w.append(found[0].view(np.int64))
            pos.append(found[1])
            cls.append(np.full(len(found[0]), key, np.int64))
            size.append(np.full(len(found[0]), n, np.int64))
        if w:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (w, cls, size, pos)], names=["w", "cls", "n", "pos"])

    def fronts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())]).tolist()
        flat = batch.column(2).flatten().to_numpy().view(np.uint64)
        for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            yield key, n, flat[ends[i] : ends[i + 1]]

    def from_fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from rows_of(fronts(batch.slice(at, 500)), seen)

    def too_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [keys(front, n) is None for _, n, front in fronts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0)], names=["id", "cls"]).filter(pa.array(short, pa.bool_()))

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = (shingles(text, words) for text in batch.slice(at, 500).column(0).to_pylist())
                yield from rows_of(((class_key(s), len(s), s) for s in found if len(s)), seen)

    schema = "w long, cls long, n long, pos long"
    kept = every.select("cls", "n", "front", "id")
    made = in_arrow(kept, from_fronts, schema)
    if not len(hot):
        return made
    short = in_arrow(kept.filter(F.col("n") > ALL_KEPT), too_short, "id long, cls long").groupBy("cls").agg(F.min("id").alias("short_id")).select("short_id").distinct()
    short = materialize(short, "short")
    again = docs.join(F.broadcast(short) if short.count() <= SMALL else short, F.col("id").eqNullSafe(F.col("short_id")), "left_semi")
    return made.union(in_arrow(again.select("text"), from_texts, schema))


def _may_link(like: Likeness, na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """Sizes are near enough, and so few shingles come before this one that it can be the first common one."""
    return like.near_sizes(na, nb) & ((pa_ < 0) | (pa_ + pb <= na + nb - 2 * like.common(na, nb)))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, set): the shingles of the classes ``wanted`` (cls), read again from the text of one of their documents."""
    wanted = materialize(wanted.join(classes, "cls").select("cls", F.col("id").alias("wanted_id")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= SMALL else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, texts = batch.slice(at, 500).columns
                sets = [shingles(t, words) for t in texts.to_pylist()]
                own = pa.array([len(s) > 0 and class_key(s) == k for k, s in zip(keys.to_pylist(), sets, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([keys, _lists(sets)], names=["cls", "set"]).filter(own)

    # Another row may have the id of a class's first row: only the set of the class counts, and once.
    sets = in_arrow(docs.join(side, F.col("id").eqNullSafe(F.col("wanted_id"))).select("cls", "text"), run, "cls long, set array<long>")
    return materialize(sets.groupBy("cls").agg(F.first("set").alias("set")), "sets")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, like: Likeness) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb), classes, that are linked: by folded bits, then by the sets themselves."""
    bits = classes.select("cls", "bits")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(bits.select(F.col("cls").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("cls").alias("b"), F.col("bits").alias("y")), "b")
    near = materialize(near.filter(differ <= F.col("na") + F.col("nb") - 2 * like.common(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb"), "near")
    sets = _sets(docs, classes, near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), words)
    inter = F.size(F.array_intersect("x", "y")).cast("long")
    found = near.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a")
    found = found.withColumn("i", inter).filter(F.col("i") * like.den >= (F.col("na") + F.col("nb") - F.col("i")) * like.num)
    return materialize(found.select("a", "b"), "links")


def _close(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of rows of one list that are of different components and may be linked, by sizes, places and bits."""
    na, nb = rows["n"][i], rows["n"][j]
    most = na + nb - 2 * like.common(na, nb)
    ok = (rows["component"][i] != rows["component"][j]) & (na * like.den >= nb * like.num) & (nb * like.den >= na * like.num)
    ok &= (rows["pos"][i] < 0) | (rows["pos"][i] + rows["pos"][j] <= most)
    ok &= (rows["x"][i] == rows["y"][i]) | (rows["block"][i] != rows["block"][j])
    i, j, most = i[ok], j[ok], most[ok]
    near = [np.bitwise_count(rows["bits"][i[k : k + 10_000]] ^ rows["bits"][j[k : k + 10_000]]).sum(axis=1) <= most[k : k + 10_000] for k in range(0, len(i), 10_000)]
    near = np.concatenate(near) if near else np.empty(0, bool)
    return i[near], j[near]


def _within(rows: dict[str, np.ndarray], start: np.ndarray, like: Likeness) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of rows of the same list; lists begin at ``start``.  Short lists are compared all at once, row by
    following row; long ones by strips, so that memory stays bounded."""
    total = len(rows["w"])
    size = np.diff(np.append(start, total))
    end = np.repeat(start + size, size)
    short = np.repeat(size <= SHORT, size)
    at = np.flatnonzero(short)
    for step in range(1, int(size[size <= SHORT].max(initial=0))):
        at = at[at + step < end[at]]
        yield _close(rows, at, at + step, like)
    for a, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        for k in range(a, a + n, 32):
            i, j = np.meshgrid(np.arange(k, min(k + 32, a + n)), np.arange(k + 1, a + n), indexing="ij")
            ahead = j > i
            yield _close(rows, i[ahead], j[ahead], like)


def _doubtful(lists: DataFrame, like: Likeness) -> DataFrame:
    """(least, cls, n, component): members of lists (w, cls, n, pos, component, least, bits) that may be linked, by sizes,
    places and bits, to a member of another component; ``least`` is the smallest component of the list.

    Pairs are formed inside tasks and only members leave them.  A long list is dealt out as pairs of blocks, so
    it spreads over tasks and no task holds more than two blocks of it."""
    c = F.col
    large = materialize(lists.groupBy("w").count().filter(c("count") > LIST_BLOCK), "long-lists")
    side = F.broadcast(large) if large.count() <= SMALL else large
    dealt = lists.join(side, "w", "left").withColumn("blocks", F.coalesce(F.ceil(c("count") / LIST_BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), c("blocks")).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), c("blocks").cast("long") - 1)))
    cells = dealt.select("w", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "n", "pos", "component", "least", "bits")
    names = ("w", "x", "y", "block", "cls", "n", "pos", "component", "least")

    def close(rows: dict[str, np.ndarray], start: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(rows["w"]), bool)
        for i, j in _within(rows, start, like):
            found[i] = found[j] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[k][found]) for k in ("least", "cls", "n", "component")], names=["least", "cls", "n", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None  # of the list that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {name: batch.column(k).to_numpy() for k, name in enumerate(names)}
            rows["bits"] = batch.column(len(names)).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            if rest is not None:
                rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
            new = np.flatnonzero((rows["w"][1:] != rows["w"][:-1]) | (rows["x"][1:] != rows["x"][:-1]) | (rows["y"][1:] != rows["y"][:-1])) + 1
            start = np.concatenate([[0], new])
            whole = {k: v[: start[-1]] for k, v in rows.items()}
            if len(start) > 1:
                yield from close(whole, start[:-1])
            rest = {k: v[start[-1] :] for k, v in rows.items()}
        if rest is not None:
            yield from close(rest, np.zeros(1, np.int64))

    placed = cells.repartition("w", "x", "y").sortWithinPartitions("w", "x", "y")
    return in_arrow(placed, run, "least long, cls long, n long, component long").distinct()


class _Cell:
    """Classes of one cell: their sets, sizes, bits and components."""

    def __init__(self):
        self.sets, self.n, self.bits, self.component, self.block, self.cls = [], [], [], [], [], []

    def links(self, like: Likeness) -> tuple[list[int], list[int]]:
        """Links that connect components, each checked on the sets themselves; at most one for each that it connects."""
        n, block, cls = (np.array(x, np.int64) for x in (self.n, self.block, self.cls))
        bits = np.stack(self.bits)
        root = np.unique(np.array(self.component, np.int64), return_inverse=True)[1]
        # The largest component comes last: its members are only looked at from outside.
        order = np.lexsort((cls, root, np.bincount(root)[root]))
        n, block, cls, bits, root = n[order], block[order], cls[order], bits[order], root[order]
        sets = [self.sets[k] for k in order.tolist()]
        apart = np.concatenate([[0], np.cumsum(np.diff(block) != 0)])[-1] > 0
        a, b = [], []
        for i in range(len(n) - 1):
            j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            if not len(j):
                continue
            if apart:  # pairs of one block are looked at in that block's own cell
                j = j[block[j] != block[i]]
            j = j[(n[j] * like.den >= n[i] * like.num) & (n[i] * like.den >= n[j] * like.num)]
            most = n[i] + n[j] - 2 * like.common(n[i], n[j])
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
            near = differ <= most
            j, differ = j[near], differ[near]
            for k in j[np.argsort(differ, kind="stable")].tolist():
                if root[k] == root[i]:
                    continue
                shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if shared * like.den >= (n[i] + n[k] - shared) * like.num:
                    a.append(int(min(cls[i], cls[k])))
                    b.append(int(max(cls[i], cls[k])))
                    root[root == root[k]] = root[i]
        return a, b


def _apart(members: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): links between ``members`` (least, cls, n, component) with the same ``least`` that no link found so far
    connects, from sets (cls, set).

    Lists with the same smallest component are mostly of one group of near copies, so their members meet once for all of
    them, each with its set.  A group is dealt out as pairs of blocks; a task holds two blocks and lets out no more links
    than it connects components, so no group becomes pairs."""
    c = F.col
    sizes = members.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    large = materialize(sizes, "large-groups")
    side = F.broadcast(large) if large.count() <= SMALL else large
    dealt = members.join(side, "least", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), c("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    cells = dealt.select("least", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "n", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cell = None, _Cell()
        for batch in batches:
            columns = [batch[k].to_pylist() for k in ("least", "x", "y", "block", "cls", "n", "component")]
            ends = np.concatenate([[0], np.cumsum(batch["set"].value_lengths().to_numpy())]).tolist()
            flat = batch["set"].flatten().to_numpy()
            for k, (*key, block, cls, n, component) in enumerate(zip(*columns, strict=True)):
                if key != group:
                    if len(cell.cls) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cell.links(like)], names=["a", "b"])
                    group, cell = key, _Cell()
                found = flat[ends[k] : ends[k + 1]].copy()
                for held, value in ((cell.sets, found), (cell.bits, folded(found.view(np.uint64)).view(np.uint64)), (cell.block, block), (cell.cls, cls), (cell.n, n), (cell.component, component)):
                    held.append(value)
        if len(cell.cls) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cell.links(like)], names=["a", "b"])

    # Cells are a few numbers a row: where they are few, they go to the sets, and a set is dealt out only once.
    cells = materialize(cells, "cells")
    side = F.broadcast(cells) if cells.count() <= FEW else cells
    placed = sets.join(side, "cls").select("least", "x", "y", "block", "cls", "n", "component", "set")
    placed = placed.repartition(width(members.sparkSession), "least", "x", "y").sortWithinPartitions("least", "x", "y")
    return in_arrow(placed, run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: the size of its set and the smallest id that links reach.

    Linked are sets with ``den`` * common >= ``num`` * all shingles.  A null or blank text has no shingle and is linked
    with nothing; equal texts are linked; a repeated id is one document for each row, all with the same smallest id if
    their texts are linked; a null id is larger than every id.  Other columns are not looked at."""
    like = Likeness(num, den)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = materialize(profiles(docs, words, like), "profiles")
    some = every.filter("n > 0")
    classes = materialize(some.groupBy("cls").agg(F.min("id").alias("id"), F.first("bits").alias("bits")), "classes")
    keyed = entries(some, docs, words, like, frequent(some, like), border(some, like))
    of_list = Window.partitionBy("w")
    met = keyed.repartition("w").distinct().withColumn("hub", F.min(F.struct("cls", "n", "pos")).over(of_list)).withColumn("len", F.count(F.lit(1)).over(of_list))
    met = materialize(met.filter("len > 1").select("w", "cls", "n", "pos", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")), "lists")
    c = F.col
    stars = met.filter((c("cls") != c("hub")) & _may_link(like, c("n"), c("hub_n"), c("pos"), c("hub_pos"))).select(c("hub").alias("a"), c("cls").alias("b"), c("hub_n").alias("na"), c("n").alias("nb")).distinct()
    stars = materialize(stars, "stars")
    links = _links(docs, classes, stars, words, like)
    joined = components(links)

    # What is left to check: members of one list that are not connected yet.
    now = met.select("w", "cls", "n", "pos").join(joined.select(c("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    now = now.withColumn("least", F.min("component").over(of_list)).withColumn("most", F.max("component").over(of_list)).filter("least <> most")
    now = materialize(now.select("w", "cls", "n", "pos", "component", "least"), "apart")
    doubtful = materialize(_doubtful(now.join(classes.select("cls", "bits"), "cls"), like), "doubtful")
    sets = _sets(docs, classes, doubtful.select("cls").distinct(), words)
    links = materialize(links.union(_apart(doubtful, sets, like)), "links")

    # Smallest id of each component, then back to the documents.
    whole = classes.select("cls", "id").join(components(links).select(c("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = whole.groupBy("component").agg(F.min("id").alias("least"))
    of_class = whole.join(smallest, "component").select("cls", "least")
    out = every.select("id", "n", "cls").join(of_class, "cls", "left")
    return out.select(c("id").alias(id_col), c("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
