"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A conversation is the sequence of the hashes of its turns; sorted by it, conversations with a common prefix stand side by
side, and the trie follows from the length of the common prefix (LCP) of each pair of neighbours.  A task takes a stretch
of the sorted rows and joins neighbours in descending LCP: each union makes a branching node or adds to one, and the nodes
between a component and its union are the only ones with one child.  What a stretch shares with its neighbours, the
prefixes of its first and last row up to the LCP with the row beyond, is contracted to one row a depth; these rows are
merged by the prefix's hash.  All other nodes are whole in their stretch.

Sums over subtrees add up over stretches, because a shared node counts its own part where it first appears, and its leaf
where it last appears.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, width
from .common import in_arrow

#: Bytes of a turn's hash.
TURN = 16
#: Rows and turns of a stretch at most.
STRETCH_ROWS = 1 << 14
STRETCH_TURNS = 1 << 18
#: So many shared nodes at most are broadcast; more are joined by a shuffle.
SMALL = 1 << 16
EMPTY = hashlib.sha256().hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, hashes, sizes): the hashes of a conversation's turns one after another, and the bytes of their texts.

    Turns are in order of ``turn_col``, nulls first, equal ones by the MD5 of role and text; a null role or text is an empty
    one; repeated turns are turns like others; rows without a conversation id belong to none.  Texts stay behind: a
    conversation holds 24 bytes a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).isNotNull().alias("t"), F.col(turn_col).cast("long").alias("turn"), said.alias("md5"), F.octet_length(text).cast("long").alias("size")).alias("s"))
    ordered = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("conv", F.unhex(F.array_join("s.md5", "")).alias("hashes"), F.col("s.size").alias("sizes"))


def spliced(rows: DataFrame, base: Column, turns: Column) -> DataFrame:
    """Each conversation with its first ``turns`` turns replaced by those of conversation ``base`` (all it has, if fewer;
    none, if there is no such conversation)."""
    asked = rows.withColumn("base", base).withColumn("h", turns.cast("int"))
    other = rows.select(F.col("conv").alias("base"), F.col("hashes").alias("base_hashes"), F.col("sizes").alias("base_sizes"))
    h = F.col("h")
    none = F.array().cast("array<bigint>")
    hashes = F.concat(
        F.coalesce(F.substring("base_hashes", F.lit(1), h * TURN), F.lit(b"")),
        F.substring("hashes", h * TURN + 1, F.octet_length("hashes")),
    )
    sizes = F.concat(F.coalesce(F.slice("base_sizes", 1, h), none), F.slice("sizes", h + 1, F.size("sizes")))
    return asked.join(other, "base", "left").select("conv", hashes.alias("hashes"), sizes.alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their part, place, and LCP with the row before and the one after; null at the ends of a part."""
    part, place, last, held = TaskContext.get().partitionId(), 0, None, None
    names = ["part", "place", "conv", "hashes", "sizes", "before", "after"]
    for batch in batches:
        if not batch.num_rows:
            continue
        lcp = []
        for x in batch["hashes"]:
            now = x.as_py()
            lcp.append(None if last is None else _common(last, now))
            last = now
        if held:
            yield pa.RecordBatch.from_arrays([*held[:-1], pa.array([*held[-1], lcp[0]], pa.int64())], names=names)
        n = batch.num_rows
        held = [pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), batch["conv"], batch["hashes"], batch["sizes"], pa.array(lcp, pa.int64()), lcp[1:]]
        place += n
    if held:
        yield pa.RecordBatch.from_arrays([*held[:-1], pa.array([*held[-1], None], pa.int64())], names=names)


def _borders(rows: DataFrame) -> DataFrame:
    """(part, before, after): the LCP of each part's first row with the last row before it, and of its last row with the
    first row after it; -1 at both ends of all.  One row a part that holds rows, so few rows in one window."""
    ends = rows.groupBy("part").agg(F.min_by("hashes", "place").alias("first"), F.max_by("hashes", "place").alias("last"), F.max("place").alias("place"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", "place", "first", "last", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last, left, right = (b[c].to_pylist() for c in ("first", "last", "left", "right"))
            before = [-1 if x is None else _common(x, y) for x, y in zip(left, first, strict=True)]
            after = [-1 if y is None else _common(x, y) for x, y in zip(last, right, strict=True)]
            yield pa.RecordBatch.from_arrays([b["part"], b["place"], pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=["part", "last", "before", "after"])

    return in_arrow(ends, run, "part int, last bigint, before bigint, after bigint")


def _stretch(conv: np.ndarray, hashes: list[bytes], sizes: list[np.ndarray], lcp: np.ndarray, before: int, after: int, part: int, place: int) -> list:
    """The rows of all nodes of sorted conversations; ``before`` and ``after`` are the LCPs with the rows around them."""
    # Equal conversations stand together: one leaf each time.
    length = np.array([len(x) for x in sizes])
    new = np.concatenate([[True], (lcp[1:] != length[1:]) | (length[1:] != length[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(conv))
    n = len(head)
    depth, members, parent, first, last = (x.tolist() for x in (length[head], tail - head, np.full(n, -1), np.arange(n), np.arange(n)))
    least = np.minimum.reduceat(conv, head).tolist()
    of, top = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    edge = lcp[head]
    for right in (np.argsort(-edge[1:], kind="stable") + 1).tolist():
        a, b, shared = find(right - 1), find(right), int(edge[right])
        x, y = top[a], top[b]
        if depth[x] > shared:  # a new branching node; the right side's is always deeper, as equal edges go from the left
            depth.append(shared)
            members.append(members[x])
            least.append(least[x])
            parent.append(-1)
            first.append(first[x])
            last.append(last[x])
            parent[x] = x = top[a] = len(depth) - 1
        parent[y] = x
        members[x] += members[y]
        least[x] = min(least[x], least[y])
        last[x] = last[y]
        of[b] = a
    depth, members, parent, first, last, least = (np.array(x, np.int64) for x in (depth, members, parent, first, last, least))

    # Sums below each node; those of a node's own chain, from its depth up to its parent's, come with its rows.
    sums = [np.concatenate([[0], np.cumsum(sizes[i], dtype=np.int64)]) for i in head]
    above = np.where(parent >= 0, depth[parent], -1)
    left, right = first == 0, last == n - 1
    total = lambda x, k: sums[first[x]][k]
    weight, plain, leaves, children = (np.zeros(len(depth), np.int64) for _ in range(4))
    childless = np.ones(len(depth), bool)
    childless[parent[parent >= 0]] = False
    leaves[childless & ~(right & (depth <= after))] = 1
    for x in np.argsort(-depth, kind="stable").tolist():
        up, d = parent[x], int(depth[x])
        if up >= 0:
            low = int(above[x])
            weight[up] += weight[x] + members[x] * (total(x, d) - total(x, low))
            owned = max(low, before) if left[x] else low
            plain[up] += plain[x] + total(x, d) - total(x, min(owned, d))
            leaves[up] += leaves[x]
            children[up] += not (left[x] and low + 1 <= before)

    # One row for each depth of each chain.
    many = depth - above
    node = np.repeat(np.arange(len(depth)), many)
    k = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + above[node] + 1
    start = np.concatenate([[0], np.cumsum([len(x) for x in sums])])
    flat = np.concatenate(sums)
    at = start[first[node]]
    d = depth[node]
    end = flat[at + d]
    w = weight[node] + members[node] * (end - np.where(k > 0, flat[at + np.maximum(k - 1, 0)], 0))
    owned = np.where(left[node], np.maximum(k - 1, np.minimum(before, d)), k - 1)
    b = plain[node] + end - np.where(owned >= 0, flat[at + np.maximum(owned, 0)], 0)
    inner = k < d
    n_children = np.where(inner, ~(left[node] & (k + 1 <= before)), children[node])
    shared = left[node] & (k <= before) | right[node] & (k <= after)
    lowest = k == above[node] + 1
    over = np.where(lowest, parent[node], node)
    over_shared = (k > 0) & (left[over] & (k - 1 <= before) | right[over] & (k - 1 <= after))
    up_conv = np.where(k > 0, least[over], 0)

    def keys(row: bytes, most: int) -> list[bytes]:
        h = hashlib.md5()
        made = [h.digest()]
        for j in range(most):
            h.update(row[j * TURN : (j + 1) * TURN])
            made.append(h.digest())
        return made

    at_left, at_right = keys(hashes[0], max(before, 0)), keys(hashes[-1], max(after, 0))
    key_of = lambda x, j: at_left[j] if left[x] and j <= before else at_right[j]
    key = [key_of(x, j) if s else None for x, j, s in zip(node.tolist(), k.tolist(), shared.tolist(), strict=True)]
    up_key = [key_of(x, j - 1) if s else None for x, j, s in zip(over.tolist(), k.tolist(), over_shared.tolist(), strict=True)]
    ends, held = [], []
    for x, s, i in zip(node.tolist(), shared.tolist(), inner.tolist(), strict=True):
        ids = conv[head[x] : tail[x]] if x < n and not i else None
        held.append(ids if s else None)
        ends.append(None if s else EMPTY if ids is None else hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
    columns = [
        pa.array(k), pa.array(least[node]), pa.array(up_conv, mask=(k == 0) | over_shared), pa.array(up_key, pa.binary()), pa.array(key, pa.binary()), pa.array(members[node]),
        pa.array(n_children.astype(np.int64)), pa.array(leaves[node]), pa.array(w), pa.array(b), pa.array(ends, pa.string()),
        pa.array(held, pa.list_(pa.int64())), pa.array(np.full(len(k), part, np.int32)), pa.array(np.full(len(k), place)),
    ]
    return columns


NODES = (
    "depth bigint, conv_id bigint, parent_conv_id bigint, parent_key binary, key binary, n_convs bigint, n_children bigint, n_leaves bigint, "
    "weight bigint, plain bigint, ends_sha256 string, members array<bigint>, part int, place bigint"
)
NAMES = [x.split()[0] for x in NODES.split(", ")]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the stretches of sorted rows that come in; a stretch ends where rows do not follow on each other."""
    held: list[tuple] = []
    turns = 0

    def flush() -> pa.RecordBatch:
        part, place, conv, hashes, sizes, before, after = zip(*held, strict=True)
        made = _stretch(np.array(conv, np.int64), list(hashes), [np.asarray(x, np.int64) for x in sizes], np.array(before, np.int64), before[0], after[-1], part[0], place[0])
        held.clear()
        return pa.RecordBatch.from_arrays(made, names=NAMES)

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("part", "place", "conv", "hashes", "sizes", "before", "after")), strict=True):
            if held and (row[:2] != (held[-1][0], held[-1][1] + 1) or len(held) >= STRETCH_ROWS or turns >= STRETCH_TURNS):
                yield flush()
                turns = 0
            held.append(row)
            turns += len(row[4])
    if held:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of shared nodes whose members come in order, some at a time."""
    key, digest = None, None
    for batch in batches:
        for k, ids in zip(batch["key"].to_pylist(), batch["members"], strict=True):
            text = ",".join(map(str, ids.as_py())).encode()
            if k == key:
                digest.update(b"," + text)
                continue
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends"])
            key, digest = k, hashlib.sha256(text)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends"])


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of ``rows`` (conv long, hashes, sizes): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Of equal conversations each is a member.  No rows give no nodes, not even the root."""
    c = F.col
    n = width(rows.sparkSession)
    placed = rows.repartitionByRange(n, "hashes", "conv").sortWithinPartitions("hashes", "conv").select("conv", "hashes", "sizes")
    placed = materialize(in_arrow(placed, _with_lcp, "part int, place bigint, conv bigint, hashes binary, sizes array<bigint>, before bigint, after bigint"), "sorted")
    # One row a part: as many as there are partitions.
    borders = F.broadcast(_borders(placed).select("part", "last", c("before").alias("b"), c("after").alias("a")))
    placed = placed.join(borders, "part")
    before, after = F.when(c("place") == 0, c("b")).otherwise(c("before")), F.when(c("place") == c("last"), c("a")).otherwise(c("after"))
    placed = placed.select("part", "place", "conv", "hashes", "sizes", before.alias("before"), after.alias("after"))
    nodes = materialize(in_arrow(placed, _forests, NODES), "forest")

    sums = [F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "weight", "plain")]
    shared = nodes.filter("key IS NOT NULL").groupBy("key").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *sums)
    shared = materialize(shared, "shared")
    members = nodes.filter("key IS NOT NULL AND members IS NOT NULL").select("key", "part", "place", "members")
    digests = in_arrow(members.repartition(n, "key").sortWithinPartitions("key", "part", "place"), _digests, "key binary, ends string")
    parents = shared.select(c("key").alias("parent_key"), c("conv_id").alias("up"))
    if shared.count() <= SMALL:
        parents = F.broadcast(parents)
    saved = (c("weight") - c("plain")).alias("saved_tokens")
    whole = nodes.filter("key IS NULL").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    merged = shared.join(parents, "parent_key", "left").join(digests, "key", "left").withColumn("parent_conv_id", c("up")).withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, "ends_sha256"]
    return whole.select(*columns).unionByName(merged.select(*columns))


# ``crc32`` by the table of its polynomial, over the digits of an id.
ORACLE = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(i))),
own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h FROM own, tab),
built AS (SELECT own.c, list_concat(coalesce(base.l[1:h], []), own.l[h + 1:]) AS l
  FROM own JOIN h USING (c) LEFT JOIN own AS base ON base.c = own.c - own.c % 5),
nodes AS (SELECT c, d, l[1:d] AS p, l[d] AS last, d = len(l) AS at_end FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
g AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(strlen(last.t)), 0) AS bytes,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE at_end), '') AS ends FROM nodes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
full_g AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (d, p)),
sub AS (SELECT k AS d, p[1:k] AS p, sum((n_convs - 1) * bytes) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_g) GROUP BY ALL)
SELECT g.conv_id, g.d AS depth, up.conv_id AS parent_conv_id, g.n_convs, g.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM full_g AS g JOIN sub USING (d, p) LEFT JOIN g AS up ON up.d = g.d - 1 AND up.p = g.p[1:g.d - 1]
"""
