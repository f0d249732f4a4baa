"""Running aggregates over ordered keys that do not put one key into one task.

A window partitioned by key alone sends every row of a hot key to a single task.  Here the rows of a key are cut
into blocks of its order column; each block is scanned on its own, block totals (one row each) are scanned per key,
and the carry is joined back.  All supported folds are associative, so the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


_FOLDS = {
    "sum": (F.sum, lambda carry, here: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, True), lambda carry, here: F.coalesce(here, carry)),
    "first": (lambda c: F.first(c, True), lambda carry, here: F.coalesce(carry, here)),
}


def prefix_scan(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], folds: Mapping[str, tuple[str, Column]], *,
    strict: bool = False, block: int = BLOCK, keep_block: bool = False,
) -> DataFrame:
    """Adds one column per fold: kind ("sum", "min", "max", "last", "first") of a column over all rows of the key
    up to this one.  With ``strict``, or for a kind written "last<", the row itself does not count.

    ``order`` names integer columns, unique within the key; the first one is cut into blocks of ``block`` units.  With
    ``keep_block`` the block column stays, so that a following scan reuses the same partitioning without a shuffle.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    at = F.struct(*order)
    cols = [c for c in df.columns if c != "_block"]
    rows = df if "_block" in df.columns else df.withColumn("_block", F.floor(F.col(order[0]) / block))
    part = [*keys, "_block"]
    here = Window.partitionBy(*part).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    plan = {name: (kind.rstrip("<"), value, strict or kind.endswith("<")) for name, (kind, value) in folds.items()}

    rows = rows.select("*", *[value.alias(f"_v_{name}") for name, (_, value, _) in plan.items()])
    inside, totals, carries, finals = [], [], [], []
    for name, (kind, _, open_end) in plan.items():
        fold, combine = _FOLDS[kind]
        v = F.col(f"_v_{name}")
        inside.append(fold(v).over(here.rowsBetween(Window.unboundedPreceding, -1 if open_end else 0)).alias(f"_h_{name}"))
        # The total of a block; for last and first the order decides.
        if kind in ("last", "first"):
            pick = F.max_by if kind == "last" else F.min_by
            totals.append(pick(F.when(v.isNotNull(), v), F.when(v.isNotNull(), at)).alias(f"_t_{name}"))
        else:
            totals.append(fold(v).alias(f"_t_{name}"))
        carries.append(fold(F.col(f"_t_{name}")).over(before).alias(f"_c_{name}"))
        finals.append(combine(F.col(f"_c_{name}"), F.col(f"_h_{name}")).alias(name))
    carry = rows.groupBy(*part).agg(*totals).select(*part, *carries)
    joined = rows.select(*cols, "_block", *inside).join(carry, part)
    return joined.select(*cols, *(["_block"] if keep_block else []), *finals)


def ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the 1-based position of each row within its key."""
    return prefix_scan(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, block=block)
