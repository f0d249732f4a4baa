"""The shared frontier loop: join, drop what is known, write, repeat.

Each round's frontier is a written table, so lineage stays flat and a lost executor costs one round.  ``known`` is the
union of the written frontiers and is written anew as one table now and then, so that reading it stays in proportion.
The loop ends when nothing is new; a limit on rounds is the caller's choice, and running into it is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame

from ..session import materialize


#: So many written rounds are put together as one table.
COMPACT = 16


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def frontier_loop(
    start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: Sequence[str], max_rounds: int | None = None,
    label: str = "frontier", limit: int | None = None,
) -> DataFrame:
    """All rows reachable from ``start``; ``step(frontier, round)`` yields new rows, known ``keys`` are dropped.

    With ``limit`` the loop stops after that many rounds by definition of the operator.
    """
    keys = list(keys)
    frontier = materialize(start.dropDuplicates(keys), label)
    parts = [frontier]
    for rnd in count(1):
        if limit is not None and rnd > limit:
            return union_all(parts)
        new = step(frontier, rnd)
        frontier = materialize(new.join(union_all(parts).select(*keys), keys, "left_anti"), label)
        if frontier.isEmpty():
            return union_all(parts)
        if max_rounds is not None and rnd > max_rounds:
            raise RuntimeError(f"{label}: more than {max_rounds} rounds needed")
        parts.append(frontier)
        if len(parts) >= COMPACT:
            parts = [materialize(union_all(parts), label)]

