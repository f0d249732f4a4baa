"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..session import materialize

# The white space of Unicode, as the tokenizer libraries take it.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A run of letters up to punctuation, or any run of one kind of white space or none: the split patterns of byte-level
#: tokenizers cut at all of these borders too, whatever stands around them.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
UNIT = re.compile(
    f" ?[{LETTERS}]++(?=[!-/:-@\\[-`{{-~{WHITE_SPACE}]|$)"
    f"| ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)

CACHED_UNITS = 200_000
CACHED_LENGTH = 48


def arrow_type(name: str) -> pa.DataType:
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
        "array<float>": pa.list_(pa.float32()),
    }[name]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of the session, once."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        handle, path = tempfile.mkstemp(prefix="evidence_spark-", suffix=".zip")
        with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)


#: Rows of an Arrow batch at most: with long texts the default holds far more than a task needs at once.
BATCH_ROWS = 1000
_CACHES: list[weakref.ref[UnitCache]] = []
_KEPT: list[Callable] = []
_OWNER = [""]


def kept(make: Callable) -> Callable:
    """``functools.cache`` for what a worker needs for one stage only, such as a tokenizer's tables: the next stage of another
    operator lets it go."""
    made = cache(make)
    _KEPT.append(made)
    return made


def claim(owner: str) -> None:
    """Workers serve one stage after another: what another operator has cached in this one is let go."""
    if _OWNER[0] != owner:
        for made in _KEPT:
            made.cache_clear()
        _CACHES[:] = [ref for ref in _CACHES if ref() is not None]
        for ref in _CACHES:
            if (cached := ref()) is not None:
                cached.clear()
                cached.old = {}
        _OWNER[0] = owner
        give_back()


def give_back() -> None:
    """Hands freed memory back to the system: a worker lives through many stages, and its allocators keep what was free."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def keep_where(df: DataFrame, columns: tuple[Column, ...], good: Callable[[list[list]], np.ndarray], rows: int) -> DataFrame:
    """The rows of ``df`` for which ``good``, called with lists of ``columns`` of at most ``rows`` rows, is true.

    Only the columns asked for go to Python and only the answers come back, so no other column and no text is copied on
    its way through a worker."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    owner = good.__module__

    def ask(*parts: pa.Array) -> pa.Array:
        claim(owner)
        out = [good([c.slice(at, rows).to_pylist() for c in parts]) for at in range(0, len(parts[0]), rows)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool), pa.bool_())

    return df.filter(arrow_udf(ask, "boolean", ArrowUDFType.SCALAR)(*columns))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, for as long as the session lives: plans are lazy, so the setting must
    still hold when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with the modules that ``run`` refers to at hand on every executor, in small batches."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    owner = run.__module__

    def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        yield from run(batches)
        give_back()

    return df.mapInArrow(claimed, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str, rows: int = 0) -> DataFrame:
    """Arrow batches through ``fn``, which returns one list or array for each column of ``schema``.

    ``rows`` above 0 cuts the batches that Spark hands over, so that what ``fn`` makes of one stays small."""
    fields = [part.strip().split(" ", 1) for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [arrow_type(kind) for _, kind in fields]
        names = [name for name, _ in fields]
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
                columns = fn(batch.slice(at, rows or batch.num_rows))
                made = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return in_arrow(df, run, schema)


class UnitCache(dict):
    """Results for short units of text that come again and again.

    When it is full it starts anew and keeps what it had for one more round, from which what is asked for comes back."""

    def __init__(self, make: Callable[[str], object], most: int = CACHED_UNITS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}
        _CACHES.append(weakref.ref(self))

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= CACHED_LENGTH:
            self.put(unit, value)
        return value

    def put(self, unit: str, value: object) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = value


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (id, component), component = smallest id; only linked ids appear.

    Every round takes the smallest label among a vertex and its neighbours, then the label of that label, so long
    chains shrink by powers; rounds go on until no label changes.  Each round is a written table: no lineage grows and
    a lost executor costs one round.  No edge, label or component reaches the driver, only the count of changes.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = materialize(both.union(both.select("v", "u")).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v")
        best = near.groupBy("u").agg(F.min("near").alias("near")).join(labels, "u")
        best = best.select("u", "label", F.least("near", "label").alias("best"))
        jump = labels.select(F.col("u").alias("best"), F.col("label").alias("far"))
        step = best.join(jump, "best", "left").select("u", "label", F.least("best", "far").alias("next"))
        step = materialize(step, "labels")
        if step.filter("next <> label").isEmpty():
            return step.select(F.col("u").alias("id"), F.col("next").alias("component"))
        labels = step.select("u", F.col("next").alias("label"))
