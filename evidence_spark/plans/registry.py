"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(self.path(name))
        return spread(df) if name in ("documents", "pages", "conversations") else df

    def lines(self, min_len: int = 1) -> DataFrame:
        """Example phrases: the lines of each document that are not empty, (source, doc_id, ord, phrase)."""
        return self.documents.select(
            "source", "doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "phrase")
        ).filter(F.length("phrase") >= min_len)

    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("question"))

    def user_turns(self) -> DataFrame:
        return self.conversations.filter("role = 'user'").select("conv_id", "turn", "text")


# The same views in SQL, for use in WITH clauses.
LINES_SQL = """lines AS (
  SELECT source, doc_id, ord - 1 AS ord, phrase FROM (
    SELECT source, doc_id, unnest(string_split(text, chr(10))) AS phrase,
           generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)
  WHERE length(phrase) >= 1)"""

WS_SQL = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def grams_sql(name: str, relation: str, keys: str, text: str) -> str:
    """CTE ``name``(keys, gram, n): gram counts as in functions.text.char_grams."""
    marked = (
        "chr(2) || regexp_replace(trim(regexp_replace(" + text + r", '\d+(?:\.\d+)?', '§', 'g')), "
        r"'[^\p{L}\p{N}]+', chr(3) || chr(2), 'g') || chr(3)"
    )
    return f"""{name}_t AS (SELECT {keys}, {marked} AS t FROM {relation}),
{name} AS (SELECT {keys}, substr(t, i, k) AS gram, count(*) AS n
  FROM (SELECT {keys}, t, k, unnest(range(1, length(t) - k + 2)) AS i
        FROM {name}_t CROSS JOIN (VALUES (2), (3), (4)) AS s(k)) GROUP BY ALL)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL twin if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
