"""Mixing sources to target weights by Poisson replication.

A source that is to have a share of the mixture gets a mean number of copies for each of its documents.  Each document
draws its own number from a Poisson distribution of that mean, by inverting the distribution at a uniform number that is
a hash of its id and the seed, so a draw needs no state, can run again anywhere, and stays the same when other
documents come or go.  The copies are then put into a global order by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: So many sources at most are broadcast; more are joined by a shuffle.
SMALL = 10_000


def uniform(seed: int, *columns: Column) -> Column:
    """A number between 0 and 1 from 52 bits of a hash of the seed and the columns."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def steps(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2 ..., as far as doubles tell it from 1.

    Summed from logarithms of the single probabilities, so that large rates don't underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def add(so_far: Column, k: Column) -> Column:
        log = so_far["log"] + F.log(rate / k)
        total = so_far["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(so_far["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add)["all"]


def rates(df: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float, source_col: str) -> DataFrame:
    """(source, rate, steps): mean copies of a document of each source, from counts over all documents.

    A source has its weight of ``weights`` (0 if absent there), or by default its count to the power ``temperature``; the
    expected size of the mixture is ``epochs`` times the documents.  A null source is a source of its own."""
    counts = df.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(temperature))
    else:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(given[F.coalesce("source", F.lit(""))].cast("double"), F.lit(0.0))
    counts = counts.withColumn("w", weight)
    total = counts.agg(F.sum("n").alias("docs"), F.sum("w").alias("weights"))
    share = counts.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.col("weights") > 0, F.col("docs") * epochs * F.col("w") / F.col("weights") / F.col("n")).otherwise(0.0)
    return share.select("source", rate.alias("rate")).filter("rate > 0").withColumn("steps", steps(F.col("rate")))


def mix(df: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``df`` with ``copy`` (1, 2 ...) and ``shuffle_key``, in ascending order of that key.

    Rows with equal ids draw the same number; null ids count as one id.  A source without weight goes; an empty table
    gives no rows.  The names ``copy`` and ``shuffle_key`` may not be columns of ``df``."""
    if clash := {"copy", "shuffle_key"} & set(df.columns):
        raise ValueError(f"columns in use: {sorted(clash)}")
    found = materialize(rates(df, weights, temperature, epochs, source_col), "rates").withColumnsRenamed({"source": "_source", "rate": "_rate", "steps": "_steps"})
    side = F.broadcast(found) if found.count() <= SMALL else found
    drawn = df.join(side, F.col(source_col).eqNullSafe(F.col("_source")))
    u = uniform(seed, F.col(id_col))
    # The smallest k whose step is above u: as many steps as are not.
    n = F.size(F.filter("_steps", lambda c: c <= u))
    copies = drawn.withColumn("_n", n).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = F.md5(F.concat_ws("/", F.lit(f"order {seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return copies.select(*(F.col(f"`{c}`") for c in df.columns), F.col("copy").cast("long").alias("copy"), key.alias("shuffle_key")).orderBy("shuffle_key")


def oracle(table: str = "documents", temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, columns: str = "d.*") -> str:
    """The same rows in DuckDB."""
    return f"""
WITH counts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, pow(count(*), {temperature}) AS w FROM {table} GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts) * {epochs} * w / (SELECT sum(w) FROM counts) / n AS rate FROM counts),
logs AS (SELECT source, k, -rate + coalesce(sum(CASE WHEN k > 0 THEN ln(rate / k) END) OVER (PARTITION BY source ORDER BY k), 0) AS log
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM rates)),
steps AS (SELECT source, sum(exp(log)) OVER (PARTITION BY source ORDER BY k) AS step FROM logs),
lists AS (SELECT source, list(step ORDER BY step) AS l FROM steps GROUP BY source),
drawn AS (SELECT d.*, len([s for s in l if s <= (CAST('0x' || substr(md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0]) AS copies
  FROM {table} AS d JOIN lists ON d.source IS NOT DISTINCT FROM lists.source)
SELECT {columns}, copy, md5('order {seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || copy) AS shuffle_key
FROM (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy FROM drawn) AS d
"""
