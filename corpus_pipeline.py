"""From raw documents to token ids: language, quality, near duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return the
columns of documents.  ``run`` writes every stage's rows as Parquet in the shared folder and reads them again, so that a
lost executor costs a stage's task and no stage runs twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.llm import byte_bpe, cotrain, lang_kn, ngram_join, poisson_mix
from evidence_spark.llm.queries import RANKS
from evidence_spark.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: So many ids at most are broadcast; more are joined by a shuffle.
SMALL = 1 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model accepts; those without a letter, and those unlike every language, go."""
    model = lang_kn.fit(docs.select(F.col("doc_id").alias("id"), "lang", "text"))
    return lang_kn.keep_known(docs.select(*COLUMNS), model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers score above their cut."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.keep_good(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked by five-word shingles at a similarity of 0.8: that of the smallest id.

    Rows are told apart by keys of their own, whatever their ids: a null id is larger than every id, and of equal ids one
    row is taken by its text.  Rows without a word are in no group; of those with the same id and text one stays."""
    c = F.col
    # Written, so that a row's key is the same wherever it is read.
    rows = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    groups = ngram_join.near_duplicates(rows, words=5, num=80, id_col="_row")
    worded = c("n_shingles") > 0
    of = materialize(groups.join(rows.select("_row", "doc_id", "_text"), "_row"), "groups")
    group = [F.when(worded, c("component_id")), F.when(~worded, c("doc_id")), F.when(~worded, c("_text")), F.when(~worded & c("doc_id").isNull(), c("_row"))]
    first = of.groupBy(*(g.alias(f"g{k}") for k, g in enumerate(group))).agg(F.min(F.struct(c("doc_id").isNull().alias("none"), "doc_id", "_text", "_row")).alias("first"))
    gone = materialize(of.select("_row").join(first.select(c("first._row").alias("_row")), "_row", "left_anti"), "gone")
    side = F.broadcast(gone) if gone.count() <= SMALL else gone
    return rows.join(side, "_row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by their sources' target weights, in a global random order."""
    return poisson_mix.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again."""
    return byte_bpe.digests(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoding", encoding)]

#: Trained models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
