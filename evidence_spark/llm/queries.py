"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import byte_bpe, chat_collapse, cotrain, embed_forest, fm_index, lang_kn, lz_fingerprint, ngram_join, packed_ids, piece_count, poisson_mix, prefix_trie, spelling

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"), words=4, num=85)


@query
def op2_embed_forest(spark: SparkSession, folder: str) -> DataFrame:
    return embed_forest.near_vectors(table(spark, folder, "embeddings"))


@query
def op3_chat_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return chat_collapse.chat_texts(table(spark, folder, "conversations"))


@query
def op4_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return poisson_mix.mix(table(spark, folder, "documents"))


ORACLES["op3_chat_collapse"] = chat_collapse.ORACLE
ORACLES["op4_poisson_mix"] = poisson_mix.oracle(columns="doc_id, text, lang, source, n_chars")


@query
def op5_lang_kn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = docs.filter(~lang_kn.is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "lang", "text")
    found = lang_kn.predict(docs, lang_kn.fit(learn))
    return found.select("doc_id", lang_kn.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query
def op6_lz_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return lz_fingerprint.fingerprints(table(spark, folder, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.round_trip(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN))


@query
def op8_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    return packed_ids.packed_ids(spark, table(spark, folder, "documents"), JSON)


@query
def op9_cotrain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, folder, "labels")))


@query
def op10_piece_count(spark: SparkSession, folder: str) -> DataFrame:
    return piece_count.token_counts(table(spark, folder, "documents"), PIECES)


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(prefix_trie.sequences(table(spark, folder, "conversations")), "conversations")
    mixed = prefix_trie.spliced(rows, F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9)
    return prefix_trie.trie(mixed)


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE


@query
def op12_fm_decontam(spark: SparkSession, folder: str) -> DataFrame:
    found = fm_index.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op12_fm_decontam"] = fm_index.ORACLE


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), slip=31))


ORACLES["op13_spelling"] = spelling.ORACLE
