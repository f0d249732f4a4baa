"""Fingerprints of documents from the phrases of a Lempel-Ziv parse.

A text is cut from left to right into phrases, each the shortest stretch that is not yet in the dictionary, which it
then joins.  Texts that compress well against each other share phrases.  The set of phrase hashes is reduced to a
signature by one-permutation minimum hashing: the hashes fall into bins by their top bits, a bin keeps its smallest,
and an empty bin takes the value of the next full one.  The share of equal bins estimates the overlap of phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

BIN_BITS = 7
BINS = 1 << BIN_BITS
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the hash base, grown as longer texts come."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(_BASE, max(n, 1 << 17)), powers(_BASE_INVERSE, max(n, 1 << 17))
        return cls.up[:n], cls.down[:n]


def parse(text: str, known: set[str], phrase: str) -> tuple[list[int], str]:
    """Lengths of the phrases that ``text`` adds to ``known``, and the unfinished phrase at its end; ``phrase`` is the
    unfinished one before it."""
    lengths = []
    put, add = lengths.append, known.add
    for character in text:
        phrase += character
        if phrase not in known:
            add(phrase)
            put(len(phrase))
            phrase = ""
    return lengths, phrase


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signature(text: str, lengths: list[int]) -> str:
    """16 bits of the smallest phrase hash of each bin, as hexadecimal digits; empty if there is no phrase."""
    if not lengths:
        return ""
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    codes = np.frombuffer(text[:n].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    up, down = Powers.upto(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = np.sort(mix((sums[ends] - sums[starts]) * down[starts] + np.array(lengths, np.uint64)))
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    nearest = np.searchsorted(full, np.arange(BINS)) % len(full)
    return (hashes[first[nearest]] & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    return signature(text, parse(text, set(), "")[0])


def likeness(a: str, b: str) -> float:
    """Share of equal bins, 0 to 1; two empty fingerprints are alike, an empty one is like no other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def both(text: str, following: str) -> tuple[str, str, str]:
    """Fingerprint of ``text``, its edited text, and that one's fingerprint; the common start is parsed once."""
    half = len(text) // 2
    head, own, other = text[: len(text) - half], text[len(text) - half :], following[:half]
    known: set[str] = set()
    lengths, phrase = parse(head, known, "")
    more, _ = parse(own, set(known), phrase)
    others, _ = parse(other, known, phrase)
    edited = head + other
    return signature(text, lengths + more), edited, signature(edited, lengths + others)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, tail, id, text): ranges of descending ids, each followed by the first row of the next range as its tail.

    Ranges hold about equally many rows; their borders are all that the driver sees, as many as partitions.  One shuffle
    moves the texts.  Rows with equal ids are ordered by text, null ids come last."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in docs.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)}, reverse=True)
    # Cuts at or above an id: none for the largest ids; null has a range of its own at the end.
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("id"))) if cuts else F.lit(0)
    docs = docs.withColumn("part", F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(above))
    # The first id of each range goes to the range before it too, and that of the first range to the last.
    firsts = sorted((r.part, r.id) for r in docs.groupBy("part").agg(F.max("id").alias("id")).collect())
    goes = spark.createDataFrame([(p, first, firsts[i - 1][0]) for i, (p, first) in enumerate(firsts)], "at int, first long, part int")
    ends = docs.filter(F.col("id").isNull() | F.col("id").isin([first for _, first in firsts if first is not None])).withColumnRenamed("part", "at")
    ends = ends.join(F.broadcast(goes), "at").filter(F.col("id").eqNullSafe(F.col("first")))
    rows = docs.select("part", F.lit(False).alias("tail"), "id", "text").union(ends.select("part", F.lit(True), "id", "text"))
    return rows.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("id"), "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, in which the last half (rounded down) of the characters
    is replaced by the first as many of the next document in descending id order, and the likeness to both.

    A null or empty text has no phrase, so its fingerprint is empty.  Repeated rows follow each other; a row alone is
    its own next.  Other columns are not looked at."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row whose next is still to come
        made = None  # what is known of the row before that one, until its next has a fingerprint
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for part, tail, doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    if before and before[0] == part and not before[1]:
                        own, edited, other = both(before[3], text)
                        if made:
                            out.append((*made, likeness(made[3], own)))
                        made = (before[2], len(before[3]), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other))
                        if tail:
                            out.append((*made, likeness(own, fingerprint(text))))
                            made = None
                    before = (part, tail, doc, text)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_arrow(with_next(df, id_col, text_col), run, schema).withColumnRenamed("id", id_col)
