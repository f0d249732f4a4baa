"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, grouped under their frequent form.

Words that differ by one letter share their first half or their last half, so a word meets only the words of its cells:
one for each half, for its own length and for that below.  Inside a cell the words are numbered, 64 to an integer, and a
position index holds for each (position, letter) the bits of the words with that letter there.  A word is read against
the index letter by letter: a recurrence of word-parallel operations keeps the set without an error and, by positions
shifted to either side, the sets with one.  Cells that hold more than a tile of words are dealt out as pairs of tiles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread, width
from .common import in_arrow

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs so many times as often as its variant at least.
RATIO = 10
#: Words of a tile of a large cell; a task holds two tiles at once.
TILE = 1 << 15
#: Rows and index bytes that a task handles at once, beyond which it ends at the next cell.
CHUNK_ROWS = 1 << 15
CHUNK_BYTES = 32 << 20
PAIRS = 1 << 17
DISTINCT_WORDS = 1 << 17

# Letters of words.
RUN = "[A-Za-zÀ-ÿ]"
LETTERS = 26 + 64


def _lower(text: str) -> str:
    """A to Z as a to z and nothing else."""
    return text.encode().lower().decode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, slip: int = 0) -> DataFrame:
    """(word, n): how often each run of letters of at least ``least`` code points occurs in all texts, A-Z lower-cased.

    With ``slip`` above 0, where it divides h, the crc32 of "<id>:<run>", the run loses its code point h % length first: made
    misspellings.  A null text has no words; a null id is written as nothing."""
    letters = re.compile(f"{RUN}{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(letters.findall(_lower(text.as_py() or "")))
                start = zlib.crc32(f"{key or ''}:".encode())
                for word, n in found.items():
                    if slip and (h := zlib.crc32(word.encode(), start)) % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) >= DISTINCT_WORDS:
                    yield flush()
        yield flush()

    rows = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")))
    return in_arrow(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---- the index


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length, letters of all words one after another as numbers below LETTERS)."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    # Letters above z are the two bytes 0xc3, x: one byte of each letter is not 0xc3.
    one = raw != 0xC3
    length = np.diff(np.concatenate([[0], np.cumsum(one)])[at - at[0]])
    code = raw[one].astype(np.int64)
    return length, np.where(code < 128, code - 97, code - 128 + 26)


def half(length):
    """Letters of the first half; the last half has the rest."""
    return (length + 1) // 2


class PositionIndex:
    """Bits of words of lengths ``a`` and ``a`` + 1 by position and letter, 64 words to a block."""

    def __init__(self, letters: np.ndarray, length: np.ndarray, a: int):
        n = len(length)
        self.a, self.row = a, (a + 1) * LETTERS
        blocks = -(-n // 64)
        self.bits = np.zeros(blocks * self.row, np.uint64)
        self.short, self.long = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64)
        number = np.arange(n)
        bit = np.uint64(1) << (number & 63).astype(np.uint64)
        for j in range(a + 1):
            has = np.flatnonzero(length > j)
            np.bitwise_or.at(self.bits, (has >> 6) * self.row + j * LETTERS + letters[has, j], bit[has])
        np.bitwise_or.at(self.short, number[length == a] >> 6, bit[length == a])
        np.bitwise_or.at(self.long, number[length > a] >> 6, bit[length > a])

    def near(self, letters: np.ndarray, longer: bool, block: np.ndarray, mask: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """The bits of the words of ``block`` that are near each word, for words of ``a`` letters or all of ``a`` + 1.

        Words of ``a`` + 1 find those of ``a`` only; a pair of ``a`` + 1 belongs to the next length.  Where ``suffix``
        is set, words with the same first half are left to its cell."""
        base, a = block * self.row, self.a
        exact, replaced, inserted, deleted = mask.copy(), np.zeros_like(mask), np.zeros_like(mask), np.zeros_like(mask)
        apart = np.full_like(mask, ~np.uint64(0))
        for j in range(letters.shape[1]):
            at = base + letters[:, j]
            here = self.bits[at + j * LETTERS]
            if longer:
                deleted = exact | (deleted & self.bits[at + (j - 1) * LETTERS] if j else np.uint64(0))
            else:
                replaced = replaced & here | exact & ~here
                inserted = (inserted | exact) & self.bits[at + (j + 1) * LETTERS]
            exact &= here
            if j + 1 == half(a):
                apart = np.where(suffix, ~exact, apart)
        found = deleted & self.short[block] if longer else replaced & self.short[block] | (inserted | exact) & self.long[block]
        return found & apart


def _near_in_chunk(a: int, chunk: pa.Table) -> list:
    """Columns word, n_near, best_n, best of the words of whole cells of one length that have near words there."""
    words, n = chunk["word"].combine_chunks(), np.asarray(chunk["n"])
    cell = chunk["cell"].combine_chunks()
    role, suffix = np.asarray(chunk["role"]), np.asarray(chunk["suffix"]).astype(bool)
    new = np.concatenate([[True], np.asarray(pc.not_equal(cell.slice(1), cell.slice(0, len(cell) - 1)))])
    group = np.cumsum(new) - 1
    length, flat = _letters(words)
    letters = np.zeros((len(words), a + 1), np.int64)
    letters[np.arange(a + 1) < length[:, None]] = flat
    held = np.flatnonzero(role & 2)
    index = PositionIndex(letters[held], length[held], a)
    ends = np.cumsum(np.bincount(group[held], minlength=group[-1] + 1))
    starts = np.concatenate([[0], ends[:-1]])
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for longer in (False, True):
        asks = np.flatnonzero((role & 1 > 0) & (length == a + longer) & (ends > starts)[group])
        start, end = starts[group[asks]], ends[group[asks]]
        reach = np.cumsum((end - 1 >> 6) - (start >> 6) + 1)
        for low in range(0, int(reach[-1]) if len(reach) else 0, PAIRS):
            each = np.arange(low, min(low + PAIRS, int(reach[-1])))
            k = np.searchsorted(reach, each, "right")
            block = (end[k] - 1 >> 6) - (reach[k] - 1 - each)
            below, above = start[k] - block * 64, end[k] - block * 64
            mask = ~np.uint64(0) << np.maximum(below, 0).astype(np.uint64) & ~np.uint64(0) >> np.maximum(64 - above, 0).astype(np.uint64)
            q = asks[k]
            bits = index.near(letters[q, : a + longer], longer, block, mask, suffix[q])
            np.add.at(count, q, np.bitwise_count(bits))
            some = np.flatnonzero(bits)
            # Words of a cell are in order of their count, so the first bit is the best one.
            first = held[block[some] * 64 + np.bitwise_count((bits[some] & -bits[some]) - np.uint64(1))]
            q, at = np.unique(q[some], return_index=True)
            best[q] = np.where(best[q] < 0, first[at], best[q])
    found = np.flatnonzero(count)
    return [words.take(pa.array(found)), pa.array(count[found]), pa.array(n[best[found]]), words.take(pa.array(best[found]))]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = np.asarray(table["a"])
        borders = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
        for low, high in zip(borders, borders[1:]):
            if high > low:
                made = _near_in_chunk(int(kinds[low]), table.slice(low, high - low))
                yield pa.RecordBatch.from_arrays(made, names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        longest = int(batch["a"][-1].as_py()) if batch.num_rows else 0
        if rows >= min(CHUNK_ROWS, max(64 * CHUNK_BYTES // (8 * LETTERS * (longest + 1)), 1)):
            table = pa.Table.from_batches(held)
            cell = table["cell"].combine_chunks()
            cuts = np.flatnonzero(np.asarray(pc.not_equal(cell.slice(1), cell.slice(0, len(cell) - 1))))
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield from flush(table.slice(0, cut))
                table = table.slice(cut)
                held = table.combine_chunks().to_batches()
                rows = table.num_rows
    if rows:
        yield from flush(pa.Table.from_batches(held))


def _cells(words: DataFrame, least: int) -> DataFrame:
    """(a, suffix, key, word, n): each word in the cells of its halves, for its own length and for the one below."""
    length = F.char_length("word")
    a = F.explode(F.filter(F.array(length, length - 1), lambda x: x >= least)).alias("a")
    each = words.select("word", "n", a).select("word", "n", "a", F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"))
    first = F.floor((F.col("a") + 1) / 2).cast("int")
    key = F.when(F.col("suffix"), F.expr("right(word, int(a / 2))")).otherwise(F.substring("word", F.lit(1), first))
    return each.select("a", "suffix", key.alias("key"), "word", "n")


def near_words(words: DataFrame, least: int = LEAST_LENGTH, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of each word of ``words`` (distinct word, n; at least ``least`` letters) that has near
    words: how many, and the one of largest n, of equal ones the smallest."""
    cells = _cells(words, least)
    sizes = cells.groupBy("a", "suffix", "key").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.filter(F.col("size") > tile).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).drop("size")
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("word"), tiles).cast("int")
    # A word asks as a row of pairs of tiles and is held as a column of them; where both are its own it is one row.
    asks = F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(own.alias("x"), j.alias("y"), F.when(j == own, 3).otherwise(1).alias("role")))
    holds = F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(j.alias("x"), own.alias("y"), F.lit(2).alias("role")))
    roles = F.explode(F.concat(asks, F.filter(holds, lambda h: h["x"] != own))).alias("t")
    dealt = cells.join(large, ["a", "suffix", "key"], "left").select("a", "suffix", "key", "word", "n", roles)
    cell: Column = F.concat_ws(" ", F.col("suffix").cast("string"), "key", F.col("t.x").cast("string"), F.col("t.y").cast("string"))
    dealt = dealt.select("a", "suffix", cell.alias("cell"), "word", "n", F.col("t.role").alias("role"))
    dealt = dealt.repartition(width(words.sparkSession), "a", "cell").sortWithinPartitions("a", "cell", F.desc("n"), "word")
    found = in_arrow(dealt, _search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by pointer jumping; chains have no circle."""
    links = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "forms")
    while True:
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        links = materialize(step, "forms")
        if links.filter("open").isEmpty():
            return links.drop("open")


def variants(counts: DataFrame, least: int = LEAST_LENGTH, occurrences: int = LEAST_COUNT, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``counts`` (word, n) with at least ``least`` letters and
    ``occurrences``.

    ``form`` is the near word of largest n (of equal ones the smallest), if it occurs at least ``ratio`` times as often as
    the word; ``root`` is the last form of the chain, the word itself if it has none.  No words give no rows."""
    words = counts.filter((F.char_length("word") >= least) & (F.col("n") >= occurrences))
    words = materialize(words.select("word", "n"), "words")
    frequent = F.col("best_n") >= ratio * F.col("n")
    near = words.join(near_words(words, least, tile), "word", "left")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"))
    near = materialize(near, "near")
    ends = roots(near.filter("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# ``crc32`` by the table of its polynomial, over the UTF-8 bytes of "<id>:<run>"; each run is taken once a document.
ORACLE = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
said AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM less AS a JOIN w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM less AS a JOIN w ON w.word = a.rest),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM pairs GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM w LEFT JOIN near USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN chain USING (word)
"""
