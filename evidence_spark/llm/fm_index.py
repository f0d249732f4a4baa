"""Benchmark decontamination with an FM-index for each shard of the training documents.

The words of a benchmark's windows are its alphabet; any other word of a document ends a run of symbols, and runs that
are shorter than every window cannot hold one.  A task gathers the runs of its whole documents into shards, sorts the
suffixes of a shard by prefix doubling, stores the Burrows-Wheeler transform in a wavelet matrix and searches all
windows backwards at once.  Rows of a found interval walk back to the next sampled suffix, which gives the place.  The
windows' places in a document are merged to spans.  A document never leaves its task, so nothing is shuffled.

Words are compared as 64-bit hashes (a table of random numbers for each place and byte).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from .common import in_arrow

WINDOW = 10
#: Pairs of window and item that one pass over the documents searches: 80 bytes of hashes each are sent to the tasks.
#: A larger benchmark takes more passes.
PASS_WINDOWS = 1 << 17
#: Symbols of one shard at least, if a task has so many; documents are not split between shards.
SHARD_SYMBOLS = 1 << 20
SHARD_DOCS = 1 << 17
SAMPLE = 8
PIECE = 4 << 20
WALK = 1 << 18
SPAN = ("word", "word_end", "first", "after")
SPANS = "array<struct<" + ", ".join(f"{name}: bigint" for name in SPAN) + ">>"

# Bytes of words, A to Z as a to z; every other byte below 0x80 separates words.
LOWER = np.zeros(256, np.uint8)
LOWER[48:58] = np.arange(48, 58)
LOWER[97:123] = np.arange(97, 123)
LOWER[65:91] = np.arange(97, 123)
LOWER[128:] = np.arange(128, 256)

_PLACES = 64
_NOISE = np.random.default_rng(20260412).integers(0, 1 << 64, _PLACES * 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, hash, first byte, byte after) of all words of a string column in order, in pieces of some megabytes that
    end between words."""
    offsets, raw = _text_buffers(column)
    start = 0
    while start < len(raw):
        stop, size = min(start + PIECE, len(raw)), PIECE
        while stop < len(raw):
            gaps = np.flatnonzero(LOWER[raw[start:stop]] == 0)
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
                break
            size *= 2
            stop = min(start + size, len(raw))
        low = LOWER[raw[start:stop]]
        inside = low > 0
        border = np.zeros(len(low) + 1, bool)
        border[[0, -1]] = True
        border[offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, "right")] - start] = True
        padded = np.concatenate([[False], inside, [False]])
        first = np.flatnonzero(inside & (~padded[:-2] | border[:-1]))
        after = np.flatnonzero(inside & (~padded[2:] | border[1:])) + 1
        if len(first):
            lengths = after - first
            flat = np.flatnonzero(inside)
            place = flat - np.repeat(first, lengths)
            value = _NOISE[(place & (_PLACES - 1)) << 8 | low[flat]]
            far = place >= _PLACES
            if far.any():
                value[far] *= (place[far] // _PLACES * 2 + 1).astype(np.uint64) * np.uint64(_STEP)
            hashes = np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            doc = np.searchsorted(offsets, first + start, "right") - 1
            yield doc, hashes, first + start - offsets[doc], after + start - offsets[doc]
        start = stop


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: symbols by bits from the highest, at each level the zeros before the ones."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.shifts = list(range(max(alphabet - 1, 1).bit_length() - 1, -1, -1))
        self.levels = []
        for shift in self.shifts:
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.first = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.ones(at)
            at = np.where(symbol >> shift & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at``."""
        return self._down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, how often it comes before)."""
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            bit, ones = level.get(at), level.ones(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, level.zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The place of each suffix in sorted order, by prefix doubling over groups that are still equal.

    Zeros are separators, each smaller than all symbols and than later separators, so suffixes differ at the latest
    there; the last symbol must be one."""
    n, separator = len(text), text == 0
    value = np.where(separator, np.cumsum(separator) - 1, text.astype(np.int64) + int(separator.sum()))
    rank, active, key, base = np.zeros(n, np.int64), np.arange(n), value, np.zeros(n, np.int64)
    step = 0
    while len(active):
        order = np.argsort(key)
        active, key, base = active[order], key[order], base[order]
        count = np.arange(len(active))
        group = np.concatenate([[True], base[1:] != base[:-1]])
        place = base + count - count[group][np.cumsum(group) - 1]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate([head, [len(key)]]))
        rank[active] = np.repeat(place[head], size)
        active = active[np.repeat(size > 1, size)]
        step = max(2 * step, 1)
        base = rank[active]
        key = base * n + rank[active + step]
    return rank


class FmIndex:
    """Backward search and location over a text of symbols from 1, whose runs each end in a zero."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        n, rank = len(text), suffix_ranks(text)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.wavelet = Wavelet(text[suffix - 1].astype(np.int64), alphabet)
        # Every sample-th symbol of a run from its first one: a walk back never crosses a separator.
        separators = np.flatnonzero(text == 0)
        begin = np.concatenate([[0], separators[:-1] + 1])
        in_run = np.arange(n) - np.repeat(begin, separators - begin + 1)
        sampled = in_run[suffix] % sample == 0
        self.sampled, self.places = Bits(sampled), suffix[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of the suffixes that begin with each pattern.  Patterns are rows of symbols
        with zeros before shorter ones."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            at = np.flatnonzero((patterns[:, j] > 0) & (low < high))
            symbol = patterns[at, j]
            low[at] = self.before[symbol] + self.wavelet.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.wavelet.rank(symbol, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row's suffix."""
        out, at, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            done = self.sampled.get(rows)
            out[at[done]] = self.places[self.sampled.ones(rows[done])] + walked
            at, rows = at[~done], rows[~done]
            symbol, count = self.wavelet.access(rows)
            rows, walked = self.before[symbol] + count, walked + 1
        return out


class Patterns:
    """Windows as rows of symbols, with the items of each one."""

    def __init__(self, pairs: pa.Table):
        lengths = np.asarray(pairs["window"].combine_chunks().value_lengths(), dtype=np.int64)
        flat = np.asarray(pairs["window"].combine_chunks().flatten(), dtype=np.int64).view(np.uint64)
        self.vocabulary = np.unique(flat)
        rows = np.zeros((len(lengths), int(lengths.max())), np.int64)
        ends = np.cumsum(lengths)
        back = np.repeat(ends, lengths) - np.arange(len(flat))
        rows[np.repeat(np.arange(len(lengths)), lengths), rows.shape[1] - back] = np.searchsorted(self.vocabulary, flat) + 1
        self.rows, of = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = np.count_nonzero(self.rows, axis=1)
        items = pairs["item"].combine_chunks()
        self.names = sorted({x for x in items.to_pylist() if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        named = np.array([number.get(x, -1) for x in items.to_pylist()], np.int64)
        order = np.argsort(of.ravel(), kind="stable")
        self.items = named[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(self.rows)))])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.vocabulary & np.uint64(len(self.seen) - 1)] = True


def _long_runs(number: np.ndarray, doc: np.ndarray, least: int, edges: tuple[int, int] | None = None) -> np.ndarray:
    """Marks the words that stand in a run of at least ``least`` words on end, or in one that touches the ``edges``."""
    if not len(number):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(number) != 1) | (np.diff(doc) != 0)]))
    size = np.diff(np.concatenate([head, [len(number)]]))
    keep = size >= least
    if edges:
        keep |= (number[head] == edges[0]) | (number[head] + size - 1 == edges[1])
    return np.repeat(keep, size)


class Shard:
    """Documents whose runs are searched together."""

    def __init__(self, patterns: Patterns):
        self.patterns, self.ids, self.counts, self.parts, self.docs, self.symbols, self.seen = patterns, [], [], [], 0, 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        p, least = self.patterns, int(self.patterns.lengths.min())
        counts, parts, number = np.zeros(len(texts), np.int64), [], 0
        for doc, hashes, first, after in words(texts):
            counts += np.bincount(doc, minlength=len(texts))
            at = np.flatnonzero(p.seen[hashes & np.uint64(len(p.seen) - 1)])
            at = at[_long_runs(at, doc[at], least, (0, len(doc) - 1))]
            parts.append((at + number, doc[at], hashes[at], first[at], after[at]))
            number += len(doc)
        if parts:
            number, doc, hashes, first, after = (np.concatenate(x) for x in zip(*parts, strict=True))
            symbol = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
            keep = p.vocabulary[symbol] == hashes
            number, doc, symbol, first, after = (x[keep] for x in (number, doc, symbol, first, after))
            keep = _long_runs(number, doc, least)
            self.parts.append([x[keep] for x in (number + self.seen, doc + self.docs, symbol + 1, first, after)])
            self.symbols += int(keep.sum())
        self.ids.append(ids)
        self.counts.append(counts)
        self.docs += len(texts)
        self.seen += int(counts.sum())

    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.docs >= SHARD_DOCS

    def result(self) -> list:
        """Columns id, n_words, n_hit, items, spans."""
        n_words = np.concatenate(self.counts)
        n_hit, items = np.zeros(self.docs, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        spans = (np.zeros(0, np.int64),) * 5
        base = np.cumsum(n_words) - n_words
        if self.symbols:
            number, doc, symbol, first, after = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            new = np.concatenate([[True], (np.diff(number) != 1) | (np.diff(doc) != 0)])
            at = np.arange(len(symbol)) + np.cumsum(new) - 1  # one separator after each run
            text = np.zeros(len(symbol) + int(new.sum()), np.int64)
            text[at] = symbol
            hit, items = self._search(text, at, doc)
            n_hit = np.bincount(doc[hit], minlength=self.docs)
            head = hit & (new | ~np.concatenate([[False], hit[:-1]]))
            tail = hit & np.concatenate([new[1:] | ~hit[1:], [True]])
            spans = doc[head], number[head] - base[doc[head]], number[tail] + 1 - base[doc[tail]], first[head], after[tail]
        names = np.asarray(self.patterns.names, object)
        fields = pa.StructArray.from_arrays([pa.array(x) for x in spans[1:]], list(SPAN))
        return [
            pa.concat_arrays(self.ids), pa.array(n_words), pa.array(n_hit),
            _lists(items[0], self.docs, pa.array(names[items[1]], pa.string())), _lists(spans[0], self.docs, fields),
        ]

    def _search(self, text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        p = self.patterns
        index = FmIndex(text, len(p.vocabulary) + 1)
        low, high = index.search(p.rows)
        found = np.flatnonzero(low < high)
        word = np.full(len(text), -1, np.int64)
        word[at] = np.arange(len(at))
        change, pairs = np.zeros(len(text) + 1, np.int64), []
        size = high[found] - low[found]
        ends = np.cumsum(size)
        for start in range(0, int(ends[-1]) if len(ends) else 0, WALK):
            each = np.arange(start, min(start + WALK, int(ends[-1])))
            which = np.searchsorted(ends, each, "right")
            window = found[which]
            place = index.locate(low[window] + each - (ends[which] - size[which]))
            change += np.bincount(place, minlength=len(change)) - np.bincount(place + p.lengths[window], minlength=len(change))
            pairs.append(np.unique(doc[word[place]] * len(p.rows) + window))
        hit = (np.cumsum(change)[:-1] > 0)[at]
        if not pairs:
            return hit, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pair = np.unique(np.concatenate(pairs))
        d, window = pair // len(p.rows), pair % len(p.rows)
        many = p.first[window + 1] - p.first[window]
        begin = np.repeat(p.first[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item, d = p.items[begin], np.repeat(d, many)
        both = np.unique(d[item >= 0] * len(p.names) + item[item >= 0]) if p.names else np.zeros(0, np.int64)
        return hit, (both // max(len(p.names), 1), both % max(len(p.names), 1))


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists of the values of each of ``n`` rows; ``of`` is in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def windows(df: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, window): the distinct windows of ``size`` words on end of each text, or its one shorter window, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = [h for _, h, _, _ in words(batch.column(1).slice(row, 1))]
                if not parts:
                    continue
                hashes = np.concatenate(parts).view(np.int64)
                k = min(size, len(hashes))
                for at in range(0, len(hashes) - k + 1, 1 << 16):
                    made = np.lib.stride_tricks.sliding_window_view(hashes[at : at + (1 << 16) + k - 1], k)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * k), pa.array(made.ravel()))
                    item = pa.array([batch.column(0)[row].as_py()] * len(made), pa.string())
                    yield pa.RecordBatch.from_arrays([item, lists], names=["item", "window"])

    rows = df.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "item string, window array<bigint>").distinct()


def _scan(rows: DataFrame, pairs: pa.Table) -> DataFrame:
    names = ["id", "n_words", "n_hit", "items", "spans"]
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}"
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(sent.value)
        shard = Shard(patterns)
        for batch in batches:
            shard.add(batch.column(0), batch.column(1))
            if shard.full():
                yield pa.RecordBatch.from_arrays(shard.result(), names=names)
                shard = Shard(patterns)
        if shard.docs:
            yield pa.RecordBatch.from_arrays(shard.result(), names=names)

    return in_arrow(rows, run, out)


def _merged(rows: DataFrame) -> DataFrame:
    """One row of each id from those of several passes; spans that overlap or touch become one."""
    one = rows.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = rows.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    order = Window.partitionBy("id").orderBy("word")
    each = each.withColumn("past", F.max("word_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("span", F.sum(F.when(F.col("word") <= F.col("past"), 0).otherwise(1)).over(order))
    each = each.groupBy("id", "span").agg(F.min("word").alias("word"), F.max("word_end").alias("word_end"), F.min("first").alias("first"), F.max("after").alias("after"))
    spans = each.groupBy("id").agg(F.sum(F.col("word_end") - F.col("word")).alias("n_hit"), F.array_sort(F.collect_list(F.struct(*SPAN))).alias("spans"))
    none = F.array().cast(SPANS)
    return one.join(spans, "id", "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items", F.coalesce("spans", none).alias("spans"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, most: int = PASS_WINDOWS) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans) of every row of ``docs``.

    ``items`` are the distinct ids, as strings in order, of the items one of whose windows occurs; ``spans`` are what
    these windows cover: numbers of the first word and of the one after the last, and offsets of their UTF-8 bytes.
    A null text has no words; repeated rows and null ids are rows like others; windows of an item without an id are
    found but not listed; an item of fewer than ``size`` words is one window, one without words has none.  Texts of any
    length are searched whole.  Other columns are not looked at.  An empty benchmark finds nothing."""
    pairs = materialize(windows(benchmark, item_col, item_text_col, size), "windows")
    passes = -(-pairs.count() // most)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    if passes <= 1:
        found = _scan(rows, pairs.toArrow() if passes else pa.table({"item": pa.array([""]), "window": pa.array([[0]], pa.list_(pa.int64()))}))
    else:
        # Every row has a number of its own, written so that all passes see the same.
        keyed = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "keyed")
        share = F.pmod(F.xxhash64("item", "window"), F.lit(passes))
        searched = keyed.select(F.col("key").alias("id"), "text")
        parts = [materialize(_scan(searched, pairs.filter(share == k).toArrow()), "pass") for k in range(passes)]
        merged = _merged(reduce(DataFrame.unionByName, parts)).withColumnRenamed("id", "key")
        found = keyed.select("key", "id").join(merged, "key").drop("key")
    return found.withColumnRenamed("id", id_col)


def kept_text(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    raw = F.encode(text, "UTF-8")
    cut = F.aggregate(
        spans,
        F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.struct(F.concat(a["kept"], F.substring(raw, (a["at"] + 1).cast("int"), (x["first"] - a["at"]).cast("int"))).alias("kept"), x["after"].alias("at")),
    )
    return F.decode(F.concat(cut["kept"], F.substring(raw, (cut["at"] + 1).cast("int"), F.octet_length(text))), "UTF-8")


ORACLE = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[i:i + {WINDOW - 1}] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, least(len(w), 1) + 1))) AS i FROM b)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT r, i, l, w[i:i + l - 1] AS win FROM (
  SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT len(win) AS l FROM bw) AS lengths)),
hits AS (SELECT r, i, l, item FROM dw JOIN bw USING (win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
