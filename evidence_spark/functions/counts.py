"""Gram counts of whole texts, worked out inside tasks.

The same counts as ``text.char_grams`` of the marked texts: Spark prepares the marked texts in the JVM, the slices are numbers
of a chunk's own alphabet, sorted together with the number of their text.  Characters are code points.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Ship these helpers with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that are counted at once, and rows of a batch.
CHARS, ROWS = 1 << 20, 1 << 16
#: No marked text holds these: the first ends a line, the second a text.
LINE, TEXT = "\x00", "\x01"


def marked_whole(c: Column) -> Column:
    return T.marked(F.trim(T.mask_numbers(c)))


def marked_lines(c: Column) -> Column:
    """The marked lines of a text, one after another, so that no slice crosses them."""
    return F.array_join(F.transform(F.split(c, "\n"), marked_whole), LINE)


class Counts:
    """Grams of texts in order by text: ``owner`` (which text), ``code`` (rows of four places of ``alphabet``, 0 where a gram is
    shorter) and ``n``."""

    def __init__(self, alphabet: np.ndarray, owner: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.alphabet, self.owner, self.code, self.n = alphabet, owner, code, n

    def strings(self) -> pa.Array:
        chars = ["", *map(chr, self.alphabet[1:].tolist())]
        raw = [c.encode("utf-8", "surrogatepass") for c in chars]
        wide = max(map(len, raw), default=1) or 1
        table = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raw), np.uint8).reshape(-1, wide)
        size = np.array([len(r) for r in raw])
        there = np.arange(wide) < size[:, None]
        ends = np.concatenate([[0], np.cumsum(size[self.code].sum(axis=1))]).astype(np.int32)
        data = table[self.code][there[self.code]]
        return pa.Array.from_buffers(pa.string(), len(self.n), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def counted(texts: Sequence[str]) -> Iterator[Counts]:
    """Counts of consecutive texts, each gram of a text once; ``owner`` numbers all texts."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHARS):
            size += len(texts[hi])
            hi += 1
        yield from _counted(texts, lo, hi)
        lo = hi


def _counted(texts: Sequence[str], lo: int, hi: int) -> Iterator[Counts]:
    u = np.frombuffer("".join(x + TEXT for x in texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[u] = True
    seen[:2] = False
    alphabet = np.concatenate([[0], np.flatnonzero(seen)])
    base = len(alphabet)
    if base**4 * (hi - lo) >= 1 << 63:
        if hi - lo > 1:
            yield from _counted(texts, lo, (lo + hi) // 2)
            yield from _counted(texts, (lo + hi) // 2, hi)
        else:
            yield _plainly(texts[lo], lo, alphabet)
        return
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(base)
    parts = []
    for at in range(0, len(u), 2 * CHARS):  # a very long text in parts
        x = number[u[at : at + 2 * CHARS + 3]]
        stop = min(2 * CHARS, len(u) - at)
        owner = np.cumsum(u[at : at + stop] == 1) if hi - lo > 1 else np.zeros(stop, np.int64)
        key = (owner * base + x[:stop]) if hi - lo > 1 else x[:stop].copy()
        ok, found = x[:stop] > 0, []
        for k in range(1, 4):
            key = key[: len(x) - k] * base + x[k : k + len(key)]
            ok = ok[: len(key)] & (x[k : k + len(key)] > 0)
            found.append(key[ok] * base ** (3 - k))
        key = np.concatenate(found)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        parts.append((key[first], np.diff(np.append(first, len(key)))))
    key, n = parts[0] if len(parts) == 1 else _sums(*(np.concatenate(p) for p in zip(*parts, strict=True)))
    code = np.empty((len(key), 4), np.int64)
    for k in (3, 2, 1, 0):
        key, code[:, k] = np.divmod(key, base)
    yield Counts(alphabet, key + lo, code, n)


def _plainly(text: str, owner: int, alphabet: np.ndarray) -> Counts:
    """One text of more different characters than four of them fit into a number."""
    number = {chr(c): k for k, c in enumerate(alphabet.tolist()) if k}
    bag = Counter(line[i : i + k] for line in text.split(LINE) for k in (2, 3, 4) for i in range(len(line) - k + 1))
    code = np.array([[*(number[c] for c in g), 0, 0][:4] for g in bag], np.int64).reshape(-1, 4)
    return Counts(alphabet, np.full(len(bag), owner), code, np.array(list(bag.values()), np.int64))


def gram_rows(df: DataFrame, key: str, marked: Column) -> DataFrame:
    """(key, gram, n) of each row's text; a text that is null has one row without gram."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            there = np.flatnonzero(~texts.is_null().to_numpy(zero_copy_only=False))
            for c in counted(texts.take(pa.array(there)).to_pylist()):
                yield from _rows(key, keys.take(pa.array(there[c.owner])), c.strings(), pa.array(c.n))
            none = keys.filter(texts.is_null())
            yield from _rows(key, none, pa.nulls(len(none), pa.string()), pa.nulls(len(none), pa.int64()))

    return df.select(key, marked.alias("marked")).mapInArrow(run, f"`{key}` {kind}, gram string, n bigint")


def _rows(key: str, *table: pa.Array) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(table[0]), ROWS):
        yield pa.RecordBatch.from_arrays([a.slice(lo, ROWS) for a in table], names=[key, "gram", "n"])


def gram_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): gram counts of the lines of all texts of a key together.  Texts, not grams, are dealt by the key; in a task
    the texts of a key come one after another, and what is held of them are their counts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, like, held = None, None, []  # a key and counts (gram, n) of its texts so far

        def summed() -> tuple[pa.Array, pa.Array]:
            if len(held) == 1:
                return held[0]
            table = pa.table([pa.concat_arrays(list(x)) for x in zip(*held, strict=True)], names=["gram", "n"])
            table = table.group_by("gram").aggregate([("n", "sum")]).combine_chunks()
            return table["gram"].chunk(0), table["n_sum"].chunk(0)

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                grams, n = summed()
                yield from _rows(key, pa.array([last], like).take(pa.array(np.zeros(len(n), np.int64))), grams, n)
                held.clear()

        def hold(this, piece: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal last
            if held and this != last:
                yield from out()
            last = this
            held.append(piece)
            if len(held) > 64:
                held[:] = [summed()]

        for batch in batches:
            keys, ids, like = batch.column(0), batch.column(0).to_pylist(), batch.column(0).type
            # Texts of a key count as lines of one, as long as that is not too long.
            whole, place, size = [], [], 0
            for i, x in enumerate(batch.column(1).to_pylist()):
                if place and ids[place[-1]] == ids[i] and size + len(x) <= CHARS:
                    whole[-1].append(x)
                    size += len(x)
                else:
                    whole.append([x])
                    place.append(i)
                    size = len(x)
            place = np.array(place, np.int64)
            for c in counted([LINE.join(x) for x in whole]):
                at, grams, n = place[c.owner], c.strings(), pa.array(c.n)
                cut = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist(), len(at)]
                # Between the first and the last text of a chunk, which may have more of their key around them, keys are whole.
                yield from hold(ids[at[0]], (grams.slice(0, cut[1]), n.slice(0, cut[1])))
                if len(cut) > 2:
                    whole_from, whole_to = cut[1], cut[-2]
                    for s, e in zip(cut[1:-1], cut[2:], strict=True):
                        if ids[at[s]] != last:
                            break
                        yield from hold(last, (grams.slice(s, e - s), n.slice(s, e - s)))
                        whole_from = e
                    if whole_from < len(at):
                        yield from out()
                        if whole_from < whole_to:
                            yield from _rows(key, keys.take(pa.array(at[whole_from:whole_to])), grams.slice(whole_from, whole_to - whole_from), n.slice(whole_from, whole_to - whole_from))
                        yield from hold(ids[at[whole_to]], (grams.slice(whole_to), n.slice(whole_to)))
        yield from out()

    rows = df.filter(F.col(text).isNotNull()).select(key, text).repartition(key).sortWithinPartitions(key)
    return rows.select(key, marked_lines(F.col(text)).alias("marked")).mapInArrow(run, f"`{key}` {kind}, gram string, n bigint")


class Weights:
    """A bounded part of a model: what each of its grams weighs for each label, looked up by number."""

    def __init__(self, grams: list[str], weight: np.ndarray):
        """``weight``: a row for each gram and a column for each label, not a number where the model has none."""
        self.alphabet = np.array(sorted({ord(c) for g in grams for c in g}), np.int64)
        self.base = len(self.alphabet) + 1
        self.place = None
        if self.base**4 < 1 << 63:
            number = {chr(c): k + 1 for k, c in enumerate(self.alphabet.tolist())}
            code = np.array([[*map(number.get, g), 0, 0][:4] for g in grams], np.int64).reshape(-1, 4)
            keys = self._key(code)
            order = np.argsort(keys)
            self.keys, self.weight = keys[order], weight[order]
        else:
            self.place, self.weight = {g: k for k, g in enumerate(grams)}, weight

    @classmethod
    def of(cls, state: dict) -> "Weights":
        """From plain values, as a broadcast value's class is not shipped with it."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def _key(self, code: np.ndarray) -> np.ndarray:
        key = code[:, 0]
        for k in (1, 2, 3):
            key = key * self.base + code[:, k]
        return key

    def find(self, c: Counts) -> tuple[np.ndarray, np.ndarray]:
        """(which grams of ``c`` are there, their rows)."""
        if self.place is not None:
            at = np.array([self.place.get(g, -1) for g in c.strings().to_pylist()], np.int64)
            return np.flatnonzero(at >= 0), at[at >= 0]
        own = c.alphabet[1:]
        near = np.minimum(np.searchsorted(self.alphabet, own), len(self.alphabet) - 1)
        number = np.concatenate([[0], np.where(self.alphabet[near] == own, near + 1, -1)])
        code = number[c.code]
        known = np.flatnonzero((code >= 0).all(axis=1))
        key = self._key(code[known])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return known[hit], at[hit]


def weighed(df: DataFrame, key: str, marked: Column, grams: list[str], weight: np.ndarray) -> DataFrame:
    """(key, grams, hits, sums): of each row's text how many distinct grams it has, and for each label (a column of ``weight``) how
    many of them the bounded part of a model weighs and the sum of count times weight."""
    kind, labels = dict(df.dtypes)[key], weight.shape[1]
    sent = df.sparkSession.sparkContext.broadcast(vars(Weights(grams, weight)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights.of(sent.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            size, hits, sums = np.ones(len(keys), np.int64), np.zeros((len(keys), labels), np.int64), np.zeros((len(keys), labels))
            there = np.flatnonzero(~texts.is_null().to_numpy(zero_copy_only=False))
            size[there] = 0
            for c in counted(texts.take(pa.array(there)).to_pylist()):
                owner = there[c.owner]
                size += np.bincount(owner, minlength=len(keys))
                known, at = model.find(c)
                owner, n = owner[known], c.n[known]
                for k in range(labels):
                    w = model.weight[at, k]
                    ok = ~np.isnan(w)
                    hits[:, k] += np.bincount(owner[ok], minlength=len(keys))
                    sums[:, k] += np.bincount(owner[ok], n[ok] * w[ok], len(keys))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * labels), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(size), lists(hits), lists(sums)], names=[key, "grams", "hits", "sums"])

    return df.select(key, marked.alias("marked")).mapInArrow(run, f"`{key}` {kind}, grams bigint, hits array<bigint>, sums array<double>")
