"""Language identification by interpolated Kneser-Ney models of character sequences.

Each language has a model of four-letter sequences: counts discounted and interpolated with shorter sequences, which
count by the contexts they end.  The models are kept as sorted arrays of 64-bit keys, one for each length, with a row of
log probabilities, one for each language, that are interpolated to the end; a sequence that no language has goes down
by its context's weights.  The language with the lowest cross-entropy for each character is chosen, and a text whose
cross-entropy is far from what the language's own texts have is rejected.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import in_arrow, keep_where

ORDER = 4
SPACE = 32
#: How sharp the likelihoods may be taken.
SHARP = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)
LEAST_REJECT = 8.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of each character of the basic plane, a space for what is no letter."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 1 << 16 else c
    return out


def codes(text: str | None) -> np.ndarray:
    """Letters of the whole text in lower case, with one space for each run of other characters and at both ends; empty
    if there is no letter.  Letters of other planes are folded into the private-use area."""
    if not text:
        return np.empty(0, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters()[points & 0xFFFF]
    high = np.flatnonzero(points > 0xFFFF)
    for i in high.tolist():
        out[i] = 0xE000 + (int(points[i]) >> 4) % 0x1800 if chr(points[i]).isalpha() else SPACE
    gap = out == SPACE
    if gap.all():
        return np.empty(0, np.uint16)
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    out = out[keep]
    return np.concatenate([np.full(1, SPACE, np.uint16), out[int(out[0] == SPACE) :], np.full(int(out[-1] != SPACE), SPACE, np.uint16)])


def keys(letters: np.ndarray) -> np.ndarray:
    """The sequences of ``ORDER`` letters that end at each letter but the first space, packed; spaces stand before."""
    padded = np.concatenate([np.full(ORDER - 2, SPACE, np.uint16), letters]).astype(np.uint64)
    out = padded[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out |= padded[ORDER - 1 - k : -k] << np.uint64(16 * k)
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): sequences of all texts of ``rows`` (lang, text), counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    letters = codes(text)
                    if len(letters):
                        texts.setdefault(lang, []).append(keys(letters))
                for lang, found in texts.items():
                    grams, n = np.unique(np.concatenate(found), return_counts=True)
                    if lang in held:
                        grams, where = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                        n = np.bincount(where, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = grams, n
                if sum(len(g) for g, _ in held.values()) > 1 << 19:
                    yield from out()
        yield from out()

    return in_arrow(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values are there."""
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, table[at] == wanted


class Model:
    """Sorted arrays of all languages: ``grams[m]`` with ``logs[m]``, and ``contexts[m]`` with ``weights[m]``."""

    def __init__(self, rows: Iterable[tuple[str, int, int]]):
        by_lang: dict[str, tuple[array, array]] = {}
        for lang, gram, n in rows:
            grams, counted = by_lang.setdefault(lang, (array("q"), array("q")))
            grams.append(gram)
            counted.append(n)
        self.langs = sorted(by_lang)
        single = []
        for lang in self.langs:
            grams = np.array(by_lang[lang][0], np.int64).view(np.uint64)
            order = np.argsort(grams)
            single.append(self._levels(grams[order], np.array(by_lang[lang][1], np.float64)[order]))
        letters = np.unique(np.concatenate([s[1][0] for s in single])) if single else np.empty(0, np.uint64)
        self.base = 1.0 / (len(letters) + 1)
        self.grams, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        below = np.full((1, len(self.langs)), self.base)
        for m in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([s[m][0] for s in single])) if single else np.empty(0, np.uint64)
            heads = np.unique(grams >> np.uint64(16))
            share, weight = np.zeros((len(grams), len(single))), np.ones((len(heads), len(single)))
            for k, s in enumerate(single):
                own, n = s[m]
                ones, twos = (n == 1).sum(), (n == 2).sum()
                cut = ones / (ones + 2 * twos) if ones and twos else 0.5
                head = own >> np.uint64(16)
                starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
                total = np.add.reduceat(n, starts)
                kinds = np.diff(np.append(starts, len(own)))
                share[np.searchsorted(grams, own), k] = np.maximum(n - cut, 0) / np.repeat(total, kinds)
                weight[np.searchsorted(heads, head[starts]), k] = cut * kinds / total
            tail = grams & np.uint64((1 << 16 * (m - 1)) - 1)
            lower = below[np.searchsorted(self.grams[m - 1], tail)] if m > 1 else below
            p = share + weight[np.searchsorted(heads, grams >> np.uint64(16))] * lower
            self.grams[m], self.contexts[m], below = grams, heads, p
            self.logs[m], self.weights[m] = np.log(p).astype(np.float32), np.log(weight).astype(np.float32)
        self.mean = np.zeros(len(self.langs))
        self.letter_var = self.text_var = np.ones(len(self.langs))
        self.sharp, self.limit = 1.0, LEAST_REJECT

    @staticmethod
    def _levels(grams: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts of each length: of the longest as they are, of a shorter one the number of letters before it."""
        levels = {ORDER: (grams, n)}
        for m in range(ORDER - 1, 0, -1):
            tails, kinds = np.unique(levels[m + 1][0] & np.uint64((1 << 16 * m) - 1), return_counts=True)
            levels[m] = tails, kinds.astype(np.float64)
        return levels

    def logp(self, wanted: np.ndarray, m: int = ORDER) -> np.ndarray:
        """Log probability of the last letter of each sequence after those before it, for each language."""
        if m == 0:
            return np.full((len(wanted), len(self.langs)), np.log(self.base), np.float32)
        at, there = _find(self.grams[m], wanted)
        out = self.logs[m][at]
        missing = np.flatnonzero(~there)
        if len(missing):
            rest = wanted[missing]
            lower = self.logp(rest & np.uint64((1 << 16 * (m - 1)) - 1), m - 1)
            at, there = _find(self.contexts[m], rest >> np.uint64(16))
            out[missing] = lower + np.where(there[:, None], self.weights[m][at], np.float32(0))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters, cross-entropy for each language and letter) of each text."""
        found = [codes(text) for text in texts]
        sizes = np.array([max(0, len(f) - 1) for f in found])
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full) and self.langs:
            logs = self.logp(np.concatenate([keys(found[i]) for i in full]))
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / sizes[full, None]
        return sizes, out

    def against(self, langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, letters, cross-entropy in it to four digits, loss for each of ``SHARP``) of the texts with letters."""
        sizes, h = self.entropies(texts)
        number = {lang: k for k, lang in enumerate(self.langs)}
        truth = np.array([number.get(lang, -1) for lang in langs], np.int64)
        good = (truth >= 0) & (sizes > 0)
        sizes, h, truth = sizes[good], h[good], truth[good]
        each = np.arange(len(h))
        loss = [-np.log(np.maximum(self._posterior(sizes, h, sharp)[each, truth], 1e-9)) for sharp in SHARP] if len(h) else [np.empty(0)] * len(SHARP)
        return truth, sizes, np.round(h[each, truth], 4), np.array(loss)

    @staticmethod
    def _posterior(sizes: np.ndarray, h: np.ndarray, sharp: float) -> np.ndarray:
        x = -h * sizes[:, None] * sharp
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text; without letters ``und``, score 0 and rejected."""
        sizes, h = self.entropies(texts)
        none = sizes == 0
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        k = h.argmin(axis=1)  # of equal ones the first by name
        best = h[np.arange(len(h)), k]
        far = (best - self.mean[k]) / np.sqrt(self.text_var[k] + self.letter_var[k] / np.maximum(sizes, 1))
        score = np.where(none, 0.0, self._posterior(sizes, h, self.sharp).max(axis=1))
        return [UNKNOWN if n else self.langs[i] for n, i in zip(none, k, strict=True)], score, best, none | (far > self.limit)


def _rank(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value): of each group the least value that ``share`` of its rows do not exceed, by counts of distinct values,
    which rounding or the length of texts bounds."""
    steps = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    steps = steps.withColumn("_upto", F.sum("_n").over(whole.orderBy(value))).withColumn("_all", F.sum("_n").over(whole))
    return steps.filter(F.col("_upto") >= share * F.col("_all")).groupBy(*keys).agg(F.min(value).alias(value))


def calibrate(model: Model, rows: DataFrame) -> None:
    """Spread of the cross-entropy of each language's texts, how sharp the likelihoods are taken and the limit of rejection,
    from all of ``rows`` (lang, text); only a row for each language gets to the driver."""
    spark, c = rows.sparkSession, F.col
    shared = spark.sparkContext.broadcast(model)
    losses = [f"l{k}" for k in range(len(SHARP))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 150):
                langs, texts = batch.slice(at, 150).columns
                lang, size, own, loss = shared.value.against(langs.to_pylist(), texts.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(size), pa.array(own), *[pa.array(x) for x in loss]], names=["k", "size", "own", *losses])

    told = materialize(in_arrow(rows.select("lang", "text"), run, ", ".join(["k long, size long, own double", *[f"{x} double" for x in losses]])), "calibration")
    middle = _rank(told, ["k"], "own", 0.5).withColumnRenamed("own", "mean").join(_rank(told, ["k"], "size", 0.5).withColumnRenamed("size", "half"), "k")
    far = (c("own") - c("mean")) ** 2
    found = told.join(middle, "k").groupBy("k", "mean").agg(F.avg(F.when(c("size") >= c("half"), far)).alias("text"), F.avg(far * c("size")).alias("letter")).collect()
    if not found:
        return
    model.text_var, model.letter_var = np.ones(len(model.langs)), np.ones(len(model.langs))
    for r in found:
        model.mean[r.k], model.text_var[r.k], model.letter_var[r.k] = r.mean, max(1e-4, r.text), max(0.25, r.letter)
    spread = spark.createDataFrame([(r.k, r.mean, float(model.text_var[r.k]), float(model.letter_var[r.k])) for r in found], "k long, mean double, text double, letter double")
    scores = told.join(spread, "k").select(F.lit(0).alias("one"), F.round((c("own") - c("mean")) / F.sqrt(c("text") + c("letter") / c("size")), 3).alias("score"))
    model.limit = max(LEAST_REJECT, 2 * _rank(scores, ["one"], "score", 0.999).first()["score"])
    loss = told.agg(*[F.round(F.avg(x), 9).alias(x) for x in losses]).first()
    model.sharp = min(zip(loss, range(len(SHARP)), SHARP, strict=True))[2]


def fit(rows: DataFrame) -> Model:
    """A model from all ``rows`` (lang, text) whose text and language are not null.

    Every text is counted whole by Spark.  The model has every sequence of every language, so discounts and continuation
    counts are those of all texts; its size grows with the distinct sequences.  All texts are scored once more to calibrate it."""
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    model = Model(tuple(r) for r in counts(rows.select("lang", "text")).select("lang", "gram", "n").toLocalIterator())
    if model.langs:
        calibrate(model, rows)
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, entropy, rejected) of every row, from its whole text alone.

    A null, empty or letterless text is ``und`` with score 0 and rejected; so is all text if nothing was learned.  Equal
    texts have equal results, repeated rows are rows like others, other columns are not looked at."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 150):
                ids, texts = batch.slice(at, 150).columns
                lang, score, entropy, rejected = shared.value.predict(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["id", "lang_pred", "score", "entropy", "rejected"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "id long, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text the model does not reject."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def known(columns: list[list]) -> np.ndarray:
        return ~shared.value.predict(columns[0])[3]

    return keep_where(df, (F.col(text_col).cast("string"),), known, 150)
