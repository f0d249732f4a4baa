"""Document quality by co-training of two views.

One classifier sees the text alone, the other the page's metadata alone.  Both start from the labelled rows.  In every
round each of them labels the unlabelled rows it is surest of, and the other one learns from these.  In the end the two
are calibrated on labelled rows kept aside and combined there, and score every document.

Features are computed by Spark over whole texts.  The classifiers are fitted on the driver to a bounded sample: the
first ``LABELLED`` labelled and ``POOL`` other documents by hash of all that is read of them, as rows of numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, keep_where

LABELLED, POOL = 8000, 8000
ROUNDS, GROW, SURE = 3, 400, 0.98
#: A document goes if it is good with a lower probability than this; lower still, if more than this share of the good
#: labelled rows kept aside would go.
CUT, CLEAN_LOSS = 0.2, 0.001
PAIRS = 32
META = ("source", "lang", "n_chars")
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~+=<>", b"()[]{}/\\_-\"'`", bytes(range(128, 256)))


def _kind_table() -> np.ndarray:
    out = np.full(256, len(_KINDS), np.int64)
    for k, members in enumerate(_KINDS):
        out[list(members)] = k
    return out


_KIND = _kind_table()


def text_features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters and of hashed pairs of them, shape of words and lines, and repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=len(_KINDS) + 1) / n
    pairs = np.bincount((raw[:-1].astype(np.int64) * 31 + raw[1:]) % PAIRS, minlength=PAIRS) / n
    words = data.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    lines = data.split(b"\n")
    shape = [
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), lengths.std(), len(seen) / m, max(seen.values(), default=0) / m,
        again, sum(map(bytes.isupper, words)) / m, sum(map(bytes.isalpha, words)) / m, np.log1p(len(data) / len(lines)), len(set(lines)) / len(lines),
    ]
    return np.concatenate([kinds, pairs, shape]).astype(np.float32)


def meta_features(values: list, kinds: tuple[tuple[str, bool], ...]) -> np.ndarray:
    """Hashed values of text columns, logarithms of numbers, by the (name, is a number) of each column; nulls have marks of
    their own, and so have numbers that are none."""
    parts = []
    for (name, number), value in zip(kinds, values, strict=True):
        if number:
            there = value is not None and np.isfinite(value)
            parts.append(np.array([np.log1p(abs(value)), 0.0] if there else [0.0, 1.0]))
        else:
            hashed = np.zeros(32)
            hashed[zlib.crc32(f"{name}={value}".encode()) % 31 if value is not None else 31] = 1
            parts.append(hashed)
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros(0, np.float32)


class Logistic:
    """Logistic regression with a squared penalty on standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.hstack([self._scaled(x), np.ones((len(x), 1))])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._scaled(x) @ self.w[:-1] + self.w[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class CoTrained:
    """Both views, their combination and the cut; without labelled rows of both kinds everything scores 1."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray):
        self.blank = len(set(y[~aside])) < 2 or len(set(y[aside])) < 2
        self.cut, self.added = CUT, [0, 0]
        if self.blank:
            return
        views, pools = (text[~aside], meta[~aside]), (pool_text, pool_meta)
        extra_x: list[list[np.ndarray]] = [[], []]
        extra_y: list[list[np.ndarray]] = [[], []]
        free = np.ones(len(pool_text), bool)
        for step in range(ROUNDS + 1):
            self.views = [Logistic(np.vstack([views[v], *extra_x[v]]), np.concatenate([y[~aside], *extra_y[v]])) for v in (0, 1)]
            if step == ROUNDS or not free.any():
                break
            chosen = np.zeros(len(free), bool)
            for v in (0, 1):
                p = np.where(free & ~chosen, sigmoid(self.views[v].logit(pools[v])), 0.5)
                for good, sure in ((1.0, p), (0.0, 1 - p)):
                    first = np.argsort(-sure, kind="stable")[:GROW]
                    first = first[sure[first] >= SURE]
                    chosen[first] = True
                    extra_x[1 - v].append(pools[1 - v][first])
                    extra_y[1 - v].append(np.full(len(first), good))
                    self.added[1 - v] += len(first)
            free &= ~chosen
        logits = np.column_stack([self.views[v].logit(x[aside]) for v, x in ((0, text), (1, meta))])
        self.scales = [Logistic(logits[:, [v]], y[aside]) for v in (0, 1)]
        self.joint = Logistic(self._calibrated(logits), y[aside])
        scores = sigmoid(self.joint.logit(self._calibrated(logits)))
        self.cut = min(CUT, float(np.quantile(scores[y[aside] > 0.5], CLEAN_LOSS)))

    def _calibrated(self, logits: np.ndarray) -> np.ndarray:
        return np.column_stack([self.scales[v].logit(logits[:, [v]]) for v in (0, 1)])

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: probability that the document is good, by the text view, by the metadata view."""
        if self.blank:
            return np.ones((len(text), 3))
        logits = self._calibrated(np.column_stack([self.views[0].logit(text), self.views[1].logit(meta)]))
        return np.column_stack([sigmoid(self.joint.logit(logits)), sigmoid(logits)])


def _features(texts: list, metas: list[list], kinds: tuple[tuple[str, bool], ...]) -> tuple[np.ndarray, np.ndarray]:
    meta = [meta_features(row, kinds) for row in zip(*metas, strict=True)] if metas else [meta_features([], ())] * len(texts)
    return np.array([text_features(t) for t in texts]), np.array(meta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META, label_col: str = "quality") -> CoTrained:
    """Fit to the labelled documents of ``docs``; several labels of one id are averaged, null ids and labels left out.

    Rows that are equal in all that is read of them count as one; a row without an id is one without a label."""
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("y"))
    given = given.select("id", (F.col("y") >= 0.5).cast("double").alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(_plain(docs, c) for c in meta_cols))
    rows = rows.withColumn("mark", F.xxhash64("id", "text", *meta_cols))
    # The first of each kind by hash, ids and hashes only; then at most LABELLED + POOL of these are broadcast.
    marks = rows.select("id", "mark").distinct()
    known = marks.join(given, "id").orderBy("mark", "id").limit(LABELLED).select("mark", "y")
    others = marks.filter("id IS NOT NULL").join(given, "id", "left_anti").union(marks.filter("id IS NULL"))
    others = others.orderBy("mark", "id").limit(POOL).select("mark", F.lit(None).cast("double").alias("y"))
    chosen = rows.join(F.broadcast(known.union(others)), "mark")
    sample = chosen.groupBy("mark").agg(*(F.first(c).alias(c) for c in ("id", "y", "text", *meta_cols)))
    aside = F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(4)) == 0
    kinds = _kinds(docs, meta_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if batch.num_rows:
                text, meta = _features(columns[2], columns[3:], kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(text), pa.list_(pa.float32())), pa.array(list(meta), pa.list_(pa.float32()))], names=["y", "aside", "x", "m"])

    made = in_arrow(sample.select("y", aside.alias("aside"), "text", *meta_cols), run, "y double, aside boolean, x array<float>, m array<float>").toArrow()
    y = np.array([np.nan if v is None else v for v in made.column("y").to_pylist()], np.float64)
    set_aside = np.array([bool(v) for v in made.column("aside").to_pylist()], bool)
    grid = lambda name: np.array(made.column(name).to_pylist(), np.float64).reshape(len(y), -1 if len(y) else 1)
    text, meta = grid("x"), grid("m")
    known = ~np.isnan(y)
    return CoTrained(text[known], meta[known], y[known], set_aside[known], text[~known], meta[~known])


def _kinds(docs: DataFrame, names: tuple[str, ...]) -> tuple[tuple[str, bool], ...]:
    """(name, is a number) of metadata columns, by their types."""
    kinds = dict(docs.dtypes)
    return tuple((n, kinds[n] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[n].startswith("decimal")) for n in names)


def _plain(docs: DataFrame, name: str):
    """A metadata column as a number or a string."""
    return F.col(name).cast("double" if _kinds(docs, (name,))[0][1] else "string").alias(name)


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META) -> DataFrame:
    """(id_col, score, score_text, score_meta, good) of every row, from its whole text and its metadata.

    A null text is empty text; null metadata has marks of its own; repeated rows are rows like others; other columns are
    not looked at."""
    shared, kinds = docs.sparkSession.sparkContext.broadcast(model), _kinds(docs, meta_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                columns = [c.to_pylist() for c in piece.columns]
                p = shared.value.score(*_features(columns[1], columns[2:], kinds))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 0] >= shared.value.cut)], names=["id", "score", "score_text", "score_meta", "good"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(_plain(docs, c) for c in meta_cols))
    return in_arrow(rows, run, "id long, score double, score_text double, score_meta double, good boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: CoTrained, text_col: str = "text", meta_cols: tuple[str, ...] = META) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least the cut."""
    shared, kinds = docs.sparkSession.sparkContext.broadcast(model), _kinds(docs, meta_cols)

    def good(columns: list[list]) -> np.ndarray:
        return shared.value.score(*_features(columns[0], columns[1:], kinds))[:, 0] >= shared.value.cut

    return keep_where(docs, (F.col(text_col).cast("string"), *(_plain(docs, c) for c in meta_cols)), good, 500)
