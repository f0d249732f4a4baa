"""Gram counts of whole texts inside tasks: the same as those of ``char_grams``, and no gram row is shuffled for them."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidence_spark.functions import counts as N
from evidence_spark.functions import text as T
from evidence_spark.operators import corpus as C

WORDS = ["ara", "bél", "12.5", "한글", "🙂x𝒳", "the", "of", "x-y", "  ", "\x00\x01", "ﬁ", "a_b"]


def _texts(n, seed=6):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["", " ", "\n\n", "x"]


@pytest.mark.parametrize("chars", [1 << 20, 40, 3])
def test_counts_are_those_of_the_lines(spark, monkeypatch, chars):
    """Also of a document in several rows and of a text longer than what is counted at once."""
    monkeypatch.setattr(N, "CHARS", chars)
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(25)]), x) for x in _texts(80)] + [(7, None), (99, "many words " * 60), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).cache()
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.explode(T.char_grams(F.col("x"))).alias("g"))
    want = {(r[0], r[1]): r[2] for r in lines.groupBy("doc_id", "g.gram").agg(F.sum("g.n")).collect()}
    found = N.gram_counts(docs, "doc_id", "text")
    got = [((r.doc_id, r.gram), r.n) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan  # texts are dealt, grams are not


def test_rows_and_alphabets_too_large_for_numbers(spark, monkeypatch):
    rows = spark.createDataFrame([*enumerate(_texts(30))] + [(77, None)], "id int, text string")
    want = Counter((r[0], r[1], r[2]) for r in rows.select("id", F.explode_outer(T.char_grams(F.col("text"))).alias("g")).select("id", "g.gram", "g.n").collect())
    assert Counter(map(tuple, N.gram_rows(rows, "id", N.marked_whole(F.col("text"))).collect())) == want
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 20000))) + "".join(map(chr, range(0xAC00, 0xD7A3))) + "".join(map(chr, range(0x20000, 0x20000 + 30000)))
    (c,) = N.counted(["\x02" + many + "\x03"])
    assert dict(zip(c.strings().to_pylist(), c.n.tolist(), strict=True)) == Counter(("\x02" + many + "\x03")[i : i + k] for k in (2, 3, 4) for i in range(len(many) + 3 - k))


@pytest.mark.parametrize("model_size", [1 << 21, 40])
def test_scores_are_sums_over_known_grams(spark, monkeypatch, model_size):
    """Also where the model is sent in parts and an id has several texts; an id without a known gram has no score."""
    monkeypatch.setattr(C, "MODEL", model_size)
    rng = random.Random(3)
    train = [(x, rng.choice(["0", "1", "2", None])) for x in _texts(40, 8)] + [(None, "0")] * 2
    asked = [*enumerate(_texts(25, 9)), (3, "ara the"), (50, None), (51, "ѦѦ"), (None, "the of")]
    model = C.train_label_scorer(spark.createDataFrame(train, "text string, label string"), ["0", "1"]).cache()
    weight = defaultdict(dict)
    for r in model.collect():
        weight[r.gram][r.label] = r.weight
    texts = spark.createDataFrame(asked, "id int, text string")
    size, sums = Counter(), defaultdict(list)
    for r in texts.select("id", F.explode_outer(T.char_grams(F.col("text"))).alias("g")).select("id", "g.gram", "g.n").collect():
        size[r.id] += 1
        for label, w in weight.get(r.gram, {}).items() if r.gram else ():
            sums[r.id, label].append(r.n * w)
    want = {k: math.fsum(v) / size[k[0]] for k, v in sums.items() if k[0] is not None}
    rows = C.apply_label_scorer(model, texts, 0.05).collect()
    assert {(r.id, r.label) for r in rows} == set(want) and len(rows) == len(want)
    best = {i: max((r.score, r.label) for r in rows if r.id == i) for i in {r.id for r in rows}}
    for r in rows:
        assert abs(r.score - want[r.id, r.label]) < 2e-6
        assert r.chosen == (r.score > 0.05 or (best[r.id][0] <= 0.05 and r.label == best[r.id][1]))
