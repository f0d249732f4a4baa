import random
from collections import Counter

import pytest

from evidence_spark.functions.grams import bag
from evidence_spark.operators import match as M


def brute(a, b):
    g, n = bag(*a)
    h = set(bag(*b)[0].tolist())
    return sum(int(w) for x, w in zip(g.tolist(), n.tolist()) if x in h) / int(n.sum())


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_prefix_filter_is_lossless(spark, threshold):
    rng = random.Random(5)
    words = ["ara", "bel", "cor", "dun", "한글", "eth", "fol"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)] + ["ara bel"] * 20
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "line int, phrase string")
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(texts[:30])], "q int, question string")
    got = Counter((r["line"], r["q"], round(r["coverage"], 9)) for r in M.containment_join(lines, ["line"], asked, threshold).collect())
    marked = {r["phrase"]: (r["p"], r["l"]) for r in lines.select("phrase", *[c.alias(n) for c, n in zip(M.marked_texts(lines["phrase"]), "pl")]).collect()}
    want = Counter()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:30]):
            c = brute(marked[a], marked[b])
            if c >= threshold:
                want[(i, j, round(c, 9))] += 1
    assert got == want


def test_coverage_and_longest_alias(spark):
    lines = spark.createDataFrame([(1, "ab")], "line int, phrase string")
    asked = spark.createDataFrame([(7, "ab cd")], "q int, question string")
    assert M.containment_join(lines, ["line"], asked, 0.9).first()["coverage"] == 1.0
    u = spark.createDataFrame([(1, "피해근로자진술을 보면"), (2, "nothing")], "u int, text string")
    a = spark.createDataFrame([(1, "근로자진술"), (2, "피해근로자진술")], "node int, alias string")
    assert [(r["u"], r["node"]) for r in M.evidence_join(u, a).collect()] == [(1, 2)]


def test_typos(spark):
    words = spark.createDataFrame([("hause",), ("house",), ("hous",), ("zzz",)], "word string")
    vocab = spark.createDataFrame([("house", 5), ("mouse", 9), ("horse", 1)], "word string, freq int")
    assert {(r["word"], r["fix"]) for r in M.typo_join(words, vocab).collect()} == {("hause", "house"), ("hous", "house")}


def test_null_contest(spark):
    real = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.5), (3, 10, 0.5)], "u int, node int, conf double")
    null = spark.createDataFrame([(1, 20, 0.6, False), (2, 20, 0.5, True), (3, 20, 0.6, False)], "u int, null_node int, null_score double, is_counter boolean")
    ev = spark.createDataFrame([(3,)], "u int")
    got = {r["u"]: r["outcome"] for r in M.null_contest(real, null, ev, 0.45).collect()}
    assert got == {1: "B2", 2: "rematch", 3: "evidence_kept"}
