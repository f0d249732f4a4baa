import random

import pytest

from evidence_spark.functions import grams as G
from evidence_spark.operators import corpus as C
from evidence_spark.operators import match as M


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = ["ara", "bel", "cor", "dun", "한글", "eth", "fol", "gam"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(n)]


def _cover(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    plain, letters = M.marked_texts(rows["x"])
    bags = {r["x"]: G.bag(r["p"], r["l"]) for r in rows.select("x", plain.alias("p"), letters.alias("l")).collect()}

    def cover(a, b):
        (g, n), h = bags[a], set(bags[b][0].tolist())
        return sum(int(w) for x, w in zip(g.tolist(), n.tolist()) if x in h) / int(n.sum())

    return cover


def test_pairs_meet_over_many_tiles_and_blocks(spark, monkeypatch):
    """No gram becomes a row and no pair is lost when texts are dealt into small tiles and blocks; null texts link with nothing."""
    monkeypatch.setattr(M, "PAIR_BLOCK", 7)
    monkeypatch.setattr(M, "PAIR_TILE", 11)
    texts = _texts(40)
    cover = _cover(spark, texts)
    lines = spark.createDataFrame([*enumerate(texts), (98, None)], "line int, phrase string")
    asked = spark.createDataFrame([*enumerate(texts), (99, None)], "q int, question string")
    pairs = M.coverage_pairs(lines, "phrase", asked, "question", 0.8)
    got = {(r["line"], r["q"]) for r in M.attach(M.attach(pairs, "it", lines, "phrase", ["line"]), "ot", asked, "question", ["q"]).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if cover(a, b) >= 0.8}


def test_links_of_near_copies_stay_few(spark):
    """A group of near copies leaves tasks as a forest, and its cluster stays whole."""
    texts = [f"the long sentence about bridges and rivers in the north number x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["qq ww", "zz yy"]
    rows = spark.createDataFrame([*enumerate(texts)], "u int, text string")
    asked = rows.withColumnRenamed("text", "question")
    blocks = -(-len(texts) // M.PAIR_BLOCK)
    links = M.coverage_pairs(rows, "text", asked, "question", 0.8, forest=True).count()
    tiles = 4 * M.width(spark)
    assert links <= (len(texts) + tiles * len(texts)) * blocks
    assert links < M.coverage_pairs(rows, "text", asked, "question", 0.8).count()
    assert [tuple(r) for r in C.suggest_nodes(rows, 0.8).select("cluster", "times", "phrasings").collect()] == [(0, 120, 120)]


@pytest.mark.parametrize("marked", [False, True])
def test_best_covered_is_the_best_of_all_pairs(spark, monkeypatch, marked):
    """One line for each question leaves a task, not every pair above the floor; ties go to the smaller id."""
    monkeypatch.setattr(M, "PAIR_TILE", 9)
    texts = _texts(50, 5)
    cover = _cover(spark, texts)
    lines = spark.createDataFrame([(100 - i, x) for i, x in enumerate(texts)], "eid int, phrase string")
    asked = spark.createDataFrame([*enumerate(texts[:12]), (98, "none of it"), (99, None)], "q int, question string")
    bonus = M.F.when(M.F.col("body").contains("bel"), 0.15).otherwise(0.0) if marked else None
    got = {(r["q"], r["eid"], r["score"]) for r in M.best_covered(lines, "phrase", "eid", asked, 0.6, bonus).collect()}
    want = set()
    for q, b in enumerate(texts[:12]):
        found = [(cover(a, b) + (0.15 if marked and "bel" in a else 0.0), -(100 - i)) for i, a in enumerate(texts) if cover(a, b) >= 0.6]
        score, less = max(found)
        want.add((q, -less, score))
    assert got == want
