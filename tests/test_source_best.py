"""The best line of each source for a question: one score for each question and source of a tile leaves a task, not every pair."""

import random
from math import sqrt

from evidence_spark.functions import grams as G
from evidence_spark.operators import match as M


def test_best_by_source_is_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIR_BLOCK", 5)
    monkeypatch.setattr(M, "PAIR_BLOCKS", 2)
    rng = random.Random(11)
    words = ["ara", "bel", "cor", "dun", "한글", "eth", "fol", "gam"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(60)]
    rows = [(rng.choice(["s1", "s2", None]), x) for x in texts + texts[:20]] + [("s1", None)]
    asked = [*enumerate(texts[:23]), (50, "nothing of it"), (51, None), (7, texts[30])]
    lines = spark.createDataFrame(rows, "source string, phrase string")
    questions = spark.createDataFrame(asked, "q int, question string")
    held = M.source_lines(lines)
    got = {(r["q"], r["source"]): r["score"] for r in M.best_by_source(held, questions, 0.6).collect()}

    plain, letters = M.marked_texts(M.F.col("x"))
    every = spark.createDataFrame([(x,) for x in {*texts, "nothing of it"}], "x string")
    bags = {r["x"]: dict(zip(*(a.tolist() for a in G.bag(r["p"], r["l"])), strict=True)) for r in every.select("x", plain.alias("p"), letters.alias("l")).collect()}
    want = {}
    for q, b in asked:
        for source, a in rows:
            if a is None or b is None:
                continue
            x, y = bags[a], bags[b]
            both = x.keys() & y.keys()
            score = sqrt((sum(x[g] for g in both) / sum(x.values())) * (sum(y[g] for g in both) / sum(y.values())))
            if both and score >= 0.6:
                want[q, source] = max(score, want.get((q, source), 0.0))
    assert got == want


def test_few_rows_leave_a_task(spark, monkeypatch):
    """Near copies make as many pairs as lines x questions; groups, not pairs, set what leaves them."""
    texts = [f"the long sentence about bridges and rivers in the north x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    left = []
    monkeypatch.setattr(M, "block_tops", lambda *a: left.append(G.block_tops(*a)) or left[-1])
    held = M.source_lines(spark.createDataFrame([("s", x) for x in texts], "source string, phrase string"))
    questions = spark.createDataFrame([*enumerate(texts)], "q int, question string")
    assert M.best_by_source(held, questions, 0.7).count() == 150
    tiles = held.select("tile").distinct().count()
    assert left[0].count() == 150 * tiles < 150 * 150
