"""Routing with bars: what lines are skipped by must not change what is found."""

import numpy as np
import pytest

from evidence_spark.functions import grams
from evidence_spark.operators import match as M


def _tables(spark, seed, hangul=False):
    rng = np.random.RandomState(seed)
    letters = "abcdefg" if not hangul else "가나다각난달abc"
    word = lambda: "".join(rng.choice(list(letters), rng.randint(2, 6)))
    words = [word() for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words, n))
    lines = [(f"s{rng.randint(3)}", int(rng.randint(60)), text(rng.randint(1, 12))) for _ in range(600)]
    asked = [(q, t, w) for q in range(12) for t, w in ((text(8), 1.0), (text(3), 0.9), (text(1), 0.9))]
    return spark.createDataFrame(lines, "source string, node int, phrase string"), spark.createDataFrame(asked, "q int, fragment string, weight double")


def _rows(df):
    return sorted((r.q, r.source, r.node, r.score) for r in df.collect())


@pytest.mark.parametrize("hangul", [False, True])
@pytest.mark.parametrize("table", [1 << 24, 8])
def test_bars_of_a_part_change_no_result(spark, monkeypatch, hangul, table):
    lines, asked = _tables(spark, 5, hangul)
    monkeypatch.setattr(M, "FIRST_LINES", 1 << 20)
    monkeypatch.setattr(grams._Best, "_few", lambda *a: False)
    want = _rows(M.top_nodes(lines, asked, 2))
    monkeypatch.undo()
    monkeypatch.setattr(M, "FIRST_LINES", 100)
    monkeypatch.setattr(grams.GramTables, "TABLE", table)
    pairs, seen = grams.GramTables.pairs, []
    monkeypatch.setattr(grams.GramTables, "pairs", lambda self, texts, bar, room: seen.append(1) or pairs(self, texts, bar, room))
    assert _rows(M.top_nodes(lines, asked, 2)) == want
    block = grams.FragmentBlock([(r.q, r.weight, f"\x02{r.fragment}\x03", None, len(r.fragment)) for r in asked.collect()])
    few, every = (grams._Best(block, 2, None, {q: 0.3 for q in range(12)}) for _ in range(2))
    rows = [(r.node, f"\x02{r.phrase}\x03", None, len(r.phrase)) for r in lines.collect()]
    few.add(rows, 8, 2.0)
    every._all(rows, 8, 2.0)
    assert seen and few.found == [[x for x in held if -x[0] >= 0.3] for held in every.found]


def test_nodes_below_least_are_left_out(spark):
    lines, asked = _tables(spark, 6)
    want = [r for r in _rows(M.top_nodes(lines, asked, 2)) if r[3] >= 0.6]
    assert want and _rows(M.top_nodes(lines, asked, 2, least=0.6)) == want
