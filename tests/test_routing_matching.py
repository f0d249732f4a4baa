"""Routing with bounds and matching by disjoint paths, against plain versions."""

import random
from collections import defaultdict

import pytest

from evidence_spark.functions import grams
from evidence_spark.operators import match as M
from evidence_spark.operators import matching


def plain_bag(text):
    from collections import Counter

    bag = Counter()
    for k in (2, 3, 4):
        bag.update(text[i : i + k] for i in range(len(text) - k + 1))
    return bag


def plain_scores(lines, asked):
    """{(q, source): {node: score}} of texts that need no cleaning: single lower-case words between blanks."""
    marked = lambda t: "\x02" + t.replace(" ", "\x03\x02") + "\x03"
    out = defaultdict(dict)
    bags = [(s, n, len(p), plain_bag(marked(p))) for s, n, p in lines]
    for q, fragment, weight in asked:
        f = plain_bag(marked(fragment))
        for s, n, size, bag in bags:
            shared = f.keys() & bag.keys()
            if not shared:
                continue
            score = ((3 * sum(bag[g] for g in shared) / (3 * sum(bag.values()))) * (3 * sum(f[g] for g in shared) / (3 * sum(f.values())))) ** 0.5
            score = 0.0 if size < 8 and len(fragment) > 2.0 * size else score * weight
            out[q, s][n] = max(out[q, s].get(n, -1.0), score)
    return out


@pytest.mark.parametrize("chunk,block,dense", [(256, 512, 2048), (4, 3, 2), (7, 1, 0)])
def test_best_nodes_are_exact(spark, chunk, block, dense, monkeypatch):
    monkeypatch.setattr(grams, "CHUNK", chunk)
    monkeypatch.setattr(grams, "DENSE", dense)
    monkeypatch.setattr(M, "QUERY_BLOCK", block)
    rng = random.Random(chunk)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    lines = [(rng.choice(["s", "t", "u"]), rng.randint(1, 30), text(12)) for _ in range(300)]
    lines += [("s", 100 + i, "the very same line") for i in range(20)] + [("t", 5, "x")]
    asked = [(rng.randint(0, 9), text(9), rng.choice([1.0, 0.9])) for _ in range(25)] + [(50, "the very same line", 1.0), (51, "", 1.0)]
    index = spark.createDataFrame(lines, "source string, node long, phrase string").repartition(3)
    got = defaultdict(list)
    rows = M.top_nodes(index, spark.createDataFrame(asked, "q int, fragment string, weight double"), 2).collect()
    for r in rows:
        got[r.q, r.source].append((-r.score, r.node))
    want = {k: sorted((-s, n) for n, s in v.items())[:2] for k, v in plain_scores(lines, asked).items()}
    assert {k: [(pytest.approx(s, abs=1e-12), n) for s, n in sorted(v)] for k, v in got.items()} == want


def test_no_lines_or_questions(spark):
    index = spark.createDataFrame([], "source string, node long, phrase string")
    asked = spark.createDataFrame([(1, "a b", 1.0)], "q int, fragment string, weight double")
    assert M.top_nodes(index, asked).count() == 0
    assert M.top_nodes(spark.createDataFrame([("s", 1, "a b"), ("s", 2, None)], index.schema), asked).count() == 1
    assert M.top_nodes(spark.createDataFrame([("s", 1, "a b")], index.schema), asked.limit(0)).count() == 0


def test_large_matching_takes_few_phases(spark):
    rng = random.Random(4)
    n = 10
    pairs = list({(1, i, n + rng.randint(0, n - 1)) for i in range(n) for _ in range(2)})
    want = len(matching.match_graph([p[1:] for p in pairs]))
    phases = []
    e = spark.createDataFrame(pairs, "graph_id int, ev long, req long")
    got = matching._in_frames(e, phases).collect()
    assert len(got) == want == len({r.ev for r in got}) == len({r.req for r in got})
    assert {(1, r.ev, r.req) for r in got} <= set(pairs)
    assert len(phases) <= 6  # twice the root of n


@pytest.mark.parametrize("small", [10, 100_000])
def test_matching_of_many_graphs(spark, small):
    rng = random.Random(8)
    pairs = list({(g, f"e{rng.randint(0, 5)}", f"r{rng.randint(0, 6)}") for g in range(4) for _ in range(rng.randint(1, 12))})
    chain = [(99, f"e{i}", f"r{i}") for i in range(3)] + [(99, f"e{i}", f"r{i + 1}") for i in range(2)] + [(99, None, "r0")]
    frame = spark.createDataFrame(pairs + chain, "graph_id int, ev string, req string")
    reqs = frame.select("graph_id", "req").distinct()
    axioms = spark.createDataFrame([(3, "r1"), (3, "unknown")], "graph_id int, req string")
    got = matching.assign_evidence(frame, reqs, axioms, small=small).collect()
    by = defaultdict(list)
    for g, a, b in pairs + [c for c in chain if c[1]]:
        if (g, b) != (3, "r1"):
            by[g].append((a, b))
    sizes = {g: len(matching.match_graph(e)) + ((g == 3) and (3, "r1") in {(p[0], p[2]) for p in pairs}) for g, e in by.items()}
    count = defaultdict(int)
    for r in got:
        count[r.graph_id] += 1
    assert dict(count) == {g: n for g, n in sizes.items() if n}


def test_many_blocks_of_questions_meet_few_tiles(spark, monkeypatch):
    dealt = []
    real = M.best_nodes
    monkeypatch.setattr(M, "best_nodes", lambda rows, *a: dealt.append(rows) or real(rows, *a))
    words = ["stone", "river", "stream", "rivers", "tone", "stones", "dream", "mist"]
    asked = spark.createDataFrame([(f"{w}{k}",) for w in words for k in range(8)], "q string")
    nodes = spark.createDataFrame([(w,) for w in words], "node string")
    monkeypatch.setattr(M, "QUERY_BLOCK", 4096)
    want = M.best_partners(asked, "q", "q", nodes, "node", "node").collect()
    monkeypatch.setattr(M, "QUERY_BLOCK", 4)
    got = M.best_partners(asked, "q", "q", nodes, "node", "node").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 64
    # Each question lies in one block, which few tiles meet, or its list is built again and again.
    assert dealt[-1].filter("kind = 0").count() == 64
