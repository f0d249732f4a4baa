import itertools
import random

from pyspark.sql import functions as F

from evidence_spark.operators import corpus as C
from evidence_spark.operators import graph as G
from evidence_spark.operators import rules as R
from evidence_spark.operators.matching import assign_evidence


def test_components_and_roots(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(20)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(25)]
    got = {r["node"]: r["comp"] for r in G.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in pairs:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: c for n, c in root.items() if n in linked}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "thing"), ("x", "y"), ("y", "x")], "node string, parent string")
    stop = spark.createDataFrame([("thing",)], "node string")
    assert {(r["node"], r["root"]) for r in G.chain_root(chain, stop).collect()} == {("a", "c"), ("b", "c")}


def test_matching_is_maximum(spark):
    # The greedy start gives e1 to r1; e2 only reaches r1, so an augmenting path must move e1.
    pairs = [(1, "e1", "r1"), (1, "e1", "r2"), (1, "e2", "r1"), (2, "a", "r1"), (2, "a", "r2"), (2, "a", "r3"), (2, "b", "r1"), (2, "b", "r2"), (2, "b", "r3")]
    df = spark.createDataFrame(pairs, "graph_id int, ev string, req string")
    reqs = df.select("graph_id", "req").distinct()
    got = assign_evidence(df, reqs, reqs.limit(0)).groupBy("graph_id").count().collect()
    assert {r["graph_id"]: r["count"] for r in got} == {1: 2, 2: 2}


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("c", "r", "b"), ("c", "s", "d"), ("a", "same", "d")], "src string, rel string, dst string")
    row = G.shortest_path(e, spark.createDataFrame([("a", "d")], "a string, b string"), skip=["same"]).first()
    assert row["hops"] == 3 and [p["node"] for p in row["path"]] == ["b", "c", "d"] and [p["fwd"] for p in row["path"]] == [True, False, True]


FACT = "ctx int, s string, p string, o string"
TRANS = R.Rule("t", (("?a", "p", "?b"), ("?b", "p", "?c")), ("?a", "p", "?c"))


def test_closure_cycle_denial_and_brute_force(spark):
    cyc = spark.createDataFrame([(0, "a", "p", "b"), (0, "b", "p", "c"), (0, "c", "p", "a")], FACT)
    assert R.closure(cyc, [TRANS]).count() == 9
    pq, qr = R.Rule("pq", (("?a", "p", "?b"),), ("?a", "q", "?b")), R.Rule("qr", (("?a", "q", "?b"),), ("?a", "r", "?b"))
    facts = spark.createDataFrame([(0, "x", "p", "y"), (0, "u", "p", "v")], FACT)
    got = {(r.s, r.p, r.o) for r in R.closure(facts, [pq, qr], spark.createDataFrame([(0, "x", "q", "y")], FACT)).collect()}
    assert ("x", "r", "y") not in got and ("u", "r", "v") in got
    rng = random.Random(2)
    base = {(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(8)}
    known = set(base)
    while True:
        more = {(a, d) for (a, b), (c, d) in itertools.product(known, known) if b == c} - known
        if not more:
            break
        known |= more
    rows = R.closure(spark.createDataFrame([(0, a, "p", b) for a, b in base], FACT).repartition(5), [TRANS], proofs=True).collect()
    assert {(r.s, r.o) for r in rows} == known and len(rows) == len(known)


def test_bundles_and_retraction(spark):
    facts = spark.createDataFrame([(0, "a", "p", "x", "f1"), (0, "b", "q", "x", "f2")], FACT + ", fid string")
    rules = [R.Rule("p", (("?s", "p", "?x"),), ("?x", "is", "z")), R.Rule("q", (("?s", "q", "?x"),), ("?x", "is", "z"))]
    bundles, complete = R.closure_bundles(facts, rules)
    assert bundles.filter("p = 'is'").count() == 2 and complete.first()["complete"]
    left = {(r.s, r.p): r.bundles for r in R.retract(bundles, spark.createDataFrame([("f1",)], "fid string")).collect()}
    assert left[("x", "is")] == 1 and ("a", "p") not in left
    assert not R.closure_bundles(facts, rules, proof_limit=1)[1].first()["complete"]


def test_corroboration_and_margin(spark):
    rows = [("a", "d1", "v", False), ("a", "d1", "v", False), ("b", "d1", "v", False), ("b", "d2", "v", False), ("c", "d1", "v", False), ("c", "d2", "w", False),
            ("d", "d1", "v", False), ("d", "d2", "v", False), ("d", "d3", "v", True)]
    got = {r["topic"]: r["status"] for r in C.corroborate(spark.createDataFrame(rows, "topic string, domain string, value string, denied boolean")).collect()}
    assert got == {"a": "missing", "b": "covered", "c": "conflict", "d": "conflict"}
    s = spark.createDataFrame([("a", 1, 1.3), ("a", 2, 1.0), ("b", 1, 1.29), ("b", 2, 1.0), ("c", 1, 0.0), ("c", 2, 0.0)], "k string, i int, score double")
    assert {r["k"]: r["i"] for r in C.margin_pick(s, "k", "i").collect()} == {"a": 1, "b": None, "c": None}


def test_bundles_write_each_one_once(spark, monkeypatch):
    written = []
    keep = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label="step": written.append(keep(df, label)) or written[-1])
    facts = spark.createDataFrame([(1, "s1", "supplies", "p1", "a"), (1, "p1", "is_a", "k", "b"), (1, "p1", "is_a", "k2", "c")], "ctx int, s string, p string, o string, fid string")
    rule = R.Rule("offers", (("?s", "supplies", "?p"), ("?p", "is_a", "?k")), ("?s", "offers", "?k"))
    bundles, complete = R.closure_bundles(facts, [rule])
    assert sum(df.count() for df in written) == bundles.count() == 5 and complete.count() == 1
    loop = R.Rule("trans", (("?a", "r", "?b"), ("?b", "r", "?c")), ("?a", "r", "?c"))
    ring = spark.createDataFrame([(1, x, "r", y, x + y) for x, y in ("ab", "bc", "ca")], "ctx int, s string, p string, o string, fid string")
    got = {(r.s, r.o, tuple(r.premises)) for r in R.closure_bundles(ring, [loop])[0].collect()}
    limited = {(r.s, r.o, tuple(r.premises)) for r in R.closure_bundles(ring, [loop], 1000)[0].collect()}
    assert got == limited and ("a", "a", ("ab", "bc", "ca")) in got


def test_shortest_path_grows_from_the_fewer_ends(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(f"n{rng.randint(0, 30)}", rng.choice("pq"), f"n{rng.randint(0, 30)}") for _ in range(60)], "src string, rel string, dst string")
    pairs = [(f"n{i}", b) for i in range(20) for b in ("n25", "n3")]
    seeds = []
    keep = G.frontier_loop
    monkeypatch.setattr(G, "frontier_loop", lambda start, *a, **k: seeds.append(start.count()) or keep(start, *a, **k))
    many = {(r.a, r.b): (r.hops, r.path) for r in G.shortest_path(edges, spark.createDataFrame(pairs, "a string, b string")).collect()}
    for a in ("n1", "n7"):  # one start, two targets: the other direction
        few = {(r.a, r.b): (r.hops, r.path) for r in G.shortest_path(edges, spark.createDataFrame([(a, "n25"), (a, "n3")], "a string, b string")).collect()}
        assert few == {k: v for k, v in many.items() if k[0] == a}
    assert seeds == [2, 1, 1]


def test_reaches_equals_brute_force_and_takes_stretches_as_one_step(spark, monkeypatch):
    from evidence_spark.operators import fixpoint

    rng = random.Random(5)
    for nodes, links in ((12, 10), (14, 18), (10, 30)):
        edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)} | {(100, 101), (101, 102), (102, 100), (200, 201), (201, 202)}
        names = sorted({x for e in edges for x in e} | {300})
        want = set(edges)
        while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
            want |= more
        found = G.reaches(spark.createDataFrame(list(edges), "src int, dst int"), spark.createDataFrame([(a, b) for a in names for b in names] * 2, "a int, b int"))
        assert sorted(map(tuple, found.collect())) == sorted(want)
    rounds = []
    real = fixpoint.materialize
    monkeypatch.setattr(fixpoint, "materialize", lambda df, label="step": rounds.append(label) or real(df, label))
    chain = spark.range(40).select(F.col("id").alias("hi"), (F.col("id") + 1).alias("lo"))
    asks = spark.createDataFrame([(3, 40), (40, 3), (0, 1), (7, 7), (7, 99)], "a long, b long")
    got = R.order_comparison(chain, chain.limit(0), asks).collect()
    assert {(r.a, r.b): r.taller for r in got} == {(3, 40): True, (40, 3): False, (0, 1): True, (7, 7): None, (7, 99): None}
    assert len(rounds) <= 3
