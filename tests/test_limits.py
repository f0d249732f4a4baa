"""Results are whole without limits, and ids of any type order ties."""

import pytest

from evidence_spark.operators import corpus as C
from evidence_spark.operators import graph as G
from evidence_spark.operators import ledger as L
from evidence_spark.operators import match as M
from evidence_spark.operators.matching import assign_evidence


def test_all_term_pairs_of_a_long_passage(spark):
    posts = spark.createDataFrame([(d, 0, f"t{i:02}") for d in (1, 2) for i in range(70)], "doc_id int, passage int, term string")
    assert C.cooccurrence(posts).count() == 70 * 69 // 2
    assert C.cooccurrence(posts, cap=60).count() == 60 * 59 // 2


def test_call_chains_of_any_depth(spark):
    events = spark.createDataFrame([(1, "a0", 1, {"x": "me"})], "seq int, action string, version int, roles map<string,string>")
    calls = spark.createDataFrame([(f"a{i}", 1, f"a{i + 1}", 1) for i in range(12)], "action string, version int, callee string, callee_version int")
    programs = spark.createDataFrame([("a12", 1, 1, "set", "$x", "p", "o")], "action string, version int, step int, op string, s string, p string, o string")
    assert [(r.status, r.depth, r.s) for r in L.action_effects(events, programs, calls).collect() if r.s] == [("executed", 12, "me")]
    with pytest.raises(ValueError, match="cycle"):
        L.action_effects(events, programs, spark.createDataFrame([("a0", 1, "a0", 1)], calls.schema))


def test_chain_roots_and_cycles(spark):
    parents = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(15)] + [("x", "y"), ("y", "x"), ("z", "x")], "node string, parent string")
    rows = {r.node: (r.root, r.depth) for r in G.chain_root(parents).collect()}
    assert rows == {f"n{i:02}": ("n15", 15 - i) for i in range(15)}


def test_matching_is_whole(spark):
    pairs = spark.createDataFrame([(1, f"e{i}", f"r{j}") for i in range(6) for j in range(6) if j <= i], "graph_id int, ev string, req string")
    reqs = pairs.select("graph_id", "req").distinct()
    assert assign_evidence(pairs, reqs, reqs.limit(0)).count() == 6


def test_evidence_by_string_ids(spark):
    utterances = spark.createDataFrame([(1, "the long alias and the other one")], "u int, text string")
    aliases = spark.createDataFrame([("b", "long alias"), ("a", "long alias"), ("c", "other")], "node string, alias string")
    assert M.evidence_join(utterances, aliases).first().node == "a"
    assert [(r.node, r["round"]) for r in M.multi_evidence_join(utterances, aliases).orderBy("round").collect()] == [("a", 0), ("c", 1)]
    pairs = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 1.0)], "a string, b string, score double")
    assert [(r.a, r.b) for r in M.mutual_best(pairs).collect()] == [("a", "x")]


def test_routing_scores_equal_the_gram_join(spark):
    lines = spark.createDataFrame([("s", f"n{i % 3}", f"line number {i} about tea and {w}") for i, w in enumerate(["milk", "sugar", "milk", "water", "honey"])] + [("s", "n9", "tea")], "source string, node string, phrase string")
    asked = spark.createDataFrame([(1, "tea and milk", 1.0), (1, "about sugar", 0.9), (2, "tea and honey with something much longer", 1.0)], "q int, fragment string, weight double")
    got = {(r.q, r.node): r.score for r in M.top_nodes(lines, asked, 9).collect()}
    pairs = M.coverage_pairs(lines, "phrase", asked, "fragment", 0.0, prefix=False).select("it", "ot", M.geometric().alias("s"))
    joined = M.attach(M.attach(pairs, "it", lines, "phrase", ["node", "phrase"]), "ot", asked, "fragment", ["q", "fragment", "weight"])
    want = {}
    for r in joined.collect():
        s = 0.0 if len(r.phrase) < 8 and len(r.fragment) > 2 * len(r.phrase) else r.s * r.weight
        want[r.q, r.node] = max(want.get((r.q, r.node), 0.0), s)
    assert got == want
