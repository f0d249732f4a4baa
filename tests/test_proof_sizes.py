"""First proofs against a plain search, and what their rounds join: facts whose shapes no rule brings together do not meet."""

import hashlib
import random

from evidence_spark.operators import rules as R

FACT = "ctx int, s string, p string, o string"
TRANS = R.Rule("t", (("?a", "p", "?b"), ("?b", "p", "?c")), ("?a", "p", "?c"))
BACK = R.Rule("q", (("?a", "p", "?b"), ("?b", "q", "?a")), ("?a", "r", "k7"))


def ident(f):
    return hashlib.sha256("\x1f".join(f).encode()).hexdigest()


def first_proofs(base, rules, denied=frozenset()):
    known = {f: (0, None, []) for f in base - denied}
    for rnd in range(1, 99):
        best = {}
        for order, rule in enumerate(rules):
            for f in known:
                for g in known:
                    if rnd - 1 not in (known[f][0], known[g][0]):
                        continue
                    names = {}
                    if all((names.setdefault(t, x) if t.startswith("?") else t) == x for atom, fact in zip(rule.body, (f, g)) for t, x in zip(atom, fact)):
                        head = tuple(names.get(t, t) for t in rule.head)
                        if head not in known and head not in denied:
                            best[head] = min(best.get(head, (99,)), (order, [ident(f), ident(g)], rule.rule_id))
        if not best:
            return known
        known |= {h: (rnd, m[2], m[1]) for h, m in best.items()}


def below(known, fact):
    by_id, depth, todo = {ident(f): f for f in known}, {}, [(fact, 0)]
    while todo:
        f, d = todo.pop()
        if d >= depth.get(f, 0):
            depth[f] = d
            todo += [(by_id[i], d + 1) for i in known[f][2]]
    return depth


def test_first_proofs_and_their_sizes(spark):
    rng = random.Random(4)
    base = {(f"{rng.choice('ab')}{rng.randint(1, 5)}", "p", f"{rng.choice('abc')}{rng.randint(1, 5)}") for _ in range(11)} | {("b2", "q", "a1"), ("c1", "q", "b1")}
    denied = {rng.choice(sorted(base)), ("a1", "p", "c1")}
    facts = spark.createDataFrame([(0, *f) for f in sorted(base)], FACT)
    no = spark.createDataFrame([(0, *f) for f in sorted(denied)], FACT)
    want = first_proofs(base, [TRANS, BACK], denied)
    rows = R.closure(facts, [TRANS, BACK], no, proofs=True)
    assert {(r.s, r.p, r.o): (r.round, r.rule, r.parents) for r in rows.collect()} == want
    assert any(m[0] > 1 for m in want.values())
    sizes = {(r.s, r.p, r.o): (r.facts, r.depth) for r in R.proof_sizes(rows, rows).collect()}
    assert sizes == {f: (len(d := below(want, f)), max(d.values())) for f in want}
    got = {(r.target, r.fact): r.depth for r in R.proof(rows, rows).collect()}
    assert got == {(ident(f), ident(g)): n for f in want for g, n in below(want, f).items()}


def test_facts_that_no_rule_brings_together_are_not_joined(spark, monkeypatch):
    facts = spark.createDataFrame([(0, f"o{i}", "p", f"c{i % 3}") for i in range(9)] + [(0, f"c{i}", "p", "n1") for i in range(3)], FACT)
    joined, join = [], R.rule_body_join
    monkeypatch.setattr(R, "rule_body_join", lambda atoms, *a: joined.append([df.count() for _, df in atoms]) or join(atoms, *a))
    assert R.closure(facts, [TRANS], proofs=True).count() == 21
    assert joined == [[9, 3]]  # one round: orders with customers; nothing begins at n1


def test_many_shapes_are_not_told_apart(spark, monkeypatch):
    monkeypatch.setattr(R, "SHAPES", 3)
    chain = "abcdef"
    facts = spark.createDataFrame([(0, a, "p", b) for a, b in zip(chain, chain[1:])], FACT)
    assert R.closure(facts, [TRANS]).count() == 15
