"""Nearest vectors, direction features, topic graphs, genus chains, anchors and streams against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import definitions as D
from evidence_spark.operators import learn
from evidence_spark.operators import match as M
from evidence_spark.operators import topics
from evidence_spark.operators import vectors as V
from evidence_spark.plans import job_plans as J
from evidence_spark.plans.catalog import QUERIES
from evidence_spark.plans.registry import Tables
from evidence_spark.streaming import jobs as S

SMALL = "/root/testdata/sf0.001"


def test_nearest_vectors_are_exact(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=8)).tolist(), i % 3 and 1) for i in range(900)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(6)] + [(2000, [0.0] * 8, 0), (2001, [1.0] * 8, None), (2002, [1.0] * 8, 7)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, g long").repartition(4)
    got = {(r.vec_id, r.k): (r.other, r.score) for r in V.nearest(df, "vec_id", "v", "g", 3, block=100).collect()}
    unit = {i: (np.array(v) / np.linalg.norm(v), g) for i, v, g in rows if np.linalg.norm(v) > 0 and g is not None}
    want = {}
    for i, (v, g) in unit.items():
        near = sorted((-round(float(v @ w), 6), j) for j, (w, h) in unit.items() if h == g and j != i)[:3]
        want.update({(i, k): (j, -s) for k, (s, j) in enumerate(near, 1)})
    assert got == {k: (j, pytest.approx(s, abs=2e-6)) for k, (j, s) in want.items()}
    counts = V.nearest_rows(df, "vec_id", "v", "g", 3, block=100).filter("id IS NULL").agg(F.sum("formed").alias("f"), F.sum("possible").alias("p")).first()
    assert 0 < counts.f <= counts.p


def brute_reach(edges, start, gone):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and (a, b) != gone and b not in seen:
                seen.add(b)
                todo.append(b)
    return len(seen)


def test_reach_without_the_edge(spark):
    rng = random.Random(6)
    edges = list({(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(30)} | {("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")})
    asked = [(f"{a}>{b}", a, b) for a, b in edges] + [("no", "x", "z"), ("lost", "q", "r")]
    forward = spark.createDataFrame(edges, "src string, dst string")
    got = {r.edge: (r.a_reach, r.b_reach) for r in learn.reach_without(spark.createDataFrame(asked, "edge string, a string, b string"), forward).collect()}
    assert got == {e: (brute_reach(edges, a, (a, b)), brute_reach(edges, b, (a, b))) for e, a, b in asked}


def test_direction_leaks_nothing_and_abstains(spark):
    # Whether an edge counters is a coin's throw: nothing about its ends tells.
    rng = random.Random(7)
    rows = [(f"e{i}", f"a{i % 40}", f"b{rng.randint(0, 40)}{i}", rng.random() < 0.5) for i in range(300)]
    edges = spark.createDataFrame([(*r, not r[3]) for r in rows], "edge string, a string, b string, counters boolean, forward boolean")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.lit("concept").alias("layer"), F.lit("p").alias("phrase"))
    none = nodes.select("node").limit(0)
    found = learn.direction_features(edges, nodes, none, none)
    scored = learn.suggest(learn.direction_classifier(found), found)
    assert scored.filter("relation = 'abstain'").count() > 200
    assert learn.direction_classifier(found.limit(5)) is None


def test_phrases_are_found_by_their_rarest_slice(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd한😀") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "abc"]
    phrases = sorted({t[i : i + n] for t in rng.sample(texts, 60) for i in (0, 3) for n in (1, 2, 3, 4, 5, 9)} - {""}) + ["zzzz", "zz"]
    t = spark.createDataFrame([(bytes([i % 256, i // 256]), x) for i, x in enumerate(texts)], "tid binary, t string")
    want = {(i, p) for i, x in enumerate(texts) for p in phrases if p in x}
    for block in (1 << 14, 20):
        got = M.containing(t, spark.createDataFrame([(p,) for p in phrases], "f string"), block).collect()
        assert {(r.tid[0] + 256 * r.tid[1], r.f) for r in got} == want and len(got) == len(want)


def test_topic_graph(spark):
    rows = [
        (1, "tea", "chai", "a.org", "u1", "Tea", None), (1, "tea", None, "a.org", "u1", "Tea", "Tea is a drink."), (2, "chai", None, "b.org", "u2", None, "Tea is a drink."),
        (2, "chai", None, "b.org", "u2", None, "It is hot."), (3, "salt", None, "a.org", "u3", "Salt", "Salt is white."), (4, None, "x", "a.org", "u4", "x", "lost"), (5, "chai", None, "b.org", "u5", "Late", None),
    ]
    schema = "rec int, topic string, alias string, source string, url string, title string, sentence string"
    nodes, edges = topics.topic_graph(spark.createDataFrame(rows, schema))
    fact = lambda root, s: f"fact:{root}:{hashlib.sha256(s.encode()).hexdigest()[:16]}"
    drink, hot, white = fact("chai", "Tea is a drink."), fact("chai", "It is hot."), fact("salt", "Salt is white.")
    assert {(r.node_id, r.phrase, r.source) for r in nodes.collect()} == {
        ("claim:chai", "chai", "2 sources: a.org, b.org"), ("claim:chai", "tea", "2 sources: a.org, b.org"), ("claim:salt", "salt", "1 sources: a.org"),
        (drink, "Tea is a drink.", "u1"), (hot, "It is hot.", "u2"), (white, "Salt is white.", "u3"),
        ("source:chai:a.org", "Tea", "u1"), ("source:chai:b.org", "Late", "u5"), ("source:salt:a.org", "Salt", "u3"),
    }
    found = {(r.src, r.rel, r.dst) for r in edges.collect()}
    assert ("source:chai:b.org", "proves", drink) in found and ("source:chai:a.org", "proves", drink) in found and (drink, "fulfils", "claim:chai") in found and ("claim:salt", "fulfils", "goal") in found
    # New records leave the ids of others as they are.
    more = topics.topic_graph(spark.createDataFrame([*rows, (9, "oil", "fat", "c.org", "u9", "Oil", "Oil is fat.")], schema))[1]
    assert found <= {(r.src, r.rel, r.dst) for r in more.collect()}


def test_roots_by_doubling(spark):
    rng = random.Random(3)
    parent = {f"n{i}": f"n{i + 1}" for i in range(40)} | {"x": "y", "y": "x", "z": "x", "s": "s"} | {f"m{i}": f"n{rng.randint(0, 40)}" for i in range(30)}
    want = {}
    for node in parent:
        cur, depth = node, 0
        while cur in parent and depth < 100:
            cur, depth = parent[cur], depth + 1
        if depth < 100:
            want[node] = (cur, depth)
    got = D.jump_roots(spark.createDataFrame(list(parent.items()), "node string, parent string"))
    assert {r.node: (r.root, r.depth) for r in got.collect()} == want


def test_genus_of_the_right_sense(spark):
    rows = [
        ("car", 1, "a vehicle with wheels on the road", "tea"), ("tea", 2, "a vehicle for the road", "thing"), ("tea", 3, "leaves in hot water", "drink"),
        ("mud", 4, "unclear matter", "tea"), ("pot", 5, "vessel", "pot"), ("cup", 6, "vessel", "pot"),
    ]
    df = spark.createDataFrame([(*r, "o", False) for r in rows], "word string, sense int, definition string, genus string, object string, is_action boolean")
    got = {r.word: (r.genus, r.genus_sense, r.root, r.depth) for r in D.build_genus_chain(df).collect()}
    assert got == {"car": ("tea", 2, "thing", 2), "tea": ("thing", None, "thing", 1), "mud": (None, None, "mud", 0), "pot": (None, None, "pot", 0), "cup": ("pot", 5, "pot", 1)}


def test_idle_sessions_go(spark):
    start = datetime(2024, 1, 1)
    turn = lambda conv, n, hours, verdict="A", value=None: (conv, n, start + timedelta(hours=hours), "node", verdict, "slot", value)
    rows = [turn(1, i, 0.1 * i) for i in range(7)] + [turn(2, 1, 0.2, "accept", 5), turn(2, 2, 0.3, "accept", 9)] + [turn(1, 20, 10, "accept")] + [turn(3, 30, 90)]
    df = spark.createDataFrame(rows, "conv long, turn long, ts timestamp, node string, verdict string, slot string, value long")
    t = Tables(spark, SMALL)
    stream, root = J.replay(t, df, "idle", 4, "ts")
    out = J.collect_updates(t, S.stream_sessions(stream), root, "update").collect()
    closed = {(r.conv, r.session): (r.turns, r.streak, r.demoted, r.held_n, r.held_sum, r.filled_n) for r in out if r.closed}
    assert closed == {(1, 0): (7, 1, 2, 0, 0, 0), (2, 1): (2, 0, 0, 1, 5, 1), (1, 20): (1, 0, 0, 0, 0, 1)}


def test_late_changes_go_to_the_side(spark):
    t = Tables(spark, SMALL)
    out = J.as_of_stream(t, "1 hour").collect()
    from evidence_spark.plans.ledger_plans import changes

    late = [r for r in out if r.late]
    counts = defaultdict(int)
    for r in out:
        if not r.late:
            counts[r.ctx] = max(counts[r.ctx], r.changes)
    seqs = Counter(r.seq for r in changes(t).select("seq").collect())
    assert late and sum(counts.values()) + len(late) == sum(seqs.values())
    assert all(seqs[r.seq] for r in late) and len({r.seq for r in late}) == len(late)


@pytest.mark.parametrize("name", ["t2_stream_sessions", "t4_stream_unknown_counts", "t4b_stream_sliding_counts", "t4c_stream_bursts"])
def test_streams_equal_their_sql(spark, name):
    import duckdb

    from evidence_spark.plans.catalog import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    found = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(cursor.fetchall())


def test_best_senses_over_tiles_and_blocks_without_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(9)]
    weight = {t: round(rng.uniform(-0.5, 2), 3) for t in words}
    said = [(f"w{i}", f"g{i % 3}", [(t, weight[t]) for t in rng.sample(words, 4)]) for i in range(30)]
    meant = [(f"g{i % 3}", i, rng.sample(words, 3)) for i in range(60)] + [("other", 99, words)]
    want = {}
    for word, genus, own in said:
        sums = [(round(sum(w for t, w in own if t in terms), 6), -sense) for g, sense, terms in meant if g == genus]
        want[word] = [(-sense, s) for s, sense in sorted(sums, reverse=True)[:2] if s > 0]
    for name, value in (("SENSE_TILE", 4), ("WORD_BLOCK", 3), ("CHUNK", 2)):
        monkeypatch.setattr(D, name, value)
    sizes = spark.createDataFrame([(f"g{i}", 10, 20) for i in range(3)], "genus string, asking int, senses int")
    rows = D._best_senses(
        spark.createDataFrame(said, "word string, genus string, said array<struct<t string, w double>>"), spark.createDataFrame(meant, "genus string, sense int, terms array<string>"), sizes).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-round(r.score, 6), r.genus_sense)):
        got[r.word].append((r.genus_sense, round(r.score, 6)))
    assert {w: got[w][:2] for w in want} == want
    assert len(rows) <= 30 * 2 * 5  # two for each word and tile, not one for each sense


def test_sessions_read_and_write_their_state_once_a_batch():
    import pandas as pd

    calls, stored, timers = Counter(), [], set()

    class State:
        def exists(self):
            return bool(stored)

        def get(self):
            calls["get"] += 1
            return stored[-1]

        def update(self, value):
            calls["update"] += 1
            stored.append(value)

        def clear(self):
            stored.clear()

    class Handle:
        getValueState = lambda self, name, schema: State()
        registerTimer = lambda self, at: timers.add(at)
        deleteTimer = lambda self, at: timers.remove(at)

    s = S.Sessions(3600.0)
    s.init(Handle())
    frame = lambda lo: pd.DataFrame([(lo + i, lo + i, "n", "A" if i % 2 else "accept", None if i % 3 else "s", None if i % 4 else i) for i in range(40)], columns=["at", "turn", "node", "verdict", "slot", "value"]).astype({"at": float})
    first = next(s.handleInputRows((7,), iter([frame(0)[20:], frame(0)[:20]]), None))
    assert calls == {"update": 1} and first[["turns", "held_n", "held_sum", "filled_n"]].values.tolist() == [[40, 2, 4, 1]]
    second = next(s.handleInputRows((7,), iter([frame(9000)]), None))
    assert calls == {"get": 1, "update": 2} and second["closed"].tolist() == [True, False] and second["session"].tolist() == [0, 9000]
    assert timers == {int((9039 + 3600) * 1000) + 1}
    assert next(s.handleExpiredTimer((7,), None, None))["closed"].tolist() == [True] and not stored
