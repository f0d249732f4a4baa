"""The trie, the FM-index and the spelling variants against brute force, and on nulls, ties, empty and long input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import fm_index, prefix_trie, spelling
from evidence_spark.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, conv string, hashes string, key string, part string, depth string"


# ---- 11


def brute_trie(convs):
    """{(depth, prefix): row} of conversations {id: turns}."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    saved, leaves = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += kids[p] == 0
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        up = min(nodes[p[:-1]]) if p else None
        out[(min(members), len(p), up, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def found_trie(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, said, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def chats(rng):
    rows = [(c, t, "user", rng.choice(["a", "bé", ""])) for c in range(60) for t in range(rng.randint(0, 9))]
    rows += [(100 + c, t, "user", "the same") for c in range(40) for t in range(6)]  # a large group of copies
    rows += [(200, None, None, None), (200, None, None, "x"), (200, 3, "user", "tie"), (200, 3, "system", "tie"), (200, 3, "user", "tie"), (None, 1, "user", "lost")]
    return rows + [(300, t, "user", f"{t} é") for t in range(700)] + [(301, t, "user", f"{t} é") for t in range(650)]


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "v", "w") for r in rows], TURNS)


@pytest.mark.parametrize("stretch", [3, 1 << 14])
def test_trie_equals_brute_force(spark, stretch, monkeypatch, tmp_path):
    monkeypatch.setattr(prefix_trie, "STRETCH_ROWS", stretch)
    rows = chats(random.Random(3))
    chat_frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found_trie(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute_trie(rebuilt(rows))


@pytest.mark.parametrize("stretch", [1, 2, 5])
def test_stretches_merge(stretch):
    """Any cut of the sorted rows into stretches gives the same sums, without Spark."""
    rng = random.Random(stretch)
    convs = {c: [("u", rng.choice("ab")) for _ in range(rng.randint(0, 6))] for c in range(50)} | {c: [("u", "a")] * 3 for c in range(50, 70)}
    rows = sorted((b"".join(hashlib.md5(t[1].encode()).digest() for t in turns), c, [len(t[1]) for t in turns]) for c, turns in convs.items())
    lcp = [-1] + [prefix_trie._common(a[0], b[0]) for a, b in zip(rows, rows[1:])] + [-1]
    whole, parts = [], []
    for size, out in ((len(rows), whole), (stretch, parts)):
        for at in range(0, len(rows), size):
            cut = rows[at : at + size]
            made = prefix_trie._stretch(np.array([r[1] for r in cut]), [r[0] for r in cut], [np.array(r[2], np.int64) for r in cut], np.array(lcp[at : at + size]), lcp[at], lcp[at + len(cut)], 0, at)
            out += pa.RecordBatch.from_arrays(made, names=prefix_trie.NAMES).to_pylist()
    merged = defaultdict(list)
    for r in parts:
        merged[r["key"] or (r["conv_id"], r["depth"], r["ends_sha256"], r["n_convs"])].append(r)
    sums = lambda rs: (min(r["conv_id"] for r in rs), rs[0]["depth"], *(sum(r[n] for r in rs) for n in ("n_convs", "n_children", "n_leaves")), sum(r["weight"] - r["plain"] for r in rs))
    assert Counter(sums(v) for v in merged.values()) == Counter(sums([r]) for r in whole)
    assert Counter(sums([r]) for r in whole) == Counter((k[0], k[1], k[3], k[4], k[5], k[6]) for k in brute_trie(convs).elements())


def test_trie_of_nothing(spark):
    rows = prefix_trie.sequences(spark.createDataFrame([], TURNS))
    assert prefix_trie.trie(rows).count() == 0
    lone = prefix_trie.trie(prefix_trie.sequences(chat_frame(spark, [(7, 0, None, None)])))
    assert found_trie(lone) == brute_trie({7: [("", "")]})


# ---- 12

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower().decode())


def brute_hits(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    out = Counter()
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out[(doc, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)))] += 1
    return out


def made_texts(rng):
    words = ["a", "B", "c9", "é", "日本", "x" * 70, "x" * 71, "ß", "ÀB"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "-", "é "]) for _ in range(n))
    items = [(i, some(rng.randint(0, 14))) for i in range(60)] + [(60, None), (61, ""), (None, some(6)), (5, some(8)), (62, "b"), (63, "unheard of here")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(150)] + [(None, some(30)), (3, some(5)), (200, None), (201, ""), (202, " .,"), (203, some(4000)), (204, "x" * 9000)]
    docs += [(300 + i, items[7][1] + " and " + items[7][1]) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("size,most,shard", [(4, 1 << 17, 1 << 20), (4, 25, 40), (10, 1 << 17, 1)])
def test_decontamination_equals_brute_force(spark, size, most, shard, monkeypatch):
    monkeypatch.setattr(fm_index, "PIECE", 300)
    docs, items = made_texts(random.Random(size))
    if size == 4:
        items = [x for x in items if x[0] != 62]
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id long, text string, items string, spans string, key string").repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, window string")
    got = fm_index.find(frame, bench, size=size, most=most).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_hits(docs, items, size)
    assert all(sum(s.word_end - s.word for s in r.spans) == r.n_hit for r in got)


def test_spans_cut_the_passage_out(spark):
    frame = spark.createDataFrame([(1, "Én, The Quick brown fox! end"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick BROWN fox")], "item_id long, text string")
    found = fm_index.find(frame, bench, size=3).join(frame, "doc_id").select("doc_id", fm_index.kept_text(F.col("text"), F.col("spans")).alias("kept"))
    assert {r.doc_id: r.kept for r in found.collect()} == {1: "Én, ! end", 2: "nothing"}


def test_index_locates_every_pattern():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 3000)
    text[-1] = 0
    index = fm_index.FmIndex(text, 4, sample=4)
    for pattern in ([1], [1, 2], [3, 3, 3], [1, 2, 3, 1, 2], [2] * 7):
        low, high = index.search(np.array([pattern]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    no_bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert fm_index.find(none, bench).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in fm_index.find(some, no_bench).collect()] == [(3, 0, [])]


# ---- 13


def is_near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(counts, least, occurrences, ratio):
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= occurrences}
    form, rows = {}, {}
    for w in n:
        near = sorted((-n[v], v) for v in n if is_near(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n[w] else None
        rows[w] = len(near)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("tile,chunk", [(1 << 15, 1 << 15), (40, 64)])
def test_variants_equal_brute_force(spark, tile, chunk, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    rng = random.Random(tile)
    words = {"".join(rng.choice("abé÷ÿ"[: rng.choice([2, 5])]) for _ in range(rng.randint(6, 10))) for _ in range(500)}
    words |= {"abcdefg" + x for x in "abcdefghijklmnopqrstuvwxyzàáâ"} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1500, "x" * 3001}
    counts = {w: rng.choice([1, 2, 2, 3, 30, 400, 9000]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(frame, tile=tile).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == brute_variants(counts, 7, 2, 10)


def test_words_are_counted_and_slipped(spark, monkeypatch):
    monkeypatch.setattr(spelling, "DISTINCT_WORDS", 5)
    rng = random.Random(9)
    docs = [(i, " ".join("".join(rng.choice("Abcé") for _ in range(rng.randint(5, 9))) for _ in range(40))) for i in range(60)]
    docs += [(None, "NullIdsWord"), (3, None), (4, ""), (5, "ÀÁÂÃÄÅÆ ßßßßßßß"), (6, "Abcdefgh1Abcdefgh_abcdefgh"), (6, "Abcdefgh")]
    want = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, word string, n string").repartition(3)
    assert {r.word: r.n for r in spelling.word_counts(frame, slip=31).collect()} == want


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(none)).count() == 0
