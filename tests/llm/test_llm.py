"""Each operator against brute force or its library, and on nulls, empty and long texts, ties, empty tables and extra
columns with clashing names."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from evidence_spark.llm import byte_bpe, chat_collapse, cotrain, embed_forest, lang_kn, lz_fingerprint, ngram_join, packed_ids, piece_count, poisson_mix
from evidence_spark.llm.common import components
from evidence_spark.llm.queries import JSON, PIECES, QUERIES, RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id string, id string, w string"
ODD = [
    None, "", " ", "\n\t ", "a", "a b", "It's  the\n\n 12th  !!", "é́ 日本語 한글 😀 　x\x85y\x1cz", "<|endoftext|> <s> </s> <0x0A> ▁a",
    "x" * 5000, "ab " * 3000, "The same text here.", "The same text here.", " ՘࢏\U0003d001 ", "▁▁a ▁", "  a", "ab²3",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t else None, "s" if i % 2 else None, None, "x", "y", "z", "v") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[6], (None, "no id", None, None, 3, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ---- 1


def brute_join(texts, words, num, den=100):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], brute_components(len(texts), pairs)


@pytest.mark.parametrize(("words", "num"), [(4, 85), (1, 70)])
def test_ngram_join(spark, words, num):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 25))] for _ in range(25)]
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for i in range(400):
        words_of = list(rnd.choice(base)) + (passage if i % 3 == 0 else [])
        for _ in range(rnd.randint(0, 2)):
            if words_of:
                words_of[rnd.randrange(len(words_of))] = rnd.choice(vocabulary)
        texts.append(" ".join(words_of))
    sizes, least = brute_join(texts, words, num)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), words, num).collect()}
    assert got == {i: (sizes[i], least[i]) for i in range(len(texts))}


def test_ngram_join_on_odd_rows(odd, none):
    rows = ngram_join.near_duplicates(odd, 4, 85).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in texts_of(odd).elements())
    by_id = {r.doc_id: r for r in rows}
    sizes, least = brute_join(ODD, 4, 85)
    assert all((by_id[i].n_shingles, by_id[i].component_id) == (sizes[i], least[i]) for i in range(len(ODD)))
    assert by_id[None].component_id is None and by_id[12].component_id == 11
    assert ngram_join.near_duplicates(none).collect() == []


def test_light_sets_list_subsets():
    like = ngram_join.Likeness(70, 100)
    for a in range(1, 9):
        for b in range(a, 9):
            for common in range(a + 1):
                if 100 * common >= 70 * (a + b - common):
                    assert common >= like.common(a, b) and like.least(b) <= a
                    assert (a == b and like.common(a, b) == a) or {m for m, _ in like.subsets(a, 8)} >= {b}


# ---- 2


def test_embed_forest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    vectors = [(centres[i % 60] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.4])).astype(np.float32).tolist() for i in range(900)]
    vectors += [vectors[0]] * 5
    rows = [(i, v, i % 3, "x", "y") for i, v in enumerate(vectors)]
    bad = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(len(vectors) + i, v, 1, None, None) for i, v in enumerate(bad)] + [(None, vectors[1], None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, code string").repartition(3)
    got = {r.vec_id: r for r in embed_forest.near_vectors(df, leaf=64).collect()}
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.arange(len(x))[:, None] % 3 == np.arange(len(x))[None, :] % 3)
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    least = brute_components(len(x), np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == least[i] for i in range(len(x))]) > 0.98
    for i in range(len(vectors), len(rows) - 1):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embed_forest.near_vectors(df.limit(0)).collect() == []


def test_embed_forest_keeps_links_of_a_group_larger_than_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + rng.normal(size=(1000, 64)) * np.sqrt(1 / 0.95 - 1)  # pairs of the group: a cosine of about 0.95
    x = x[rng.permutation(3000)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(3)
    found = {r.vec_id: r.n_links for r in embed_forest.near_vectors(df, leaf=32).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert all(found[i] <= want[i] for i in range(3000)) and want.max() > 900
    assert sum(found.values()) >= 0.98 * want.sum()


def test_leaf_in_blocks_counts_each_pair_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, sizes, blocks = np.zeros((40, 1), np.int64), np.ones(40, np.int64), np.arange(40) % 2
    whole = embed_forest.compare(x, sizes, codes, blocks * 0, 0, False, 0.8)[0]
    parts = embed_forest.compare(x, sizes, codes, blocks, 0, True, 0.8)[0]
    for b in (0, 1):
        own = blocks == b
        parts[own] += embed_forest.compare(x[own], sizes[own], codes[own], blocks[own], 0, False, 0.8)[0]
    assert (whole == parts).all() and whole.sum() > 0


# ---- 3


def test_chat_collapse(spark):
    logs = {1: "abc", 2: "ab", 3: "a", 4: "abc", 5: "abd", 6: "x", 7: "xx", 8: "ba", 9: "b" * 700, 10: "b" * 600}
    rows = [(conv, k, "user" if k % 2 else "assistant", letter, "n", "z") for conv, said in logs.items() for k, letter in enumerate(said)]
    rows += [(11, None, None, None, "n", "z"), (11, 1, None, "", "n", "z"), (None, 0, "user", "a", "n", "z"), (12, 0, "user", "t2", "n", "z"), (12, 0, "user", "t1", "n", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, place string").repartition(4)
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_collapse.chat_texts(df).collect()}
    assert got == {1: (3, 2), 5: (3, 1), 7: (2, 1), 8: (2, 1), 9: (700, 1), 11: (2, 1), 12: (2, 1)}
    text = {r.conv_id: r.text for r in chat_collapse.chat_texts(df).collect()}
    assert text[8] == "<|assistant|>\nb<|end|>\n<|user|>\na<|end|>\n"
    assert text[11] == "<|unknown|>\n<|end|>\n" * 2 and text[12].index("t1") < text[12].index("t2")
    assert chat_collapse.chat_texts(df.limit(0)).collect() == []


# ---- 4


def test_poisson_mix(spark, odd, none):
    df = spark.createDataFrame([(i, f"s{min(i % 10, 2)}") for i in range(6000)], "doc_id long, source string")
    rows = poisson_mix.mix(df, {"s0": 1.0, "s1": 3.0}).collect()
    shares = Counter(r.source for r in rows)
    assert set(shares) == {"s0", "s1"} and abs(shares["s1"] / len(rows) - 0.75) < 0.02 and abs(len(rows) - 6000) < 400
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    copies = Counter(r.doc_id for r in rows if r.source == "s1")
    zero = 600 - len(copies)
    assert abs(np.mean(list(copies.values()) + [0] * zero) - 7.5) < 0.6 and abs(np.var(list(copies.values()) + [0] * zero) - 7.5) < 1.5
    assert sorted(map(tuple, poisson_mix.mix(odd).collect()), key=str) == sorted(map(tuple, poisson_mix.mix(odd.repartition(5)).collect()), key=str)
    assert {r.source for r in poisson_mix.mix(odd, epochs=20.0).collect()} == {None, "s"}
    assert poisson_mix.mix(none).collect() == [] and poisson_mix.mix(df, {}).collect() == []
    with pytest.raises(ValueError, match="copy"):
        poisson_mix.mix(df.withColumnRenamed("source", "copy"))


# ---- 5


def test_kneser_ney_sums_to_one():
    grams = Counter()
    for text in ("the cat and the dog", "that thing there"):
        grams.update(lang_kn.keys(lang_kn.codes(text)).view(np.int64).tolist())
    model = lang_kn.Model([("en", g, n) for g, n in grams.items()])
    letters = model.grams[1].astype(np.uint64)
    for head in [int(h) for h in model.contexts[4][:20]] + [(7 << 32) + (8 << 16) + 9]:
        p = np.exp(model.logp((np.uint64(head) << np.uint64(16)) | letters)).sum() + np.exp(model.logp(np.array([(head << 16) + 5], np.uint64)))[0, 0]
        assert abs(p - 1) < 1e-4


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_lang_kn"](spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    model = lang_kn.fit(docs.selectExpr("doc_id AS id", "lang", "text"))
    rows = lang_kn.predict(odd, model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in range(4))
    assert by_id[4].lang_pred in {"en", "de", "fr", "es"} and not by_id[4].rejected
    assert lang_kn.keep_known(docs, model).count() == docs.count()
    assert set(lang_kn.keep_known(odd, model).columns) == set(odd.columns)
    nothing = lang_kn.fit(none.selectExpr("doc_id AS id", "lang", "text"))
    assert {r.lang_pred for r in lang_kn.predict(odd, nothing).collect()} == {"und"} and lang_kn.predict(none, nothing).collect() == []


def test_language_model_has_every_sequence(spark):
    rng = np.random.default_rng(6)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9E00, 280_000)))
    rows = [(i, "zh", text[k : k + 20_000]) for i, k in enumerate(range(0, len(text), 20_000))] + [(100, "en", "the cat and the dog")]
    model = lang_kn.fit(spark.createDataFrame(rows, "id long, lang string, text string"))
    want = np.unique(np.concatenate([lang_kn.keys(lang_kn.codes(t)) for _, _, t in rows]))
    assert len(want) > 1 << 18 and model.langs == ["en", "zh"] and (model.grams[lang_kn.ORDER] == want).all()


# ---- 6


def test_fingerprints(spark, odd, none):
    def brute(text):
        known, phrase, lengths = set(), "", []
        for c in text:
            phrase += c
            if phrase not in known:
                known.add(phrase)
                lengths.append(len(phrase))
                phrase = ""
        return lz_fingerprint.signature(text, lengths)

    rows = lz_fingerprint.fingerprints(odd).collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, [-ord(c) for c in r.text or ""], r.text or "") for r in odd.collect()), key=lambda r: (r[0], r[1]), reverse=True)
    assert len(rows) == len(texts)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)
    want = Counter()
    for (there, key, _, text), (_, _, _, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[key if there else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute(text), brute(edited), lz_fingerprint.likeness(brute(text), brute(edited)), lz_fingerprint.likeness(brute(text), brute(after))] += 1
    assert got == want
    assert lz_fingerprint.fingerprints(none).collect() == []
    alone = lz_fingerprint.fingerprints(odd.filter("doc_id = 11")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# ---- 7, 8, 10


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    alphabet = list("abcdeéñßABC  \n\t'.,!?0123 ") + ["　", "\x85", "\x1c", "日本", "😀", "é", "՘", "▁", "<s>", "<0x0A>", "\xa0", "\U0003d001", " ", "'ll", "²", "_", "ﬁ", "Ω"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_byte_bpe(spark, odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.coder(RANKS, P.PATTERN)
    for text in fuzz(3000) + [t for t in ODD if t]:
        ids = coder.encode(text).tolist()
        assert ids == library.encode_ordinary(text) and b"".join(map(byte_bpe.words_of(RANKS).get, ids)) == text.encode(), repr(text)
    rows = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS)).collect()
    want = Counter()
    for (key, text), n in texts_of(odd).items():
        ids = library.encode_ordinary(text or "")
        want[key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += n
    assert Counter(map(tuple, rows)) == want
    assert byte_bpe.encode(none, RANKS, P.PATTERN).collect() == []


def test_bit_packing_round_trip():
    rng = np.random.default_rng(3)
    for bits in (1, 3, 7, 8, 13, 16, 17, 31, 32):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            data = packed_ids.pack(ids, bits)
            assert len(data) == -(-n * bits // 8) and (packed_ids.unpack(data, n, bits) == ids).all()
    assert [packed_ids.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_packed_file_random_access(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50257, int(n)).astype(np.uint32) for n in (0, 1, 40_000, 3, packed_ids.BLOCK, 17)]
    local = fs.LocalFileSystem()
    writer = packed_ids.PackWriter(local.open_output_stream(str(tmp_path / "x")), 16)
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close()
    reader = packed_ids.PackReader(local.open_input_file(str(tmp_path / "x")))
    assert all((reader.document(i) == docs[i]).all() for i in (5, 2, 0, 4, 1, 3))
    flat = np.concatenate(docs)
    assert (reader.ids(20_000, 45_000) == flat[20_000:45_000]).all() and len(flat) == reader.count


def test_packed_ids(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    coder = packed_ids.tokenizer(JSON)
    texts = fuzz(1500, 2) + [t for t in ODD if t]
    assert [a.tolist() for a in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    rows = packed_ids.packed_ids(spark, odd, JSON).collect()
    start, want = 0, []
    for key, text in sorted(texts_of(odd).elements(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert packed_ids.packed_ids(spark, none, JSON).collect() == []


def test_piece_count(odd, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = piece_count.counter(PIECES)
    for text in fuzz(3000, 3) + [" " * k for k in range(40)]:
        assert counter.count(text) == len(library.encode(text)), repr(text)
    want = Counter()
    for (key, text), n in texts_of(odd).items():
        count = len(library.encode(text or ""))
        want[key, len((text or "").encode()), count, count > 4096] += n
    assert Counter(map(tuple, piece_count.token_counts(odd, PIECES).collect())) == want
    assert piece_count.token_counts(none, PIECES).collect() == []


# ---- 9


def test_cotrain(spark, odd, none):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        good = rnd.random() < 0.7
        words = [rnd.choice(["the", "house", "stands", "over", "there", "quietly"]) for _ in range(rnd.randint(20, 60))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", "good.org" if good and rnd.random() < 0.8 else "mixed.org", len(text)))
        if i % 4 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    truth = {r[0]: r[1].islower() for r in rows}
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, marks)
    assert sum(model.added) > 0  # the views did label rows for each other
    scored = {r.doc_id: r for r in cotrain.score(docs, model).collect()}
    assert np.mean([scored[i].good == truth[i] for i in truth]) > 0.99
    assert cotrain.keep_good(docs, model).columns == docs.columns
    assert len(cotrain.score(odd, model).collect()) == odd.count() and cotrain.score(none, model).collect() == []
    blank = cotrain.fit(docs, marks.filter("quality = 1"))
    assert cotrain.keep_good(docs, blank).count() == docs.count()
    assert cotrain.fit(none, marks.limit(0)).blank


def test_cotrain_sample_is_bounded_for_hot_and_null_ids(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}", "en", "s", i) for i in range(3000)]
    rows += [(2, "text 2", "en", "s", 2)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = spark.createDataFrame([(7, 1), *((i, i // 3 % 2) for i in range(2, 1500, 3))], "doc_id long, quality int")
    monkeypatch.setattr(cotrain, "LABELLED", 100)
    monkeypatch.setattr(cotrain, "POOL", 120)
    monkeypatch.setattr(cotrain, "CoTrained", lambda *parts: parts)
    text, _, y, _, pool, _ = cotrain.fit(docs, marks)
    assert len(text) == len(y) == 100 and len(pool) == 120 and 0 < y.sum() < 100


# ---- pipeline


def test_near_duplicates_goes_by_rows_not_ids(spark):
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = text["b"] + " end"
    rows = [(1, text["a"]), (5, text["a"]), (5, text["c"]), (2, text["b"]), (2, near), (None, text["d"]), (None, text["d"]), (None, text["a"]), (None, ""), (None, ""), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert (got.pop((2, text["b"]), 0), got.pop((2, near), 0)) in {(1, 0), (0, 1)}
    assert got == Counter([(1, text["a"]), (5, text["c"]), (None, text["d"]), (None, ""), (None, ""), (7, "")])


def test_pipeline_stages_hold_their_promises(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = corpus_pipeline.language(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    junk = docs.union(spark.createDataFrame([(10_000, "123 !!", "en", "s", 6), (10_001, None, "en", "s", None)], docs.schema))
    assert {r.doc_id for r in corpus_pipeline.language(spark, junk, folder).collect()} == {r.doc_id for r in docs.collect()}
    good = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert all(i in good for i, q in labels.items() if q == 1)
    repeated = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "a b c d e f", "en", "s", 11)], docs.schema))
    one = corpus_pipeline.near_duplicates(spark, repeated, folder).collect()
    rows = docs.orderBy("doc_id").collect()
    _, least = brute_join([r.text for r in rows], 5, 80)
    assert Counter(r.doc_id for r in one) == Counter([rows[i].doc_id for i in range(len(rows)) if least[i] == i] + [None])
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_byte_bpe_round_trip_is_one_pass(spark, odd):
    both = byte_bpe.round_trip(odd, RANKS, P.PATTERN)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    steps = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS)
    rows = lambda df: Counter((r[0], tuple(r[1]), bytes(r[2])) for r in df.collect())
    assert rows(both) == rows(steps)


def test_language_is_calibrated_on_all_texts(spark):
    rows = [(i, "en" if i % 2 else "de", f"{'the stone and the river' if i % 2 else 'der Stein und das Wasser'} {'abcdefgh'[i % 8:]}") for i in range(1200)]
    model = lang_kn.fit(spark.createDataFrame(rows, "id long, lang string, text string"))
    truth, sizes, own, loss = model.against([r[1] for r in rows], [r[2] for r in rows])
    assert len(own) == 1200 and model.sharp == lang_kn.SHARP[int(np.round(loss.mean(axis=1), 9).argmin())]
    for k in range(2):
        x, n = own[truth == k], sizes[truth == k]
        mid, half = np.sort(x)[(len(x) - 1) // 2], np.sort(n)[(len(n) - 1) // 2]
        assert model.mean[k] == mid and abs(model.text_var[k] - max(1e-4, ((x - mid) ** 2)[n >= half].mean())) < 1e-9
        assert abs(model.letter_var[k] - max(0.25, ((x - mid) ** 2 * n).mean())) < 1e-9
