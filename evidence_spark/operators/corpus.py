"""Corpus to graph: passages, claims, concepts, co-occurrence, corroboration, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counts import gram_rows, marked_whole, weighed
from ..session import materialize
from . import match as M
from .fixpoint import union_all


def pairs_within(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b) with a < b for terms of the same small group (an order's parts, a passage's capped terms)."""
    other = items.select(*keys, F.col("term").alias("b"))
    return items.select(*keys, F.col("term").alias("a")).join(other, list(keys)).filter("a < b")


def split_passages(docs: DataFrame, min_len: int = 40) -> DataFrame:
    """(doc_id, loc, heading, body): sections under headings if a document has at least two, else paragraphs of at
    least ``min_len`` characters.  A document is one row, so its sections are cut inside the row."""
    heads = F.regexp_count("text", F.lit(r"(?m)^#{1,6} +\S"))
    paragraphs = F.transform(F.split("text", r"\n[ \t]*\n"), lambda p, i: F.struct(
        (i + 1).alias("loc"), F.lit(None).cast("string").alias("heading"), T.one_space(p).alias("body")))
    paragraphs = F.filter(paragraphs, lambda x: F.length(x["body"]) >= min_len)
    sections = F.transform(F.slice(F.split("text", r"(?m)^#{1,6} +(?=\S)"), 2, 1 << 30), lambda s, i: F.struct(
        (i + 1).alias("loc"), F.trim(F.substring_index(s, "\n", 1)).alias("heading"),
        T.one_space(F.regexp_replace(s, r"(?s)^[^\n]*\n?", "")).alias("body")))
    sections = F.filter(sections, lambda x: F.length(x["body"]) > 0)
    rows = docs.select("doc_id", F.explode(F.when(heads >= 2, sections).otherwise(paragraphs)).alias("p"))
    return rows.select("doc_id", "p.loc", "p.heading", "p.body")


def read_procedures(docs: DataFrame) -> DataFrame:
    """(doc_id, path, kind, steps, n): ordered step lists of at least two items under their running heading path."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^(#{1,6}) +(.+)$", 1)
    marked = lines.withColumn("depth", F.length(head)).withColumn("title", F.regexp_extract("line", r"^#{1,6} +(.+)$", 1))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one document
    step = F.regexp_extract("line", r"^\s*(?:\d+[.)]|[-*|]) *(.+)$", 1)
    table = F.col("line").rlike(r"^\s*\|")
    for d in (1, 2, 3):
        at = F.last(F.when(F.col("depth") == d, F.struct("pos", "title")), True).over(w)
        marked = marked.withColumn(f"h{d}", at)
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    path = F.concat_ws(" > ", h1["title"], F.when(h1.isNull() | (h2["pos"] > h1["pos"]), h2["title"]), F.when(h2.isNull() | (h3["pos"] > h2["pos"]), h3["title"]))
    rows = marked.withColumn("step", step).withColumn("path", path).withColumn("kind", F.when(table, "table").otherwise("list")).filter("step <> '' AND depth = 0")
    runs = rows.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return runs.groupBy("doc_id", "path", "kind", "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("s"), F.count("*").alias("n")).filter("n >= 2").select(
        "doc_id", "path", "kind", F.transform("s", lambda x: x["step"]).alias("steps"), "n")


def extract_claims(docs: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(doc_id, loc, text, kind, review): classified sentences, once per place; pronoun-initial ones go to review."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("loc", "line"))
    s = parts.select("doc_id", "loc", F.explode(T.sentences(F.col("line"))).alias("text"))
    kinds = s.withColumn("kind", T.classify_sentence(F.col("text"), rules)).filter(F.col("kind").isNotNull())
    return kinds.withColumn("review", T.needs_review(F.col("text"))).dropDuplicates(["doc_id", "loc", "text"])


def claim_coverage(claims: DataFrame, kinds: Sequence[str], minimum: int = 3) -> DataFrame:
    """Counts by kind per document and whether its claims suffice."""
    ok = claims.filter("NOT review")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    return ok.groupBy("doc_id").agg(F.count("*").alias("claims"), *counts).withColumn("sufficient", F.col("claims") >= minimum)


def claims_to_graph(claims: DataFrame) -> DataFrame:
    """(doc_id, src, rel, dst, loc, kind): evidence proves concept, concept fulfils the document's goal."""
    cid = F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("loc").cast("string"), "text"), 256), 1, 16))
    goal = F.concat(F.lit("doc_"), F.col("doc_id"))
    two = F.array(F.struct(F.concat(F.lit("e_"), cid).alias("src"), F.lit("proves").alias("rel"), cid.alias("dst")),
                  F.struct(cid.alias("src"), F.lit("fulfils").alias("rel"), goal.alias("dst")))
    return claims.filter("NOT review").select("doc_id", "loc", "kind", F.explode(two).alias("e")).select("doc_id", "e.src", "e.rel", "e.dst", "loc", "kind")


def add_verified(text_claims: DataFrame, external: DataFrame, kinds: Sequence[str], minimum: float = 0.70) -> DataFrame:
    """Text claims and external ones with confidence >= ``minimum``; a kind that is not allowed goes to review."""
    ext = external.withColumn("status", F.when(~F.col("kind").isin(list(kinds)), "review").when(F.col("confidence") >= minimum, "claim"))
    return text_claims.withColumn("status", F.lit("claim")).unionByName(ext.filter(F.col("status").isNotNull()), allowMissingColumns=True)


def concept_stats(postings: DataFrame, titles: DataFrame, min_freq: int = 2, min_weight: float = 10.0) -> DataFrame:
    """(term, freq, doc_count, weight, titled) from postings(doc_id, passage, term): one row per passage and term."""
    n_docs = postings.agg(F.count_distinct("doc_id").alias("n_docs"))  # one row
    per_doc = postings.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    stats = per_doc.groupBy("term").agg(F.sum("n").alias("freq"), F.count("*").alias("doc_count"))
    named = titles.select("term").distinct().withColumn("t", F.lit(True))
    rows = stats.join(named, "term", "left").join(F.broadcast(n_docs)).withColumn("titled", F.coalesce("t", F.lit(False)))
    raw = F.col("freq") * F.log(F.col("n_docs") / F.col("doc_count") + 1) * (1.0 + 0.12 * F.greatest(F.length("term") - 2, F.lit(0)))
    rows = rows.withColumn("weight", F.round(raw, 1))
    keep = ((F.col("freq") >= min_freq) | F.col("titled")) & ((F.col("weight") >= min_weight) | F.col("titled"))
    return rows.filter(keep).select("term", "freq", "doc_count", "weight", "titled")


def cooccurrence(postings: DataFrame, min_count: int = 2, cap: int | None = None) -> DataFrame:
    """(a, b, n): term pairs of the same passage, seen at least ``min_count`` times; with ``cap`` over at most so many terms
    of a passage, in alphabetical order."""
    terms = postings.select("doc_id", "passage", "term").distinct()
    if cap is not None:
        w = Window.partitionBy("doc_id", "passage").orderBy("term")
        terms = terms.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")
    pairs = pairs_within(terms, ["doc_id", "passage"])
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def suffix_hypernyms(terms: DataFrame, max_tail: int = 6) -> DataFrame:
    """(term, hypernym): the longest proper suffix (2 to 8 letters, term of at least 4) that is a term itself and
    stands alone somewhere or is more frequent.  terms(term, freq, alone)."""
    n = F.length("term")
    tails = F.transform(F.sequence(F.lit(2), F.least(n - 1, F.lit(2 + max_tail))), lambda k: F.expr("term").substr(n - k + 1, k))
    longer = terms.filter(n >= 4).select("term", "freq", F.explode(tails).alias("hyper"))
    known = terms.select(F.col("term").alias("hyper"), F.col("freq").alias("hf"), F.col("alone").alias("ha"))
    ok = longer.join(known, "hyper").filter("ha OR hf > freq")
    return ok.groupBy("term").agg(F.max_by("hyper", F.length("hyper")).alias("hypernym"))


def corroborate(evidence: DataFrame, min_sources: int = 2) -> DataFrame:
    """(topic, domains, values, denied, status) from evidence(topic, domain, value, denied).

    Covered only with enough distinct non-empty domains, one value and no denial; several values or a denial conflict.
    """
    agree = evidence.filter("NOT denied")
    # Two-level distinct counts, so a topic with a third of all rows still aggregates map-side.
    dom = agree.filter("domain <> ''").select("topic", "domain").distinct().groupBy("topic").agg(F.count("*").alias("domains"))
    val = agree.select("topic", "value").distinct().groupBy("topic").agg(F.count("*").alias("values"))
    deny = evidence.groupBy("topic").agg(F.count_if("denied").alias("denied"))
    j = deny.join(dom, "topic", "left").join(val, "topic", "left").na.fill(0, ["domains", "values"])
    status = (F.when((F.col("denied") > 0) | (F.col("values") > 1), "conflict").when(F.col("domains") >= min_sources, "covered").otherwise("missing"))
    return j.select("topic", "domains", "values", "denied", status.alias("status"))


def definitions(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, term, genus) for each match of a definition pattern with two groups."""
    hits = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hit"))
    return hits.select("doc_id", F.lower(F.regexp_extract("hit", pattern, 1)).alias("term"), F.lower(F.regexp_extract("hit", pattern, 2)).alias("genus")).filter("term <> genus").distinct()


def gather_excerpts(terms: DataFrame, sentences: DataFrame, limit: int = 8, per_passage: int = 2) -> DataFrame:
    """(term, rank, doc_id, passage, pos): sentences naming the term, definition passages first, at most
    ``per_passage`` per passage and ``limit`` per term.  sentences(doc_id, passage, pos, text, defines)."""
    words = sentences.select("doc_id", "passage", "pos", "defines", F.explode(F.array_distinct(T.content_terms(F.col("text"), 2))).alias("term"))
    hit = words.join(terms.select("term").distinct(), "term")
    inner = Window.partitionBy("term", "doc_id", "passage").orderBy("pos")
    first = hit.withColumn("k", F.row_number().over(inner)).filter(F.col("k") <= per_passage)
    outer = Window.partitionBy("term").orderBy(F.desc("defines"), "doc_id", "passage", "pos")
    return first.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= limit).select("term", "rank", "doc_id", "passage", "pos")


def excerpt_bonus(excerpt: Column, forms: Sequence[str], markers: Sequence[str]) -> tuple[Column, Column]:
    """What a wanted form and markers add to an excerpt's coverage."""
    n = sum((F.when(excerpt.contains(m), 1).otherwise(0) for m in markers), F.lit(0))
    wanted = F.coalesce(T.classify_sentence(excerpt).isin(list(forms)), F.lit(False))
    return F.when(wanted, 0.15).otherwise(0.0), 0.06 * F.least(n, F.lit(4))


def pick_excerpt(scored: DataFrame, forms: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Best excerpt per question from scored(q, excerpt_id, excerpt, coverage): coverage plus 0.15 for a wanted form and
    0.06 per marker, at most four."""
    form, marks = excerpt_bonus(F.col("excerpt"), forms, markers)
    score = F.col("coverage") + form + marks
    return scored.withColumn("score", score).groupBy("q").agg(
        F.max_by("excerpt_id", F.struct("score", (-F.col("excerpt_id")).alias("o"))).alias("excerpt_id"), F.max("score").alias("score"))


def suggest_edges(hits: DataFrame, passages: int | DataFrame, existing: DataFrame, share: float = 0.25, limit: int = 25) -> DataFrame:
    """Ranked node pairs from hits(passage, node, score): nodes hit in more than ``share`` of the passages drop out,
    passages with two to four nodes remain, a pair needs two of them; strength is the best minimum score.  A pair whose
    reverse path exists gets a cycle flag."""
    from .graph import reachable

    # Written once each: both are read several times.
    hits = materialize(hits, "edge-hits")
    total = passages.agg(F.count("*").alias("total"))
    df = hits.groupBy("node").agg(F.count("*").alias("df")).join(F.broadcast(total)).filter(F.col("df") <= F.greatest(F.col("total") * share, F.lit(1)))
    kept = hits.join(df.select("node"), "node")
    small = kept.groupBy("passage").agg(F.count("*").alias("n")).filter("n BETWEEN 2 AND 4").select("passage")
    rows = kept.join(small, "passage")
    other = rows.select("passage", F.col("node").alias("b"), F.col("score").alias("sb"))
    pairs = rows.select("passage", F.col("node").alias("a"), F.col("score").alias("sa")).join(other, "passage").filter("a < b")
    agg = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.max(F.least("sa", "sb")), 3).alias("strength"),
                                      F.min("passage").alias("receipt1"), F.max("passage").alias("receipt2")).filter("n >= 2")
    new = M.exclude_existing(agg, existing)
    top = materialize(new.orderBy(F.desc("strength"), F.desc("n"), "a", "b").limit(limit), "edges")
    back = reachable(existing, top.select(F.col("b").alias("seed"), F.col("b").alias("node")).distinct())
    loops = back.select(F.col("seed").alias("b"), F.col("node").alias("a"), F.lit(True).alias("loop"))
    return top.join(loops, ["a", "b"], "left").withColumn("cycle", F.coalesce("loop", F.lit(False))).drop("loop")


def suggest_nodes(unknown: DataFrame, threshold: float = 0.30, min_n: int = 3) -> DataFrame:
    """(cluster, times, phrasings) of unknown utterances(u, text) linked by coverage in either direction."""
    from .graph import components

    texts = unknown.groupBy(F.col("text").alias("phrase")).agg(F.count("*").alias("times"), F.min("u").alias("id"))
    asked = texts.select(F.col("phrase").alias("question"), F.col("id").alias("oid"))
    # Components only: each task returns links that connect, not every pair of a group of near copies.
    pairs = M.coverage_pairs(texts, "phrase", asked, "question", threshold, forest=True).select("it", "ot")
    left = texts.select("id", M.text_id(F.col("phrase")).alias("it"))
    right = asked.select("oid", M.text_id(F.col("question")).alias("ot"))
    links = pairs.filter("it <> ot").join(left, "it").join(right, "ot").select(F.col("id").alias("a"), F.col("oid").alias("b"))
    comp = components(links)
    sizes = texts.join(comp.withColumnRenamed("node", "id"), "id")
    return sizes.groupBy(F.col("comp").alias("cluster")).agg(F.sum("times").alias("times"), F.count("*").alias("phrasings")).filter(
        (F.col("times") >= min_n) & (F.col("phrasings") >= 2))


def margin_pick(scores: DataFrame, key: str, item: str, margin: float = 1.3) -> DataFrame:
    """(key, item): best item if its score is positive and at least ``margin`` times the runner-up's, else null."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), item)
    top = scores.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    a = top.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"),
                             F.max(F.when(F.col("rn") == 1, F.col(item))).alias(item))
    ok = (F.col("best") > 0) & (F.col("second").isNull() | (F.col("best") >= margin * F.col("second")))
    return a.select(key, F.when(ok, F.col(item)).alias(item))


def relation_evidence(sentences: DataFrame, topic: str, values: Sequence[str], actions: Sequence[str], joiners: Sequence[str], limit: int = 6) -> DataFrame:
    """(topic, id, value, rank): sentences in which the topic, then a value marker, then an action occur in one clause
    (no joiner between value and action); the first ``limit`` per topic.  sentences(topic, id, text)."""
    import re

    alt = "|".join(re.escape(v) for v in values)
    act = "|".join(re.escape(a) for a in actions)
    join = "|".join(re.escape(j) for j in joiners)
    pattern = rf"(?:{re.escape(topic)}) (.*?)(?:{alt})((?:(?!{join}).)*?)(?:{act})"
    hit = sentences.withColumn("value", F.regexp_extract("text", pattern, 1)).filter(F.col("text").rlike(pattern) & (F.trim("value") != ""))
    w = Window.partitionBy("topic").orderBy("id")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("topic", "id", F.trim("value").alias("value"), "rank")


def diversified(evidence: DataFrame, n: int) -> DataFrame:
    """(topic, place, pos): first sentence of each source, then the rest in original order, ``n`` in all."""
    first = evidence.groupBy("topic", "source").agg(F.min("pos").alias("first_pos"))
    w = Window.partitionBy("topic").orderBy("late", "pos")
    rows = evidence.join(first, ["topic", "source"]).withColumn("late", F.col("pos") > F.col("first_pos"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("topic", "source", "place", "pos", "text")


def summarise(evidence: DataFrame, n: int) -> DataFrame:
    """(topic, summary): the diversified ``n`` sentences in order."""
    rows = diversified(evidence, n)
    packed = rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("s"))  # n per topic
    return packed.select("topic", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("summary"))


def taxonomy_net(pairs: DataFrame, max_hyponyms: int = 5) -> DataFrame:
    """(hypernym, n, hyponyms): hypernyms with more than ``max_hyponyms`` are too general and dropped."""
    small = pairs.distinct().groupBy("hypernym").agg(F.count("*").alias("n")).filter(F.col("n") <= max_hyponyms)
    kept = pairs.distinct().join(small, "hypernym")
    return kept.groupBy("hypernym", "n").agg(F.array_join(F.sort_array(F.collect_list("hyponym")), ",").alias("hyponyms"))


def mine_definitions(senses: DataFrame, known: DataFrame) -> DataFrame:
    """(term, target, action): new single-word terms whose definition names something else."""
    action = F.regexp_extract("definition", r"^(\S+)", 1)
    target = F.regexp_extract("definition", r"(\S+)$", 1)
    rows = senses.select(F.col("word").alias("term"), target.alias("target"), action.alias("action"))
    ok = rows.filter("NOT term LIKE '% %' AND target <> '' AND target <> term").distinct()
    return ok.join(known.select("term").distinct(), "term", "left_anti")


def demand_terms(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, times, example): terms the corpus lacks, counted over questions(q, seq, question, answerable) that should
    have been answered, with the first such question."""
    terms = questions.filter("answerable").select("q", "seq", F.explode(F.array_distinct(T.content_terms(F.col("question"), 3))).alias("term"))
    missing = terms.join(vocab.select("term").distinct(), "term", "left_anti")
    return missing.groupBy("term").agg(F.count("*").alias("times"), F.min_by("q", "seq").alias("example"))


def import_node_link(nodes: DataFrame, links: DataFrame, max_n: int | None = None, texts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Named nodes (pos, name, texts ARRAY) with their distinct texts, and the links between them; with ``max_n`` the
    first nodes only, with ``texts`` so many texts of each."""
    kept = nodes.filter(F.col("name").isNotNull())
    kept = kept.filter(F.col("pos") < max_n) if max_n is not None else kept
    own = F.array_distinct("texts")
    kept = kept.select("pos", "name", (own if texts is None else F.slice(own, 1, texts)).alias("texts"))
    names = kept.select("name").distinct()
    edges = links.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return kept, edges


def expand_synonyms(lines: DataFrame, hypernym: DataFrame, rounds: int = 2, cap: int | None = None) -> DataFrame:
    """(node, phrase): phrases with hypernym words replaced by their hyponyms, up to ``rounds`` times; with
    ``cap`` a node that already has more phrases takes no further round.  lines(node, phrase), hypernym(lower, upper)."""
    net = hypernym.select("lower", "upper").distinct()
    all_, new = lines.select("node", "phrase").distinct(), lines.select("node", "phrase").distinct()
    for _ in range(rounds):
        if cap is not None:
            busy = all_.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > cap).select("node")
            new = new.join(busy, "node", "left_anti")
        words = new.select("node", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("upper"))
        hit = words.join(net, "upper").select("node", F.array_join(F.transform(F.split("phrase", " "), lambda w: F.when(w == F.col("upper"), F.col("lower")).otherwise(w)), " ").alias("phrase"))
        new = hit.distinct().join(all_, ["node", "phrase"], "left_anti")
        all_ = all_.unionByName(new)
    return all_


def train_label_scorer(sentences: DataFrame, labels: Sequence[str], min_df: int = 2, smooth: float = 0.5) -> DataFrame:
    """(gram, label, weight): one-vs-rest log-odds per gram from sentences(text, label); only grams in at least
    ``min_df`` sentences count."""
    g = gram_rows(sentences, "label", marked_whole(F.col("text")))
    # Written, as they are read three times and the texts behind them are long.
    counts = materialize(g.groupBy("label", "gram").agg(F.sum("n").alias("n"), F.count("*").alias("df")), "grams")
    frequent = counts.groupBy("gram").agg(F.sum("n").alias("c"), F.sum("df").alias("df")).filter(F.col("df") >= min_df)
    kept = counts.join(frequent.select("gram", "c"), "gram")
    totals = kept.groupBy("label").agg(F.sum("n").alias("cl"))
    size = frequent.agg(F.sum("c").alias("call"), F.count("*").alias("v"))  # one row
    names = sentences.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    grid = frequent.select("gram", "c").join(F.broadcast(names))
    rows = grid.join(counts.select("gram", "label", "n"), ["gram", "label"], "left").na.fill(0, ["n"]).join(F.broadcast(totals), "label").join(F.broadcast(size))
    own = (F.col("n") + smooth) / (F.col("cl") + smooth * F.col("v"))
    rest = (F.col("c") - F.col("n") + smooth) / (F.col("call") - F.col("cl") + smooth * F.col("v"))
    return rows.select("gram", "label", F.log(own / rest).alias("weight"))


#: Weights of a model that are sent to the tasks at once.
MODEL = 1 << 21


def apply_label_scorer(model: DataFrame, texts: DataFrame, threshold: float = 0.20) -> DataFrame:
    """(id, label, score, chosen): sum of weights over distinct known grams; labels above the threshold, else the best.

    Texts meet the model in tasks, a bounded part of it at a time, so no gram of a text becomes a row."""
    model = materialize(model.filter("gram IS NOT NULL AND label IS NOT NULL"), "model")
    labels = sorted(r["label"] for r in model.select("label").distinct().collect())
    parts = max(1, -(-model.count() // MODEL))
    found = []
    for k in range(parts):
        own = (model.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k) if parts > 1 else model).toArrow()
        grams, at = np.unique(own["gram"].to_numpy(), return_inverse=True)
        weight = np.full((len(grams), len(labels)), np.nan)
        weight[at, np.searchsorted(labels, own["label"].to_numpy().astype(str))] = own["weight"].to_numpy()
        if len(grams):
            rows = weighed(texts, "id", marked_whole(F.col("text")), grams.tolist(), weight)
            found.append(rows if not found else rows.withColumn("grams", F.lit(0).cast("bigint")))
    if not found:
        return texts.select("id", F.lit("").alias("label"), F.lit(0.0).alias("score"), F.lit(False).alias("chosen")).limit(0)
    each = lambda name: [F.sum(F.get(name, F.lit(k))).alias(f"{name}{k}") for k in range(len(labels))]
    sums = union_all(found).groupBy("id").agg(F.sum("grams").alias("grams"), *each("hits"), *each("sums")).filter("id IS NOT NULL")
    scores = F.array(*[F.when(F.col(f"hits{k}") > 0, F.struct(F.round(F.col(f"sums{k}") / F.col("grams"), 6).alias("score"), F.lit(x).alias("label"))) for k, x in enumerate(labels)])
    rows = sums.select("id", F.array_compact(scores).alias("all")).select("id", F.array_max("all").alias("top"), F.explode("all").alias("one"))
    score, high = F.col("one.score"), F.col("top.score")
    return rows.select("id", "one.label", score.alias("score"), ((score > threshold) | ((high <= threshold) & (F.col("one.label") == F.col("top.label")))).alias("chosen"))
