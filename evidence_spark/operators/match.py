"""Phrase matching by character-gram coverage, routing and verdicts.

Scale notes
* Equal texts are scored once: every operator works on distinct texts (128-bit text ids) and joins the
  copies back at the end, so a group of copies cannot inflate the gram join.
* ``coverage_pairs`` deals texts into tiles and blocks that meet inside tasks, where every pair is scored exactly;
  no gram and no pair below the threshold becomes a row.
* No side is broadcast by hand: Catalyst and AQE broadcast only what they measure to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.grams import best_nodes, block_best, block_pairs, block_tops, marked_texts, phrase_slices, slice_counts, slice_hits
from ..session import materialize, width
from .fixpoint import union_all


def text_id(c: Column) -> Column:
    return F.unhex(F.md5(c))


#: Outer texts that meet inner ones at once, and how many of such blocks and how many inner texts a group has at most, on average.
PAIR_BLOCK = 4096
PAIR_BLOCKS = 16
PAIR_TILE = 1 << 16


def _cells(cores: int, inner: int, outer: int) -> tuple[int, int]:
    """(tiles, blocks): as many groups as keep the cores busy and as their bounds ask for, with few copies of texts (each inner
    text is in every block and each outer one in every tile)."""
    groups = 4 * cores
    blocks = max(1, -(-outer // (PAIR_BLOCKS * PAIR_BLOCK)), min(outer, round((groups * outer / max(1, inner)) ** 0.5)))
    return max(1, -(-inner // PAIR_TILE), -(-groups // blocks)), blocks


def _once(df: DataFrame, text: str, kind: int, **extra: Column) -> DataFrame:
    """(tid, plain, letters) and ``extra``, aggregates of the rows with an inner text (column ``body``): distinct texts."""
    rows = df.filter(F.col(text).isNotNull()).withColumn("body", F.col(text)).withColumn("tid", text_id(F.col("body")))
    once = rows.groupBy("tid").agg(F.first("body").alias("body"), *[(c if kind else F.lit(None)).alias(k) for k, c in extra.items()])
    plain, letters = marked_texts(F.col("body"))
    return once.select("tid", plain.alias("plain"), letters.alias("letters"), *extra)


def _copies(others: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(name)


def _groups(dealt: DataFrame, tiles: int, blocks: int, *by: str | Column) -> DataFrame:
    # Groups are numbered, so that no task gets several of them while others have none.
    return dealt.repartitionById(tiles * blocks, F.col("tile") * blocks + F.col("block")).sortWithinPartitions("tile", "block", "kind", *by)


def _deal(inner: DataFrame, inner_text: str, outer: DataFrame, outer_text: str, **extra: Column) -> DataFrame:
    """Rows (tile, block, kind, tid, plain, letters) of distinct texts in order: each tile of inner texts (kind 1) with each
    block of outer ones (kind 0) before it.  ``extra`` are aggregates of the rows with an inner text (column ``body``)."""
    tiles, blocks = _cells(inner.sparkSession.sparkContext.defaultParallelism, inner.count(), outer.agg(F.approx_count_distinct(outer_text).alias("n")).first()["n"])

    def side(df: DataFrame, text: str, kind: int, mine: str, own: int, other: str, others: int) -> DataFrame:
        return _once(df, text, kind, **extra).select(
            F.pmod(F.xxhash64("tid"), F.lit(own)).cast("int").alias(mine), _copies(others, other), F.lit(kind).alias("kind"), "tid", "plain", "letters", *extra)

    return _groups(side(outer, outer_text, 0, "block", blocks, "tile", tiles).unionByName(side(inner, inner_text, 1, "tile", tiles, "block", blocks)), tiles, blocks)


def coverage_pairs(
    inner: DataFrame, inner_text: str, outer: DataFrame, outer_text: str, threshold: float, prefix: bool = True, score: float = 0.0, forest: bool = False
) -> DataFrame:
    """(it, ot, inner_shared, inner_total, outer_shared, outer_total) for pairs of distinct texts that share a gram.

    ``inner_shared / inner_total`` is the coverage of the inner text by the outer one and is at least
    ``threshold``; the outer counterpart comes along.  Inner texts are tiles and outer ones blocks: each pair of a tile and
    a block is one group of a task, whose grams meet in matrix products, ``PAIR_BLOCK`` outer texts at a time, and only pairs
    that reach the threshold (and the geometric ``score``) leave it.  With ``forest`` only so many of them leave as connect the same texts, without the outer
    counterpart; components stay whole.  ``prefix`` is kept for callers and changes nothing."""
    return block_pairs(_deal(inner, inner_text, outer, outer_text), PAIR_BLOCK, threshold, score, forest)


def best_covered(lines: DataFrame, text: str, key: str, questions: DataFrame, threshold: float, form: Column | None = None, marks: Column | None = None) -> DataFrame:
    """(q, key, coverage, score): for each of questions(q, question) the line with the best coverage by it, if any reaches
    ``threshold``, plus what ``form`` and ``marks`` (of the text) add; equal scores by the smaller ``key``, a whole number.
    No pair of texts becomes a row: a task returns one line for each question of its block."""
    zero = F.lit(0.0)
    of = lambda c: F.first(zero if c is None else c)
    dealt = _deal(lines, text, questions, "question", id=F.min(F.col(key).cast("bigint")), form=of(form), marks=of(marks))
    found = block_best(dealt, PAIR_BLOCK, threshold)
    best = found.groupBy("ot").agg(F.max(F.struct("score", (-F.col("id")).alias("less"), "coverage")).alias("m"))
    best = best.select("ot", (-F.col("m.less")).alias(key), "m.coverage", "m.score")
    return attach(best, "ot", questions, "question", ["q"])


def coverage() -> Column:
    return F.col("inner_shared") / F.col("inner_total")


def geometric() -> Column:
    return F.sqrt((F.col("inner_shared") / F.col("inner_total")) * (F.col("outer_shared") / F.col("outer_total")))


def attach(pairs: DataFrame, side: str, df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Replace a text id of ``pairs`` by the rows that carry that text."""
    rows = df.select(*keys, text_id(F.col(text)).alias(side))
    return pairs.join(rows, side).drop(side)


def containment_join(lines: DataFrame, line_keys: Sequence[str], questions: DataFrame, threshold: float) -> DataFrame:
    """Lines (phrase) contained in questions (q, question) to at least ``threshold``, with the coverage."""
    pairs = coverage_pairs(lines, "phrase", questions, "question", threshold).select("it", "ot", coverage().alias("coverage"))
    return attach(attach(pairs, "it", lines, "phrase", line_keys), "ot", questions, "question", ["q"])


def geometric_match(lines: DataFrame, line_keys: Sequence[str], questions: DataFrame, threshold: float) -> DataFrame:
    """Lines whose geometric mean of both coverages reaches ``threshold``."""
    pairs = coverage_pairs(lines, "phrase", questions, "question", threshold * threshold, score=threshold)
    pairs = pairs.select("it", "ot", geometric().alias("score")).filter(F.col("score") >= threshold)
    return attach(attach(pairs, "it", lines, "phrase", line_keys), "ot", questions, "question", ["q"])


def source_lines(lines: DataFrame) -> DataFrame:
    """(tile, source, tid, plain, letters) of lines(source, phrase): each text of a source once, written in tiles by source, for
    ``best_by_source``."""
    rows = lines.filter("phrase IS NOT NULL").select("source", text_id(F.col("phrase")).alias("tid"), F.col("phrase").alias("body"))
    tiles = max(4 * width(lines.sparkSession), -(-rows.count() // PAIR_TILE))
    once = rows.repartitionByRange(tiles, "source", "tid").groupBy("source", "tid").agg(F.first("body").alias("body"))
    plain, letters = marked_texts(F.col("body"))
    return materialize(once.select(F.spark_partition_id().alias("tile"), "source", "tid", plain.alias("plain"), letters.alias("letters")), "lines")


def best_by_source(lines: DataFrame, questions: DataFrame, threshold: float) -> DataFrame:
    """(q, source, score): the best geometric score of each of questions(q, question) with a line of each source, if it reaches
    ``threshold``; ``lines`` come from ``source_lines``.  No pair of texts becomes a row: a task returns one score for each
    question of its blocks and source of its tile, and a tile is of one source or few."""
    tiles = lines.agg(F.max("tile").alias("n")).first()["n"]
    if tiles is None:
        return questions.select("q", F.lit("").alias("source"), F.lit(0.0).alias("score")).limit(0)
    tiles += 1
    asked = _once(questions, "question", 0)
    blocks = max(1, -(-questions.count() // (PAIR_BLOCKS * PAIR_BLOCK)))
    held = lines.select("tile", _copies(blocks, "block"), F.lit(1).alias("kind"), "tid", "plain", "letters", "source")
    block = F.pmod(F.xxhash64("tid"), F.lit(blocks)).cast("int").alias("block")
    dealt = asked.select(_copies(tiles, "tile"), block, F.lit(0).alias("kind"), "tid", "plain", "letters", F.lit(None).cast("string").alias("source")).unionByName(held)
    found = block_tops(_groups(dealt, tiles, blocks, "source", F.length("plain")), PAIR_BLOCK, threshold)
    best = found.groupBy("ot", "source").agg(F.max("score").alias("score"))
    return attach(best, "ot", questions, "question", ["q"]).groupBy("q", "source").agg(F.max("score").alias("score"))


def short_line_guard(line: Column, question: Column) -> Column:
    """A short line cannot win a question more than twice its length."""
    return ~((F.length(line) < W.SHORT_LINE) & (F.length(question) > W.LONG_QUESTION_SCALE * F.length(line)))


def build_index(lines: DataFrame, per_node: int | None = None, budget: int | None = None) -> DataFrame:
    """Index lines per source, all of them, blank and one-letter ones too; by ``priority`` at most ``per_node`` per node, then ``budget`` in all, where
    these limits are given.  Both filter a row number directly, so Spark cuts each group before the shuffle as well."""
    node = Window.partitionBy("source", "node").orderBy("priority", "ord")
    source = Window.partitionBy("source").orderBy("priority", "node", "ord")
    kept = lines
    if per_node is not None:
        kept = kept.withColumn("in_node", F.row_number().over(node)).filter(F.col("in_node") <= per_node).drop("in_node")
    if budget is not None:
        kept = kept.withColumn("line_no", F.row_number().over(source)).filter(F.col("line_no") <= budget).drop("line_no")
    return kept


def rare_words(index: DataFrame, max_sources: int = W.RARE_MAX_SOURCES, among: DataFrame | None = None) -> DataFrame:
    """(word, source): words that occur in at most ``max_sources`` sources, only those of ``among`` (word) if given."""
    owned = index.select("source", F.explode_outer(T.bare_words(F.col("phrase"))).alias("word"))
    if among is not None:
        owned = owned.join(among.select("word").distinct(), "word", "left_semi")
    owned = owned.select("source", "word").distinct()
    few = owned.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") <= max_sources)
    return owned.join(few.select("word"), "word")


#: Questions whose fragments make one inverted list, and tiles of lines for each shuffle partition.
QUERY_BLOCK = 512
TILES = 1
#: So many lines at most tell, before all lines are looked at, what score the best nodes reach at least.
FIRST_LINES = 1 << 14


def top_nodes(index: DataFrame, fragments: DataFrame, keep: int = 2, guard: bool = True, digits: int | None = None, least: float | None = None) -> DataFrame:
    """(q, source, node, score): for each question and source the ``keep`` nodes with the best line; equal scores by node.

    Lines are dealt into tiles and questions into blocks, and each pair of them is one group of a task: the block becomes
    an inverted list, the tile's lines run past it from short to long, by source.  A line first meets whole questions, by
    all grams of their fragments, and is scored only for fragments whose bound reaches the last of the best nodes so far.
    Where lines are many, a bounded part of them is looked at first: what the best nodes reach in it is where the bars of
    every tile start, so all lines are compared with almost final bars; the result is the same.  A group
    returns at most ``keep`` nodes for each question and source: if a node is among the best, it is so in the tile of its
    best line.  No question, line or score passes through the driver, and a node or source of any size spreads.

    With ``guard`` a short line does not win a much longer question; with ``digits`` scores are compared as rounded; nodes
    below ``least`` are left out."""
    plain, letters = marked_texts(F.col("phrase"))
    # Written, as lines are read up to three times and their marked texts cost most of a reading.
    lines = materialize(index.filter("phrase IS NOT NULL").select("source", "node", plain.alias("plain"), letters.alias("letters"), F.length("phrase").alias("size")), "lines")
    blocks = F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("q") / QUERY_BLOCK)).cast("int").alias("blocks")
    blocks = fragments.agg(blocks).first()["blocks"]
    bars, many = None, lines.count()
    if least is None and many > 4 * FIRST_LINES:
        part = lines.filter(F.pmod(F.xxhash64("plain", "node", "source"), F.lit(-(-many // FIRST_LINES))) == 0)
        # By source, so that a task's bars rise soon.
        first = _meet(part, fragments, keep, guard, digits, least, blocks, None, ["source"])
        bars = materialize(_ranked(first, keep).filter(F.col("rn") == keep).select("q", "source", F.col("score").alias("bar")), "bars")
    return _ranked(_meet(lines, fragments, keep, guard, digits, least, blocks, bars, ["source", "node", "plain"]), keep).drop("rn")


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("q", "source").orderBy(F.desc("score"), "node")
    return found.groupBy("q", "source", "node").agg(F.max("score").alias("score")).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= keep)


def _meet(lines: DataFrame, fragments: DataFrame, keep: int, guard: bool, digits: int | None, least: float | None, blocks: int, bars: DataFrame | None, by: list[str]) -> DataFrame:
    """The best nodes of each tile of lines (dealt ``by`` columns) and block of questions; ``bars`` (q, source, bar) to start with."""
    # Every tile builds each block's list anew, so many blocks meet few tiles: as many groups as fill the cluster.
    tiles = max(1, -(-TILES * width(lines.sparkSession) // blocks))
    kinds = dict(lines.dtypes) | {"q": dict(fragments.dtypes)["q"]}
    none = lambda c: F.lit(None).cast(kinds.get(c, "string")).alias(c)
    held = lines.select(
        F.pmod(F.xxhash64(*by), F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
        none("q"), F.lit(None).cast("double").alias("weight"), "source", "node", "plain", "letters", "size")
    of = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "q"
    plain, letters = marked_texts(F.col("fragment"))
    dealt = fragments.filter("fragment IS NOT NULL").select(*of, F.col("weight").cast("double").alias("weight"), none("source"), none("node"), plain.alias("plain"), letters.alias("letters"), F.length("fragment").alias("size")).unionByName(held)
    if bars is not None:
        dealt = dealt.unionByName(bars.select(*of, F.col("bar").alias("weight"), "source", none("node"), none("plain"), none("letters"), none("size")))
    # Groups are numbered, so that no task gets several of them while others have none.
    dealt = dealt.repartitionById(tiles * blocks, F.col("tile") * blocks + F.col("block")).sortWithinPartitions("tile", "block", "kind", "source", "size", "plain")
    return best_nodes(dealt, keep, W.SHORT_LINE if guard else 0, W.LONG_QUESTION_SCALE, ", ".join(f"{c} {k}" for c, k in (*((c, kinds[c]) for c in ("q", "source", "node")), ("score", "double"))), digits, least)


def best_partners(asked: DataFrame, q: str, text: str, lines: DataFrame, node: str, phrase: str, keep: int = 1, digits: int | None = None, least: float | None = None) -> DataFrame:
    """(q, node, score): the ``keep`` nodes of ``lines`` whose phrase is most alike each asked text, none below ``least`` if it is given; a
    text that shares no gram with any phrase has none.  No pair of texts becomes a row, and no task holds a gram."""
    index = lines.select(F.lit("").alias("source"), F.col(node).alias("node"), F.col(phrase).alias("phrase"))
    questions = asked.select(F.col(q).alias("q"), F.col(text).alias("fragment"), F.lit(1.0).alias("weight"))
    return top_nodes(index, questions, keep, guard=False, digits=digits, least=least).select("q", "node", "score")


def support_scores(best: DataFrame) -> DataFrame:
    """(q, source, pure, winner, support): best node, and the best score owned by any other node, of ``top_nodes``."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "node")))
    held = best.groupBy("q", "source").agg(ordered.alias("m"))  # two nodes of each
    at = lambda i, c: F.get(F.col("m"), F.lit(i))[c]
    return held.select("q", "source", (-at(0, "less")).alias("pure"), at(0, "node").alias("winner"), F.coalesce(-at(1, "less"), F.lit(0.0)).alias("support"))


def route(
    questions: DataFrame, fragments: DataFrame, index: DataFrame, source_lang: DataFrame, usage: DataFrame,
    threshold: float = W.ROUTE_THRESHOLD, k: int = 3,
) -> DataFrame:
    """Top ``k`` sources per question; only the pure score may answer, bonuses merely reorder."""
    index = materialize(index, "index")
    base = support_scores(top_nodes(index, fragments))
    asked = questions.select("q", T.detect_lang_script(F.col("question")).alias("q_lang"))
    langs = source_lang.agg(F.count_distinct("lang").alias("n_langs"))
    acronym = questions.select("q", F.explode_outer(F.array_distinct(
        F.regexp_extract_all("question", F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))).alias("word"))
    held = index.select("source", F.explode_outer(F.array_distinct(
        F.regexp_extract_all("phrase", F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))).alias("word")).distinct()
    exact = acronym.join(held, "word").select("q", "source").distinct().withColumn("exact", F.lit(True))
    asked_words = questions.select("q", F.explode_outer(T.bare_words(F.col("question"))).alias("word"))
    rare = asked_words.join(rare_words(index, among=asked_words), "word").groupBy("q", "source").agg(F.count("*").alias("rare"))
    foreign = (F.col("n_langs") > 1) & (F.col("q_lang") != "mixed") & (F.col("q_lang") != F.col("lang"))
    scored = (
        base.join(asked, "q").join(source_lang, "source").join(F.broadcast(langs))
        .join(exact, ["q", "source"], "left").join(rare, ["q", "source"], "left").join(usage, "source", "left")
        .withColumn("pure", F.when(foreign, F.col("pure") * W.LANGUAGE_PENALTY).otherwise(F.col("pure")))
        .withColumn("pure", F.when(F.col("exact"), 1.0).otherwise(F.col("pure")))
        .withColumn("rank", F.col("pure") + W.SUPPORT_WEIGHT * F.col("support")
                    + W.USAGE_WEIGHT * F.coalesce("usage", F.lit(0.0))
                    + W.RARE_WEIGHT * F.least(F.coalesce("rare", F.lit(0)), F.lit(W.RARE_CAP)))
    )
    w = Window.partitionBy("q").orderBy(F.desc("rank"), F.desc("pure"), F.desc("source"))
    ranked = scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return ranked.select("q", "place", "source", "pure", "support", "rank",
                         ((F.col("place") == 1) & (F.col("pure") >= threshold)).alias("answered"))


# --- evidence by substring -------------------------------------------------------------------------------

#: Phrases whose slices are looked for in one pass over the texts.
PHRASES = 1 << 14


def flat(c: Column) -> Column:
    return T.squeeze(T.mask_numbers(c))


def _by_size(rows: DataFrame) -> dict:
    """{size: sorted slices} of rows(size, gram) of one block of phrases."""
    import numpy as np

    table = rows.distinct().toArrow()
    size, gram = table["size"].to_numpy(), table["gram"].to_numpy()
    return {int(k): np.sort(gram[size == k]) for k in np.unique(size)}


def containing(texts: DataFrame, phrases: DataFrame, block: int = PHRASES) -> DataFrame:
    """(tid, f): which texts of texts(tid, t) contain which of the distinct phrases(f).

    Every phrase is looked for only in the texts that hold its rarest slice of four characters (a shorter one's whole), so
    texts are counted once and looked through once, and only such slices become rows.  The phrases are the query set: a
    block of them goes to the tasks at once."""
    blocks = max(1, -(-phrases.count() // block))
    grams = materialize(phrase_slices(phrases), "slices")
    out = []
    for k in range(blocks):
        own = grams.filter(F.pmod(F.xxhash64("f"), F.lit(blocks)) == k) if blocks > 1 else grams
        wanted = _by_size(own.select("size", "gram"))
        if not wanted:
            continue
        counts = slice_counts(texts, wanted)
        # A slice that no text holds is in no count: its phrase is in no text.
        rarest = own.join(counts, ["size", "gram"], "left").groupBy("f").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram")).alias("m"))
        rarest = materialize(rarest.filter("m.n > 0").select("f", "m.size", "m.gram"), "rarest")
        wanted = _by_size(rarest.select("size", "gram"))
        if wanted:
            near = slice_hits(texts, wanted).join(rarest, ["size", "gram"]).select("tid", "f")
            out.append(near.join(texts, "tid").filter(F.expr("contains(t, f)")).select("tid", "f"))
    return union_all(out) if out else texts.select("tid", F.col("t").alias("f")).limit(0)


def evidence_hits(utterances: DataFrame, aliases: DataFrame) -> DataFrame:
    """(u, tid, node, alias, caught, f): aliases found in the flattened utterance, whose id is ``tid``.

    An alias is looked for whole; if its last letter is Hangul and it has at least five letters, also without
    that letter."""
    texts, bodies = _flat_texts(utterances)
    return _hits(texts, bodies, aliases)


def _flat_texts(utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, tid), (tid, t)): flattened texts, each once."""
    texts = utterances.select("u", flat(F.col("text")).alias("t")).filter("t IS NOT NULL").withColumn("tid", text_id(F.col("t")))
    return texts.select("u", "tid"), materialize(texts.groupBy("tid").agg(F.first("t").alias("t")), "flat")


def _hits(texts: DataFrame, bodies: DataFrame, aliases: DataFrame) -> DataFrame:
    names = aliases.select("node", "alias", flat(F.col("alias")).alias("f")).filter(F.length("f") > 0)
    stem = names.filter((F.length("f") >= 5) & F.col("f").rlike("[가-힣]$")).select(
        "node", "alias", F.expr("substring(f, 1, length(f) - 1)").alias("f"))
    keys = materialize(names.unionByName(stem).distinct(), "aliases")
    found = containing(bodies, keys.select("f").distinct())
    longest = F.max(F.struct(F.length("f").alias("caught"), "f")).alias("m")
    hits = found.join(keys, "f").groupBy("tid", "node", "alias").agg(longest)
    return texts.join(hits, "tid").select("u", "tid", "node", "alias", F.col("m.caught").alias("caught"), F.col("m.f").alias("f"))


def evidence_join(utterances: DataFrame, aliases: DataFrame) -> DataFrame:
    """The node of the longest alias found, one per utterance; ties go to the smaller node."""
    hits = evidence_hits(utterances, aliases)
    best = hits.groupBy("u").agg(F.min_by("node", F.struct(-F.col("caught"), "node")).alias("node"), F.max("caught").alias("caught"))
    return best


def multi_evidence_join(utterances: DataFrame, aliases: DataFrame) -> DataFrame:
    """(u, node, caught, round): all evidences, longest alias first, without overlaps and each node once.

    The hits of an utterance, no more than there are aliases, come together in one row with its text: the longest one left
    is taken and its text blanked, until none is left.  Equal lengths go by the smaller node."""
    texts, bodies = _flat_texts(utterances)
    hits = _hits(texts, bodies, aliases).groupBy("tid", "u").agg(F.collect_set(F.struct("caught", "node", "f")).alias("hits"))
    kinds = dict(hits.select("u", F.col("hits")[0]["node"].alias("node")).dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for u, text, found in zip(batch["u"].to_pylist(), batch["t"].to_pylist(), batch["hits"].to_pylist(), strict=True):
                used, turn = set(), 0
                # Of one node the larger text comes first among equal lengths.
                for hit in sorted(sorted(found, key=lambda h: h["f"], reverse=True), key=lambda h: (-h["caught"], h["node"])):
                    if hit["node"] not in used and hit["f"] in text:
                        text = text.replace(hit["f"], " ")
                        used.add(hit["node"])
                        rows.append((u, hit["node"], hit["caught"], turn))
                        turn += 1
            columns = list(zip(*rows, strict=True)) or [()] * 4
            node = batch["hits"].type.value_type.field("node").type
            types = [batch["u"].type, node, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["u", "node", "caught", "round"])

    return hits.join(bodies, "tid").select("u", "t", "hits").mapInArrow(run, f"u {kinds['u']}, node {kinds['node']}, caught int, round int")


def null_contest(real: DataFrame, null: DataFrame, evidence: DataFrame, a_min: float) -> DataFrame:
    """(u, outcome): a null class wins with a strictly higher score (a counter-example also on a tie) of at
    least ``a_min``; an ordinary null does not stop an utterance that names evidence."""
    joined = real.join(null, "u", "full_outer").join(evidence.select("u").distinct().withColumn("ev", F.lit(True)), "u", "left")
    conf = F.coalesce("conf", F.lit(0.0))
    beats = (F.col("null_score") > conf) | (F.col("is_counter") & (F.col("null_score") >= conf))
    wins = F.coalesce(beats & (F.col("null_score") >= a_min), F.lit(False))
    return joined.select(
        "u", "node", "conf", "null_node", "null_score",
        F.when(wins & F.col("is_counter"), "rematch").when(wins & F.col("ev"), "evidence_kept")
        .when(wins, "B2").when(F.col("node").isNull(), "unknown").otherwise("real").alias("outcome"))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """(a, b, score) rows -> pairs in which each is the other's best; ties go to the smaller partner."""
    best_a = pairs.groupBy("a").agg(F.min_by("b", F.struct(-F.col("score"), "b")).alias("b"))
    best_b = pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("score"), "a")).alias("a"))
    return pairs.join(best_a, ["a", "b"]).join(best_b, ["a", "b"])


def exclude_existing(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected anti-join against known edges (src, dst)."""
    known = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    keyed = pairs.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    return keyed.join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")


def verdict(
    evidence: Column, claim: Column, conf: Column, null_outcome: Column, is_goal: Column, is_axiom: Column,
    reachable: Column, elsewhere: Column, is_concept: Column, countered: Column, numeric: Column, streak: Column,
    a_min: float = W.A_MIN, ok_min: float = W.OK_MIN,
) -> Column:
    """The ordered decision over already computed signals; "unknown" and "irrelevant" (B2) stay apart."""
    return (
        F.when((null_outcome == "B2") & ~evidence, "B2")
        .when(claim.isNull() | (conf < a_min), "unknown")
        .when(is_goal & ~evidence & (conf < 0.62), "unknown")
        .when(is_goal & ~evidence, "goal-claim")
        .when((conf < ok_min) & (streak >= 2), "B2")
        .when(conf < ok_min, "A")
        .when(is_axiom & ~evidence, "accept")
        .when(~evidence, "no-evidence")
        .when(numeric.isin("ambiguous", "none"), "A")
        .when(numeric == "below", "below")
        .when(reachable & countered, "accept-with-counter")
        .when(reachable, "accept")
        .when(elsewhere, "C")
        .when(is_concept, "B1")
        .otherwise("C")
    )


def calibrate(own: DataFrame, leaks: DataFrame, a_min: float = W.A_MIN) -> DataFrame:
    """One row (ok_min, a_min, n): thresholds from held-out own scores and leaked null scores.

    ``own(score)`` may be huge; the order statistic comes from an exact count per distinct rounded score, never
    from one sorted task.
    """
    hist = own.groupBy("score").agg(F.count("*").alias("n"))
    total = own.agg(F.count("*").alias("total"))
    # Distinct scores are bounded by the rounding of the scores (at most one per 1e-6).
    steps = hist.join(F.broadcast(total)).withColumn(
        "upto", F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)))
    pick = steps.filter(F.col("upto") > F.floor(F.col("total") / 20)).agg(
        F.min("score").alias("low"), F.max("total").alias("n"))
    worst = leaks.filter(F.col("score") >= a_min).agg(F.max("score").alias("leak"))
    ok = F.round(F.greatest(F.lit(0.30), F.col("low") - 0.02), 2)
    return pick.join(F.broadcast(worst)).select(
        "n", ok.alias("ok_min"),
        F.round(F.least(ok - 0.05, F.coalesce(F.col("leak") + 0.01, F.lit(a_min))), 2).alias("a_min"))


def typo_join(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, fix): the most frequent known word one edit away; a known word is no typo.

    Both sides meet on their deletion neighbourhood (the word itself and each one-letter deletion), which holds
    every pair within one edit, so there is no pairwise comparison of the vocabulary.
    """

    def deletions(c: Column) -> Column:
        drop = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(
            F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), drop))

    asked = words.select("word").distinct().join(vocab.select("word"), "word", "left_anti")
    a = asked.select("word", F.explode_outer(deletions(F.col("word"))).alias("key"))
    v = vocab.select(F.col("word").alias("fix"), "freq", F.explode_outer(deletions(F.col("word"))).alias("key"))
    near = a.join(v, "key").select("word", "fix", "freq").distinct()
    near = near.withColumn("d", F.levenshtein(F.col("word"), F.col("fix"), 1)).filter("d = 1")
    return near.groupBy("word").agg(F.max_by("fix", F.struct("freq", F.col("fix"))).alias("fix"), F.count("*").alias("options"))
