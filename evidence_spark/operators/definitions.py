"""Exact term lookup, including comparison questions, and the chains of genus words that definitions make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize


def definition_lookup(questions: DataFrame, defs: DataFrame) -> DataFrame:
    """(question, a, b, def_a, def_b, answered): one term, or two joined by "difference between X and Y"."""
    two = r"(?i)difference between (.+) and (.+?)[?.!]*$"
    one = r"(?i)^what (?:is|are) (.+?)[?.!]*$"
    both = F.col("question").rlike(two)
    q = questions.select("question", F.when(both, F.regexp_extract("question", two, 1)).otherwise(F.regexp_extract("question", one, 1)).alias("a"),
                         F.when(both, F.regexp_extract("question", two, 2)).alias("b"))
    key = defs.groupBy(F.lower(F.trim("term")).alias("term")).agg(F.min("definition").alias("definition"))
    j = q.join(key.select(F.col("term").alias("ka"), F.col("definition").alias("def_a")), F.lower(F.trim("a")) == F.col("ka"), "left")
    j = j.join(key.select(F.col("term").alias("kb"), F.col("definition").alias("def_b")), F.lower(F.trim("b")) == F.col("kb"), "left")
    return j.withColumn("answered", F.col("def_a").isNotNull() & (F.col("b").isNull() | F.col("def_b").isNotNull()))


#: Senses of one genus that make a tile and words with one genus that make a block, on average, and senses scored at once.
SENSE_TILE, WORD_BLOCK, CHUNK = 1 << 14, 4096, 64


def _best_senses(said: DataFrame, meant: DataFrame, sizes: DataFrame) -> DataFrame:
    """(word, genus_sense, score): for each word of said(word, genus, said: terms with their weights) the two senses of
    meant(genus, sense, terms) with the largest sums of shared weights in each tile, if positive; equal sums by sense.

    The senses of a genus are tiles and the words that have it blocks: each pair of them, sizes(genus, asking, senses) says
    how many, is one group of a task, so no pair of a word and a sense is a row, and a common genus spreads."""
    c = F.col
    kinds = dict(meant.dtypes)
    parts = lambda n, size: F.ceil(c(n) / size).cast("int")
    sizes = sizes.select("genus", parts("asking", WORD_BLOCK).alias("blocks"), parts("senses", SENSE_TILE).alias("tiles"))
    each = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), c(n)).cast("int")
    asked = said.join(sizes, "genus").select(
        "genus", each("tiles").alias("tile"), own("word", "blocks").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast(kinds["sense"]).alias("sense"), "word",
        F.transform("said", lambda x: x["t"]).alias("terms"), F.transform("said", lambda x: x["w"]).alias("weights"))
    lines = meant.join(sizes, "genus").select(
        "genus", own("sense", "tiles").alias("tile"), each("blocks").alias("block"), F.lit(1).alias("kind"), "sense", F.lit(None).cast(dict(said.dtypes)["word"]).alias("word"),
        "terms", F.lit(None).cast("array<double>").alias("weights"))
    dealt = asked.unionByName(lines).repartition("genus", "tile", "block").sortWithinPartitions("genus", "tile", "block", "kind", "sense")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        types, group, words, lists, held, rows = None, None, [], {}, None, []

        def score() -> None:
            nonlocal held
            if held is None:
                held = np.zeros((2, len(words))), np.zeros((2, len(words)), np.int64)
            found = [(k, lists[t]) for k, (_, terms) in enumerate(rows) for t in sorted(terms) if t in lists]
            if not found:
                return
            cell = np.concatenate([k * len(words) + np.array(who) for k, (who, _) in found])
            value = np.bincount(cell, np.concatenate([w for _, (_, w) in found]), len(rows) * len(words)).reshape(len(rows), -1)
            best, sense = held
            # Senses come in order, so the first of equal sums is the smallest.
            for k in np.flatnonzero(value.max(axis=1) > 0):
                first, second = value[k] > best[0], value[k] > best[1]
                best[1] = np.where(first, best[0], np.where(second, value[k], best[1]))
                sense[1] = np.where(first, sense[0], np.where(second, rows[k][0], sense[1]))
                best[0], sense[0] = np.where(first, value[k], best[0]), np.where(first, rows[k][0], sense[0])

        def out():
            if rows:
                score()
            if held is not None:
                best, sense = held
                at, col = np.nonzero(best > 0)
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in col], types[0]), pa.array(sense[at, col]).cast(types[1]), pa.array(best[at, col])], names=["word", "genus_sense", "score"])

        for batch in batches:
            types = batch["word"].type, batch["sense"].type
            for genus, tile, block, kind, sense, word, terms, weights in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group != (genus, tile, block):
                    yield from out()
                    group, words, lists, held, rows = (genus, tile, block), [], {}, None, []
                if kind == 0:
                    for t, w in zip(terms, weights, strict=True):
                        who, what = lists.setdefault(t, ([], []))
                        who.append(len(words))
                        what.append(w)
                    words.append(word)
                elif words:
                    if rows and rows[-1][0] == sense:
                        rows[-1] = sense, rows[-1][1] + terms
                        continue
                    if len(rows) >= CHUNK:
                        score()
                        rows = []
                    rows.append((sense, terms))
        yield from out()

    return dealt.mapInArrow(run, f"word {dict(said.dtypes)['word']}, genus_sense {kinds['sense']}, score double")


def genus_edges(senses: DataFrame, fillers: Sequence[str] = (), margin: float = 1.3) -> DataFrame:
    """(word, sense, genus, genus_sense, object, is_action) of each word of senses(word, sense, definition, genus, object,
    is_action), by its first sense.

    A genus with several senses means the one whose definition shares the rarest words with the definition that refers to
    it: every shared word counts ln(N / (1 + definitions with it)), and the best sum must be positive and ``margin`` times
    the next one.  A link that stays ambiguous is cut (genus null), as are those to the word itself and to ``fillers``."""
    from .corpus import margin_pick

    c = F.col
    rows = materialize(senses.filter("word IS NOT NULL AND sense IS NOT NULL"), "senses")
    terms = F.array_distinct(T.content_terms(F.coalesce("definition", F.lit("")), 3))
    total = rows.agg(F.count("*").alias("whole"))  # one row
    idf = rows.select(F.explode(terms).alias("t")).groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("t", F.log(c("whole") / (1 + c("df"))).alias("w"))
    first = rows.groupBy("word").agg(F.min_by(F.struct("sense", "genus", "object", "is_action"), "sense").alias("m")).select("word", "m.*")
    usable = c("genus").isNotNull() & (c("genus") != "") & (c("genus") != c("word"))
    if fillers:
        usable &= ~c("genus").isin(list(fillers))
    asked = first.filter(usable).select("word", "sense", "genus")
    known = rows.groupBy(c("word").alias("genus")).agg(F.count("*").alias("n"), F.min("sense").alias("only"))
    asked = materialize(asked.join(known, "genus", "left"), "genus-asked")
    several = asked.filter("n > 1")
    said = several.join(rows.select("word", "sense", F.explode(terms).alias("t")), ["word", "sense"]).join(idf, "t")
    said = said.groupBy("word", "genus").agg(F.collect_list(F.struct("t", "w")).alias("said"))
    shared = _best_senses(said, rows.select(c("word").alias("genus"), "sense", terms.alias("terms")), several.groupBy("genus").agg(F.count("*").alias("asking"), F.max("n").alias("senses")))
    picked = margin_pick(shared, "word", "genus_sense", margin).filter("genus_sense IS NOT NULL")
    linked = asked.join(picked, "word", "left").withColumn("genus_sense", F.when(c("n") > 1, c("genus_sense")).otherwise(c("only")))
    linked = linked.filter("n IS NULL OR n = 1 OR genus_sense IS NOT NULL").select("word", "genus", "genus_sense")
    return first.drop("genus").join(linked, "word", "left").select("word", "sense", "genus", "genus_sense", "object", "is_action")


def jump_roots(parents: DataFrame) -> DataFrame:
    """(node, root, depth) of parents(node, parent), one parent each: the end of every chain, by doubling: each round every
    node takes over where its own target has got to, so rounds grow with the logarithm of the longest chain.

    Nodes that run into a circle have no root.  A chain of more links holds one of just over the last round's reach, so when
    a round brings no chain to its end only circles are left."""
    c = F.col
    at = materialize(parents.select("node", c("parent").alias("cur"), F.lit(1).alias("depth"), F.lit(False).alias("done")), "roots")
    while True:
        ahead = at.select(c("node").alias("cur"), c("cur").alias("far"), c("depth").alias("more"), c("done").alias("end"))
        step = at.filter("NOT done").join(ahead, "cur", "left").select(
            "node", F.coalesce("far", "cur").alias("cur"), (c("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (c("far").isNull() | c("end")).alias("done"))
        step = materialize(step, "roots")
        ended = not step.filter("done").isEmpty()
        at = materialize(at.filter("done").unionByName(step), "roots")
        if not ended:
            return at.filter("done").select("node", c("cur").alias("root"), "depth")


def build_genus_chain(senses: DataFrame, fillers: Sequence[str] = (), margin: float = 1.3) -> DataFrame:
    """(word, genus, genus_sense, object, is_action, root, depth): ``genus_edges`` with the end of each word's chain; a word
    without a genus is its own root, one on a circle has none."""
    edges = materialize(genus_edges(senses, fillers, margin), "genus")
    ends = jump_roots(edges.filter("genus IS NOT NULL").select(F.col("word").alias("node"), F.col("genus").alias("parent")))
    out = edges.join(ends.withColumnRenamed("node", "word"), "word", "left")
    alone = F.col("genus").isNull()
    return out.select("word", "genus", "genus_sense", "object", "is_action", F.when(alone, F.col("word")).otherwise(F.col("root")).alias("root"), F.when(alone, 0).otherwise(F.col("depth")).alias("depth"))
