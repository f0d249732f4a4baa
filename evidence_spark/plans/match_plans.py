"""Queries for filters, joins on phrases and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import match as M
from ..session import materialize
from .registry import LINES_SQL, WS_SQL, Tables, grams_sql, query
from .text_plans import CLAUSES_SQL, LATIN_FILLERS, SENTENCES_SQL, SHELL_SQL

LINE_KEYS = ["source", "doc_id", "ord"]
LINE_GRAMS = f"""dl AS (SELECT DISTINCT phrase FROM lines), {grams_sql('lg', 'dl', 'phrase', 'phrase')},
 lt AS (SELECT phrase, sum(n)::BIGINT AS lt FROM lg GROUP BY ALL)"""
ITEM_GRAMS = f"""{grams_sql('qg', 'benchmark', 'item_id', 'text')}, qt AS (SELECT item_id, sum(n)::BIGINT AS qt FROM qg GROUP BY ALL)"""
PAIRS = """pairs AS (SELECT item_id, phrase, sum(lg.n)::BIGINT AS ls, sum(qg.n)::BIGINT AS qs FROM lg JOIN qg USING (gram) GROUP BY ALL)"""


@query("j1_containment_join", f"""WITH {LINES_SQL}, {LINE_GRAMS}, {ITEM_GRAMS}, {PAIRS}
 SELECT source, doc_id, ord, item_id AS q, ls::DOUBLE / lt AS coverage FROM pairs JOIN lt USING (phrase) JOIN lines USING (phrase)
 WHERE ls >= lt * 0.95::DOUBLE""")
def j1(t: Tables):
    return M.containment_join(t.lines(), LINE_KEYS, t.questions(), 0.95)


@query("j2_geometric_match", f"""WITH {LINES_SQL}, {LINE_GRAMS}, {ITEM_GRAMS}, {PAIRS}, s AS (
 SELECT source, doc_id, ord, item_id AS q, sqrt((ls::DOUBLE / lt) * (qs::DOUBLE / qt)) AS score
 FROM pairs JOIN lt USING (phrase) JOIN qt USING (item_id) JOIN lines USING (phrase)) SELECT * FROM s WHERE score >= 0.75""")
def j2(t: Tables):
    return M.geometric_match(t.lines(), LINE_KEYS, t.questions(), 0.75)


# --- refusals and predicates ---

_NORM = f"regexp_replace(lower(regexp_replace({{}}, '{WS_SQL}', '', 'g')), '[.!?…。！？]+$', '')".replace("{}", "@")


@query("f1_global_refusal", f"""WITH {LINES_SQL}, n AS (SELECT DISTINCT {_NORM.replace('@', 'p')} AS k FROM (
   SELECT unnest(string_split(text, chr(10))) AS p FROM benchmark))
 SELECT source, doc_id, ord, coalesce(length({_NORM.replace('@', 'phrase')}) >= 7 AND {_NORM.replace('@', 'phrase')} IN (SELECT k FROM n), FALSE) AS refused FROM lines""")
def f1(t: Tables):
    def norm(c):
        return F.regexp_replace(T.squeeze(c), "[.!?…。！？]+$", "")

    nulls = t.benchmark.select(F.explode(F.split("text", "\n")).alias("p")).select(norm(F.col("p")).alias("k")).distinct()
    lines = t.lines().withColumn("k", norm(F.col("phrase")))
    hit = lines.join(nulls.withColumn("hit", F.lit(True)), "k", "left")
    return hit.select(*LINE_KEYS, F.coalesce((F.length("k") >= 7) & F.col("hit"), F.lit(False)).alias("refused"))


@query("f2_short_line_guard", """SELECT p_partkey, NOT (length(p_name) < 8 AND length(p_name || ' ' || p_type) > 2.0 * length(p_name)) AS may_win FROM part""")
def f2(t: Tables):
    return t.part.select("p_partkey", M.short_line_guard(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")).alias("may_win"))


@query("f3_numeric_condition", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'ambiguous' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'none'
   WHEN p_partkey IS NULL THEN 'no_condition' WHEN l_quantity < p_size THEN 'below' ELSE 'met' END AS verdict
 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def f3(t: Tables):
    from ..operators.filters import numeric_condition

    qty = F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(F.col("l_returnflag") == "R", F.concat(qty, F.lit("~"), qty, F.lit(" kg")))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit("some kg"))
        .otherwise(F.concat(F.lit("about "), qty, F.lit(" kg")))
    )
    claims = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("node"), text.alias("text"))
    conds = t.part.select(F.col("p_partkey").alias("node"), F.lit("kg").alias("unit"),
                          F.col("p_size").cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    return numeric_condition(claims, conds).select("l_orderkey", "l_linenumber", "l_partkey", "verdict")


TERMS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}]+'), lambda w: length(w) >= {n})"


@query("f4_topic_related", f"""WITH tw AS (SELECT DISTINCT item_id, unnest({TERMS.format(x='text', n=6)}) AS w FROM benchmark),
  n AS (SELECT item_id, count(*) AS n FROM tw GROUP BY ALL), dw AS (SELECT DISTINCT doc_id, unnest({TERMS.format(x='text', n=6)}) AS w FROM documents)
  SELECT item_id, doc_id, count(*) AS hits FROM tw JOIN dw USING (w) JOIN n USING (item_id) GROUP BY item_id, doc_id, n HAVING count(*) >= (n + 1) // 2""")
def f4(t: Tables):
    from ..operators.filters import topic_related

    docs = t.documents.select("doc_id", F.explode(F.array_distinct(T.content_terms(F.col("text"), 6))).alias("word"))
    topics = t.benchmark.select("item_id", F.explode(F.array_distinct(T.content_terms(F.col("text"), 6))).alias("word"))
    return topic_related(topics, docs, "item_id", "doc_id")


@query("f5_usable_phrase", f"""WITH {LINES_SQL} SELECT source, doc_id, ord, NOT (regexp_matches(phrase, '^(The|In|De|La)') OR regexp_matches(phrase, '(the|la|de)[.]?$')) AS usable FROM lines""")
def f5(t: Tables):
    from ..operators.filters import usable_phrase

    return t.lines().select(*LINE_KEYS, usable_phrase(F.col("phrase"), ["The", "In", "De", "La"], ["the", "la", "de", "the.", "la.", "de."]).alias("usable"))


@query("f6_unknown_terms", f"""WITH v AS (SELECT DISTINCT unnest({TERMS.format(x='text', n=2)}) AS w FROM documents),
  q AS (SELECT DISTINCT conv_id, turn, unnest({TERMS.format(x='text', n=2)}) AS w FROM conversations),
  c AS (SELECT conv_id, turn, count(*) AS terms, count(*) FILTER (w NOT IN (SELECT w FROM v)) AS unknown FROM q GROUP BY ALL)
  SELECT conv_id, turn, terms, unknown, unknown > 0 AND (SELECT count(*) FROM v) >= 300 AND (terms <= 4 OR unknown >= 0.4 * terms) AS off_topic FROM c""")
def f6(t: Tables):
    from ..operators.filters import unknown_terms

    vocab = t.documents.select(F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("word")).distinct()
    asked = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("word"))
    return unknown_terms(asked, ["conv_id", "turn"], vocab)


# --- evidence by substring ---

_FLAT = f"lower(regexp_replace(regexp_replace(@, '\\d+(?:\\.\\d+)?', '§', 'g'), '{WS_SQL}', '', 'g'))"
EVIDENCE_SQL = f"""u AS (SELECT doc_id AS u, {_FLAT.replace('@', 'text')} AS t FROM documents),
 a AS (SELECT item_id AS node, unnest(string_split(text, chr(10))) AS alias FROM benchmark), f AS (SELECT DISTINCT node, {_FLAT.replace('@', 'alias')} AS f FROM a),
 hits AS (SELECT u, node, f, length(f) AS caught, t FROM u JOIN f ON length(f) > 0 AND contains(t, f))"""


def evidence_inputs(t: Tables):
    return (t.documents.select(F.col("doc_id").alias("u"), "text"),
            t.benchmark.select(F.col("item_id").alias("node"), F.explode(F.split("text", "\n")).alias("alias")))


@query("j3_evidence_join", f"""WITH {EVIDENCE_SQL}, r AS (SELECT u, node, caught, row_number() OVER (PARTITION BY u ORDER BY caught DESC, node) AS rn FROM hits)
 SELECT u, node, caught FROM r WHERE rn = 1""")
def j3(t: Tables):
    return M.evidence_join(*evidence_inputs(t))


# Lines of an item do not overlap one another in these texts, so the greedy choice keeps the longest line of each
# item whose text is still there after the longer choices; the SQL twin replays that with a recursive query.
@query("j4_multi_evidence_join", f"""WITH RECURSIVE {EVIDENCE_SQL},
 best(u, rest, used, node, caught, round) AS (
   SELECT u, replace(t, f, ' '), [node], node, caught, 0 FROM (
     SELECT *, row_number() OVER (PARTITION BY u ORDER BY caught DESC, node, f DESC) AS rn FROM hits) WHERE rn = 1
   UNION ALL
   SELECT u, replace(rest, f, ' '), list_append(used, node), node, caught, round + 1 FROM (
     SELECT b.u, b.rest, b.used, h.node, h.f, h.caught, b.round, row_number() OVER (PARTITION BY b.u ORDER BY h.caught DESC, h.node, h.f DESC) AS rn
     FROM best b JOIN hits h ON h.u = b.u AND NOT list_contains(b.used, h.node) AND contains(b.rest, h.f)) WHERE rn = 1)
 SELECT u, node, caught, round FROM best""")
def j4(t: Tables):
    return M.multi_evidence_join(*evidence_inputs(t))


# --- index and routing ---


def index(t: Tables) -> DataFrame:
    """Index lines of each source; documents labelled good count as evidence nodes and come first."""
    good = t.labels.filter("quality = 1").select("doc_id", F.lit(0).alias("priority"))
    lines = t.lines().join(good, "doc_id", "left").select(
        "source", F.col("doc_id").alias("node"), "ord", "phrase", F.coalesce("priority", F.lit(1)).alias("priority"))
    return M.build_index(lines)


INDEX_SQL = f"""{LINES_SQL}, idx AS (
  SELECT source, doc_id AS node, ord, phrase, CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END AS priority
  FROM lines l LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) g USING (doc_id))"""


@query("a4_build_index", f"WITH {INDEX_SQL} SELECT source, node, ord, priority, phrase FROM idx")
def a4(t: Tables):
    return index(t).select("source", "node", "ord", "priority", "phrase")


def item_fragments(t: Tables) -> DataFrame:
    return t.questions().select(
        "q", F.posexplode(T.fragments(F.col("question"), LATIN_FILLERS)).alias("pos", "fragment")
    ).select("q", "fragment", F.when(F.col("pos") == 0, 1.0).otherwise(W.FRAGMENT_WEIGHT).alias("weight"))


_BARE = r"regexp_replace(trim(text), '^((The|And|Of)\b[ ,.…·~!?]*)+', '')"
FRAG_SQL = rf"""fx AS (SELECT item_id AS q, text, {_BARE} AS rest, {CLAUSES_SQL} AS parts,
   list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\-]*'), lambda w: lower(w) NOT IN ({SHELL_SQL})) AS core FROM benchmark),
 ff AS (SELECT q, rest AS fragment, 0 AS o FROM fx WHERE rest <> trim(text) AND rest <> ''
   UNION ALL SELECT q, text, CASE WHEN rest <> trim(text) AND rest <> '' THEN 1 ELSE 0 END FROM fx
   UNION ALL SELECT q, unnest(parts), 2 FROM fx WHERE len(parts) > 1
   UNION ALL SELECT q, CASE WHEN len(core) > 0 THEN array_to_string(core, ' ') ELSE text END, 3 FROM fx),
 frag AS (SELECT q, fragment, CASE WHEN min(o) = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS weight FROM ff GROUP BY ALL)"""
SCORES_SQL = f"""{INDEX_SQL}, {FRAG_SQL}, dl AS MATERIALIZED (SELECT phrase, row_number() OVER () AS pid FROM (SELECT DISTINCT phrase FROM idx)), {grams_sql('lg', 'dl', 'pid', 'phrase')},
 lt AS (SELECT pid, sum(n)::BIGINT AS lt FROM lg GROUP BY ALL), df AS MATERIALIZED (SELECT fragment, row_number() OVER () AS fid FROM (SELECT DISTINCT fragment FROM frag)), {grams_sql('qg', 'df', 'fid', 'fragment')},
 qt AS (SELECT fid, sum(n)::BIGINT AS qt FROM qg GROUP BY ALL),
 pids AS (SELECT fid, pid, sum(lg.n)::BIGINT AS ls, sum(qg.n)::BIGINT AS qs FROM lg JOIN qg USING (gram) GROUP BY fid, pid),
 pairs AS (SELECT fragment, phrase, ls, qs, lt, qt FROM pids JOIN lt USING (pid) JOIN qt USING (fid) JOIN dl USING (pid) JOIN df USING (fid)),
 node_scores AS (SELECT q, source, node, max(CASE WHEN length(phrase) < 8 AND length(fragment) > 2.0 * length(phrase) THEN 0.0
    ELSE sqrt((ls::DOUBLE / lt) * (qs::DOUBLE / qt)) * weight END) AS score
  FROM pairs JOIN idx USING (phrase) JOIN frag USING (fragment) GROUP BY ALL),
 top2 AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, node) AS rn FROM node_scores),
 support AS (SELECT q, source, max(score) FILTER (rn = 1) AS pure, max(node) FILTER (rn = 1) AS winner,
    coalesce(max(score) FILTER (rn = 2), 0.0) AS support FROM top2 GROUP BY ALL)"""


def best_of(t: Tables, keep: int = 2) -> DataFrame:
    return M.top_nodes(index(t), item_fragments(t), keep)


@query("a2_support_score", f"WITH {SCORES_SQL} SELECT q, source, pure, winner, support FROM support")
def a2(t: Tables):
    return M.support_scores(best_of(t))


_BARE_WORDS = "regexp_extract_all({}, '[가-힣A-Za-z]{{2,6}}')"


@query("a3_rare_words", f"""WITH {INDEX_SQL}, w AS (SELECT DISTINCT source, unnest({_BARE_WORDS.format('phrase')}) AS word FROM idx),
 n AS (SELECT word FROM w GROUP BY word HAVING count(*) <= 2) SELECT word, source FROM w JOIN n USING (word)""")
def a3(t: Tables):
    return M.rare_words(index(t)).select("word", "source")


def source_languages(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    top = counts.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    return top.select("source", F.when(F.col("lang") == "en", "english").otherwise(F.col("lang")).alias("lang"))


def source_usage(t: Tables) -> DataFrame:
    """Usage of each source, from the log of documents judged good in document order."""
    from ..operators.dialogue import usage_decay

    log = t.labels.filter("quality = 1").join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("seq"), "source")
    return usage_decay(log)


USAGE_SQL = """ulog AS (SELECT source, row_number() OVER (ORDER BY doc_id) AS turn FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
 usage AS (SELECT source, pow(0.98::DOUBLE, (SELECT max(turn) FROM ulog) - max(turn)) AS usage FROM ulog GROUP BY source
   HAVING pow(0.98::DOUBLE, (SELECT max(turn) FROM ulog) - max(turn)) >= 0.02)"""
ROUTE_SQL = rf"""{SCORES_SQL}, {USAGE_SQL}, sl AS (SELECT source, CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS lang FROM (
    SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS rn FROM documents GROUP BY source, lang) WHERE rn = 1),
 rw AS (SELECT DISTINCT source, unnest({_BARE_WORDS.format('phrase')}) AS word FROM idx), rfew AS (SELECT word FROM rw GROUP BY word HAVING count(*) <= 2),
 qw AS (SELECT DISTINCT item_id AS q, unnest({_BARE_WORDS.format('text')}) AS word FROM benchmark),
 rare AS (SELECT q, source, count(*) AS rare FROM qw JOIN rw USING (word) JOIN rfew USING (word) GROUP BY ALL),
 ql AS (SELECT item_id AS q, len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\-]*')) AS w FROM benchmark),
 ac AS (SELECT DISTINCT item_id AS q, unnest(regexp_extract_all(text, '\b[A-Z]{{2,}}\b')) AS word FROM benchmark),
 al AS (SELECT DISTINCT source, unnest(regexp_extract_all(phrase, '\b[A-Z]{{2,}}\b')) AS word FROM idx), ex AS (SELECT DISTINCT q, source, TRUE AS exact FROM ac JOIN al USING (word)),
 pure AS (SELECT q, source, CASE WHEN exact THEN 1.0 WHEN (SELECT count(DISTINCT lang) FROM sl) > 1 AND w >= 2 AND lang <> 'english' THEN pure * 0.85::DOUBLE ELSE pure END AS pure,
    support, coalesce(usage, 0.0) AS usage, coalesce(rare, 0) AS rare
  FROM support JOIN sl USING (source) JOIN ql USING (q) LEFT JOIN ex USING (q, source) LEFT JOIN rare USING (q, source) LEFT JOIN usage USING (source)),
 ranked AS (SELECT *, pure + 0.12::DOUBLE * support + 0.05::DOUBLE * usage + 0.2::DOUBLE * least(rare, 3) AS rank FROM pure),
 routed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank DESC, pure DESC, source DESC) AS place FROM ranked)"""


def routed(t: Tables, k: int = 3) -> DataFrame:
    return M.route(t.questions(), item_fragments(t), index(t), source_languages(t), source_usage(t), k=k)


@query("a1_route", f"""WITH {ROUTE_SQL} SELECT q, place, source, round(pure, 6) AS pure, round(support, 6) AS support, round(rank, 6) AS rank,
 place = 1 AND pure >= 0.43 AS answered FROM routed WHERE place <= 3""")
def a1(t: Tables):
    r = routed(t)
    return r.select("q", "place", "source", *[F.round(c, 6).alias(c) for c in ("pure", "support", "rank")], "answered")


@query("w1_top_k", f"""WITH {SCORES_SQL} SELECT q, source, node, score, k FROM (
 SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, source, node) AS k FROM node_scores) WHERE k <= 5""")
def w1(t: Tables):
    w = Window.partitionBy("q").orderBy(F.desc("score"), "source", "node")
    return best_of(t, 5).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("q", "source", "node", "score", "k")


@query("j5_null_contest", f"""WITH {SCORES_SQL}, lab AS (SELECT s.*, quality, toxic FROM node_scores s JOIN labels ON doc_id = node),
 r AS (SELECT q AS u, node, score AS conf FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS rn FROM lab WHERE quality = 1 AND toxic = 0) WHERE rn = 1),
 n AS (SELECT q AS u, node AS null_node, score AS null_score, quality = 0 AND toxic = 0 AS is_counter FROM (
   SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS rn FROM lab WHERE quality = 0 OR toxic = 1) WHERE rn = 1),
 {EVIDENCE_SQL.replace('hits AS', 'eh AS')}, e AS (SELECT DISTINCT node AS u FROM eh),
 j AS (SELECT u, node, conf, null_node, null_score, is_counter, e.u IS NOT NULL AS ev FROM r FULL JOIN n USING (u) LEFT JOIN e USING (u)),
 k AS (SELECT *, coalesce((null_score > coalesce(conf, 0) OR (is_counter AND null_score >= coalesce(conf, 0))) AND null_score >= 0.45, FALSE) AS wins FROM j)
 SELECT u, node, conf, null_node, null_score, CASE WHEN wins AND is_counter THEN 'rematch' WHEN wins AND ev THEN 'evidence_kept' WHEN wins THEN 'B2'
   WHEN node IS NULL THEN 'unknown' ELSE 'real' END AS outcome FROM k""")
def j5(t: Tables):
    return null_outcomes(t)


def null_outcomes(t: Tables) -> DataFrame:
    """Documents labelled good are real nodes, toxic ones null classes, plain bad ones counter-examples."""
    labels = t.labels.withColumnRenamed("doc_id", "node")
    kind = F.when(F.expr("quality = 1 AND toxic = 0"), "real").when(F.expr("quality = 0 OR toxic = 1"), "null")
    lines = index(t).drop("source").join(labels, "node").select(kind.alias("source"), "node", "phrase").filter("source IS NOT NULL")
    best = M.top_nodes(lines, item_fragments(t), 1)
    real = best.filter("source = 'real'").select(F.col("q").alias("u"), "node", F.col("score").alias("conf"))
    counter = labels.select("node", F.expr("quality = 0 AND toxic = 0").alias("is_counter"))
    null = best.filter("source = 'null'").join(counter, "node").select(F.col("q").alias("u"), F.col("node").alias("null_node"), F.col("score").alias("null_score"), "is_counter")
    found = M.evidence_hits(*evidence_inputs(t)).select(F.col("node").alias("u"))
    return M.null_contest(real, null, found, W.A_MIN)


# --- cross-graph proposals, pairs and overlaps ---


@query("j6_mutual_best", f"""WITH d AS (SELECT conv_id * 1000 + turn AS b, text FROM conversations WHERE role = 'user'), {grams_sql('ag', 'benchmark', 'item_id', 'text')}, {grams_sql('bg', 'd', 'b', 'text')},
 atot AS (SELECT item_id, sum(n)::BIGINT AS ta FROM ag GROUP BY ALL), bt AS (SELECT b, sum(n)::BIGINT AS tb FROM bg GROUP BY ALL),
 p AS (SELECT item_id AS a, b, sum(ag.n)::BIGINT AS sa, sum(bg.n)::BIGINT AS sb FROM ag JOIN bg USING (gram) GROUP BY ALL),
 s AS (SELECT a, b, sqrt((sa::DOUBLE / ta) * (sb::DOUBLE / tb)) AS score FROM p JOIN atot ON a = item_id JOIN bt USING (b)),
 k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM s WHERE score >= 0.6)
 SELECT a, b, score FROM k WHERE ra = 1 AND rb = 1""")
def j6(t: Tables):
    turns = t.user_turns().select((F.col("conv_id") * 1000 + F.col("turn")).alias("b"), F.col("text").alias("question"))
    a = t.benchmark.select(F.col("item_id").alias("a"), F.col("text").alias("phrase"))
    to_b = M.best_partners(a, "a", "phrase", turns, "b", "question").filter("score >= 0.6").select(F.col("q").alias("a"), F.col("node").alias("b"), "score")
    to_a = M.best_partners(turns, "b", "question", a, "a", "phrase").filter("score >= 0.6").select(F.col("node").alias("a"), F.col("q").alias("b"))
    return to_b.join(to_a, ["a", "b"]).select("a", "b", "score")


@query("j7_exclude_existing", """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 c AS (SELECT DISTINCT x.p AS a, y.p AS b, x.s AS s FROM i x JOIN i y ON x.o = y.o AND x.p < y.p)
 SELECT DISTINCT a, b FROM c WHERE (a, b) NOT IN (SELECT (a, b) FROM c WHERE s = 'F')""")
def j7(t: Tables):
    from ..operators.corpus import pairs_within

    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("term"), "o_orderstatus").distinct()
    pairs = pairs_within(items, ["basket", "o_orderstatus"]).select("a", "b", "o_orderstatus")
    known = pairs.filter("o_orderstatus = 'F'").select(F.col("b").alias("src"), F.col("a").alias("dst"))
    return M.exclude_existing(pairs.select("a", "b").distinct(), known).select("a", "b")


@query("j13_sentence_overlap", f"""WITH d AS (SELECT DISTINCT doc_id, lower(unnest({SENTENCES_SQL})) AS s FROM documents),
  b AS (SELECT DISTINCT item_id, lower(unnest({SENTENCES_SQL})) AS s FROM benchmark)
  SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (s) GROUP BY ALL""")
def j13(t: Tables):
    from ..operators.quality import sentence_overlap

    return sentence_overlap(t.benchmark, "item_id", t.documents, "doc_id")


# The SQL engine's edit distance counts bytes, so its letters become single bytes first.
_NON_ASCII = ("äöüßéèêçñóíáúàâîôûœ¡", "0123456789!#$%&*+=@^")


@query("j15_typo_join", f"""WITH v AS (SELECT w AS fix, count(*) AS freq FROM (SELECT unnest({TERMS.format(x='text', n=4)}) AS w FROM documents) GROUP BY ALL),
  a AS (SELECT DISTINCT w AS word FROM (SELECT unnest({TERMS.format(x='text', n=4)}) AS w FROM conversations) WHERE w NOT IN (SELECT fix FROM v)),
  ak AS (SELECT DISTINCT word, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word)) AS k FROM a),
  vk AS (SELECT DISTINCT fix, freq, unnest(list_append(list_transform(range(1, length(fix) + 1), lambda i: substr(fix, 1, i - 1) || substr(fix, i + 1)), fix)) AS k FROM v),
  n AS (SELECT DISTINCT word, fix, freq FROM ak JOIN vk USING (k) WHERE levenshtein(translate(word, '{_NON_ASCII[0]}', '{_NON_ASCII[1]}'), translate(fix, '{_NON_ASCII[0]}', '{_NON_ASCII[1]}')) = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY freq DESC, fix DESC) AS rn, count(*) OVER (PARTITION BY word) AS options FROM n)
  SELECT word, fix, options FROM r WHERE rn = 1""")
def j15(t: Tables):
    vocab = t.documents.select(F.explode(T.content_terms(F.col("text"), 4)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    asked = t.conversations.select(F.explode(T.content_terms(F.col("text"), 4)).alias("word"))
    return M.typo_join(asked, vocab)


# A question's right sources are all that hold its text; any other one that scores as high as one of them takes it away.
THEFT_SQL = f"""{EVIDENCE_SQL.replace('hits AS', 'eh AS')}, hs AS (SELECT DISTINCT node AS q, source FROM eh JOIN documents ON doc_id = u),
 ow AS (SELECT q, source AS owner, pure AS base FROM support JOIN hs USING (q, source)),
 c AS (SELECT s.q, owner, s.source, count(*) OVER (PARTITION BY s.q, owner) AS winners FROM support s JOIN ow USING (q) WHERE s.pure >= base AND (s.q, s.source) NOT IN (SELECT (q, source) FROM hs))"""


def thefts(t: Tables) -> DataFrame:
    from ..operators.quality import theft_audit

    scores = materialize(M.support_scores(best_of(t)).select("q", "source", "pure"), "scores")
    held = M.evidence_hits(*evidence_inputs(t)).select(F.col("node").alias("q"), F.col("u").alias("doc_id"))
    held = materialize(held.join(t.documents.select("doc_id", "source"), "doc_id").select("q", "source").distinct(), "held")
    own = scores.join(held, ["q", "source"]).select("q", F.col("source").alias("owner"), F.col("pure").alias("base"))
    return theft_audit(own, scores.join(held, ["q", "source"], "left_anti"))


@query("j19_theft_audit", f"WITH {SCORES_SQL}, {THEFT_SQL} SELECT q, owner, source, winners, winners > 8 AS given_up FROM c")
def j19(t: Tables):
    return thefts(t)


# --- calibration and absorption on named nodes ---

BRANDS_SQL = f"""al AS (SELECT DISTINCT p_brand AS node, p_name AS phrase FROM part), dn AS (SELECT DISTINCT phrase FROM al), {grams_sql('g', 'dn', 'phrase', 'phrase')},
 tt AS (SELECT phrase, sum(n)::BIGINT AS t FROM g GROUP BY ALL),
 pp AS (SELECT x.phrase AS a, y.phrase AS b, sum(x.n)::BIGINT AS sa, sum(y.n)::BIGINT AS sb FROM g x JOIN g y USING (gram) GROUP BY ALL),
 sc AS (SELECT a, b, sa::DOUBLE / ta.t AS cov, sqrt((sa::DOUBLE / ta.t) * (sb::DOUBLE / tb.t)) AS geo FROM pp JOIN tt ta ON ta.phrase = a JOIN tt tb ON tb.phrase = b)"""


def brand_aliases(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("node"), F.col("p_name").alias("phrase")).distinct()


@query("a7_calibrate", f"""WITH {BRANDS_SQL}, s AS (SELECT al.node, al.phrase, o.node AS other, round(max(geo), 6) AS score FROM al JOIN sc ON a = al.phrase JOIN al o ON o.phrase = b
   WHERE NOT (o.node = al.node AND o.phrase = al.phrase) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY node, phrase ORDER BY score DESC, other) AS rn FROM s),
 own AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM r WHERE rn = 1 AND other = node),
 nl AS (SELECT DISTINCT lower(p_type) AS phrase FROM part), {grams_sql('ng', 'nl', 'phrase', 'phrase')}, ngt AS (SELECT phrase, sum(n)::BIGINT AS t FROM ng GROUP BY ALL),
 np AS (SELECT x.phrase AS a, y.phrase AS b, sum(x.n)::BIGINT AS sa, sum(y.n)::BIGINT AS sb FROM g x JOIN ng y USING (gram) GROUP BY ALL),
 leak AS (SELECT max(s) AS leak FROM (SELECT round(max(sqrt((sa::DOUBLE / tt.t) * (sb::DOUBLE / ngt.t))), 6) AS s FROM np JOIN tt ON tt.phrase = a JOIN ngt ON ngt.phrase = b GROUP BY b) WHERE s >= 0.45),
 o AS (SELECT max(n) AS n, min(score) AS low FROM own WHERE k > n // 20)
 SELECT n, round(greatest(0.30, low - 0.02), 2) AS ok_min, round(least(round(greatest(0.30, low - 0.02), 2) - 0.05, coalesce(leak + 0.01, 0.45)), 2) AS a_min FROM o, leak""")
def a7(t: Tables):
    al = brand_aliases(t)
    # A line is named by its node and phrase; the two best ones of a text hold the best one that is not its own.
    line = F.concat_ws("\x01", "node", "phrase")
    lines = al.withColumn("line", line)
    asked = al.select(M.text_id(F.col("phrase")).alias("q"), "phrase").distinct()
    near = M.best_partners(asked, "q", "phrase", lines, "line", "phrase", keep=2, digits=6)
    held = al.select(F.col("node").alias("own"), F.col("phrase").alias("held"), line.alias("mine"), M.text_id(F.col("phrase")).alias("q"))
    rest = held.join(near, "q").filter("node <> mine")
    first = F.struct(-F.col("score"), "node")
    top = rest.groupBy("own", "held").agg(F.substring_index(F.min_by("node", first), "\x01", 1).alias("winner"), F.max("score").alias("score"))
    nulls = t.part.select(F.lower("p_type").alias("null_text")).distinct()
    leaks = M.best_partners(nulls, "null_text", "null_text", lines, "line", "phrase", digits=6).select("score")
    return M.calibrate(top.filter("own = winner"), leaks)


@query("a19_alias_absorption", f"""WITH {BRANDS_SQL}, m AS (SELECT o.node, al.node AS asked, al.phrase, max(cov) AS best FROM al o JOIN sc ON a = o.phrase JOIN al ON al.phrase = b WHERE al.node <> o.node GROUP BY ALL),
 c AS (SELECT node, count(*) AS aliases FROM al GROUP BY ALL), n AS (SELECT count(*) AS total FROM al), x AS (SELECT c.node, n.total - c.aliases AS others, c.aliases FROM c CROSS JOIN n)
 SELECT x.node, round(coalesce(sum(best), 0) / others, 6) AS absorption, aliases, aliases < 3 AS missing_aliases FROM x LEFT JOIN m USING (node) GROUP BY x.node, others, aliases""")
def a19(t: Tables):
    from ..operators.quality import alias_absorption

    return alias_absorption(brand_aliases(t))
