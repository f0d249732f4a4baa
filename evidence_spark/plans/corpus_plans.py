"""Queries over the corpus: sources, extraction, coverage, quality and learned scorers (S, C, A, U, W, L, M, Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import match as M
from ..operators import quality as Q
from ..operators import tables as TB
from ..sources import readers as RD
from . import match_plans as MP
from .match_plans import INDEX_SQL, ITEM_GRAMS, LINES_SQL, PAIRS, ROUTE_SQL, SCORES_SQL, TERMS
from .registry import Tables, grams_sql, query
from .text_plans import DOMAIN_SQL, KIND_RULES, KIND_SQL, REVIEW_SQL, SENTENCES_SQL, sanitize_sql

# --- sources ---

_DROP = "html"
for _tag in ("script", "style", "noscript", "svg", "canvas", "nav", "footer", "header", "form"):
    _DROP = f"regexp_replace({_DROP}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_BLOCKS = f"regexp_replace(regexp_replace({_DROP}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:p|article|section|main|h1|h2|h3|li|blockquote)\\b[^>]*>', chr(30), 'g')"
BLOCKS_SQL = f"""bl AS (SELECT page_id, {sanitize_sql('b')} AS block, i FROM (SELECT page_id, unnest(string_split({_BLOCKS}, chr(30))) AS b, generate_subscripts(string_split({_BLOCKS}, chr(30)), 1) AS i FROM pages)),
 blocks AS (SELECT page_id, block, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) AS ord FROM bl WHERE length(block) >= 30 GROUP BY page_id, block)"""


def blocks(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.posexplode(T.html_blocks(F.col("html"))).alias("o", "block")).withColumn("ord", F.col("o") + 1).drop("o")


@query("s4_html_blocks", f"WITH {BLOCKS_SQL} SELECT page_id, ord, block FROM blocks")
def s4(t: Tables):
    return blocks(t).select("page_id", "ord", "block")


@query("s1_read_graphs", """SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 'c' || c_custkey AS node_id, c_mktsegment AS layer, 'b' || c_acctbal AS source, c_name AS first_alias, 1 AS aliases, 2 AS edges FROM customer""")
def s1(t: Tables):
    """Graph file lines made from the customers: a section, a node with source and alias, an edge line that fans out."""
    node = F.concat(F.lit("c"), F.col("c_custkey"))
    made = F.array(F.concat(F.lit("["), F.col("c_mktsegment"), F.lit("]")), F.concat(node, F.lit("@b"), F.col("c_acctbal"), F.lit(': "'), F.col("c_name"), F.lit('"  # note')),
                   F.concat(node, F.lit(" -proves-> a, b")))
    lines = t.customer.select(F.col("c_nationkey").cast("string").alias("graph_id"), "c_custkey", F.posexplode(made).alias("i", "line")).select("graph_id", (F.col("c_custkey") * 3 + F.col("i")).alias("pos"), "line")
    g = RD.parse_graph_lines(lines)
    al = g["alias"].groupBy("graph_id", "node_id").agg(F.min("phrase").alias("first_alias"), F.count("*").cast("int").alias("aliases"))
    ed = g["edge"].groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").cast("int").alias("edges"))
    return g["node"].join(al, ["graph_id", "node_id"]).join(ed, ["graph_id", "node_id"]).select("graph_id", "node_id", "layer", "source", "first_alias", "aliases", "edges")


@query("s7_split_passages", r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS b, generate_subscripts(regexp_split_to_array(text, '\n[ \t]*\n'), 1) AS loc FROM documents
   WHERE len(regexp_extract_all(text, '(?m)^#{1,6} +\S')) < 2)
 SELECT doc_id, loc, CAST(NULL AS VARCHAR) AS heading, trim(regexp_replace(b, '[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+', ' ', 'g')) AS body FROM p WHERE length(trim(regexp_replace(b, '[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+', ' ', 'g'))) >= 40""")
def s7(t: Tables):
    return C.split_passages(t.documents)


@query("s8_read_procedures", """SELECT l_orderkey AS doc_id, 'Order ' || l_orderkey || ' > Items' AS path, 'list' AS kind, string_agg('part ' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS steps, count(*) AS n
 FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2""")
def s8(t: Tables):
    """Every order as a document with its lines as numbered steps."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("i"))
    steps = F.array_join(F.transform("i", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(". part "), x["l_partkey"].cast("string"))), "\n")
    made = items.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("# Order "), F.col("l_orderkey").cast("string"), F.lit("\n## Items\n"), steps).alias("text"))
    return C.read_procedures(made).select("doc_id", "path", "kind", F.array_join("steps", ";").alias("steps"), "n")


@query("s9_content_manifest", r"""SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha256_lf,
 len(regexp_extract_all(text, '\r\n'))::BIGINT AS crlf, (len(regexp_extract_all(text, '\n')) - len(regexp_extract_all(text, '\r\n')))::BIGINT AS lf, (len(regexp_extract_all(text, '\r')) - len(regexp_extract_all(text, '\r\n')))::BIGINT AS cr FROM documents""")
def s9(t: Tables):
    return t.documents.select("doc_id", *RD.manifest_columns(F.col("text")))


@query("s9b_verify_manifest", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0""")
def s9b(t: Tables):
    """The labelled part of the collection against its manifest: unlabelled files are missing, bad ones were changed."""
    want = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    have = t.documents.join(t.labels, "doc_id").select("doc_id", F.sha2(F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return RD.verify_manifest(want, have, "doc_id")


@query("s11_filter_precedents", """SELECT DISTINCT p_partkey FROM part WHERE contains(replace(p_brand || ' ' || p_type, ' ', ''), '1ECONOMY')""")
def s11(t: Tables):
    cited = t.part.withColumn("citation", F.concat_ws(" ", "p_brand", "p_type"))
    return TB.filter_precedents(cited, "citation", F.lit("1ECONOMY")).select("p_partkey").distinct()


@query("s12_select_current", """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, CAST(epoch_us(max(o_orderdate)) AS BIGINT) AS at FROM orders GROUP BY o_custkey""")
def s12(t: Tables):
    from ..functions.times import micros

    return TB.select_current(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", micros(F.col("o_orderdate")).alias("at"))


# --- claims and concepts ---

CLAIMS_SQL = f"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS loc FROM documents),
 se AS (SELECT DISTINCT doc_id, loc, unnest({SENTENCES_SQL}) AS sentence FROM ln), cl AS (SELECT doc_id, loc, sentence, {KIND_SQL} AS kind, {REVIEW_SQL} AS review FROM se)"""
KINDS = ["definition", "causal", "procedure", "limitation", "evidence", "statement"]


@query("c1_extract_claims", f"WITH {CLAIMS_SQL} SELECT doc_id, loc::INTEGER AS loc, sentence AS text, kind, review FROM cl WHERE kind IS NOT NULL")
def c1(t: Tables):
    return C.extract_claims(t.documents, KIND_RULES).select("doc_id", "loc", "text", "kind", "review")


@query("a10_claim_coverage", f"WITH {CLAIMS_SQL} SELECT doc_id, count(*) AS claims, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + ", count(*) >= 3 AS sufficient FROM cl WHERE kind IS NOT NULL AND NOT review GROUP BY doc_id")
def a10(t: Tables):
    return C.claim_coverage(C.extract_claims(t.documents, KIND_RULES), KINDS)


@query("c2_claims_to_graph", f"""WITH {CLAIMS_SQL}, k AS (SELECT *, 'c' || substr(sha256(doc_id || '|' || loc || '|' || sentence), 1, 16) AS cid FROM cl WHERE kind IS NOT NULL AND NOT review)
 SELECT doc_id, 'e_' || cid AS src, 'proves' AS rel, cid AS dst, loc::INTEGER AS loc, kind FROM k UNION ALL SELECT doc_id, cid, 'fulfils', 'doc_' || doc_id, loc::INTEGER, kind FROM k""")
def c2(t: Tables):
    return C.claims_to_graph(C.extract_claims(t.documents, KIND_RULES))


@query("u1_union_claims", f"""WITH {CLAIMS_SQL} SELECT doc_id, 'text' AS origin, count(*) AS claims, 0 AS review FROM cl WHERE kind IS NOT NULL AND NOT review GROUP BY doc_id
 UNION ALL SELECT doc_id, 'external', count(*) FILTER (quality = 1), count(*) FILTER (toxic = 1) FROM labels WHERE toxic = 1 OR quality = 1 GROUP BY doc_id HAVING count(*) FILTER (toxic = 0 AND quality = 1) + count(*) FILTER (toxic = 1) > 0""")
def u1(t: Tables):
    """Labels act as externally verified claims: good ones are sure, toxic ones of a kind that is not allowed."""
    text = C.extract_claims(t.documents, KIND_RULES).filter("NOT review").select("doc_id", "kind", F.lit("text").alias("origin"))
    ext = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "banned").otherwise("visual").alias("kind"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"), F.lit("external").alias("origin"), "quality")
    rows = C.add_verified(text, ext, ["visual"])
    good = (F.col("status") == "claim") | ((F.col("status") == "review") & (F.col("quality") == 1))
    return rows.groupBy("doc_id", "origin").agg(F.count_if(good).alias("claims"), F.count_if(F.col("status") == "review").cast("int").alias("review"))


POST_SQL = f"""po AS (SELECT DISTINCT doc_id, ord AS passage, unnest({TERMS.format(x='phrase', n=3)}) AS term FROM lines), ti AS (SELECT DISTINCT unnest({TERMS.format(x='phrase', n=3)}) AS term FROM lines WHERE ord = 0)"""


def postings(t: Tables) -> DataFrame:
    return t.lines().select("doc_id", F.col("ord").alias("passage"), F.explode(F.array_distinct(T.content_terms(F.col("phrase"), 3))).alias("term"))


def titles(t: Tables) -> DataFrame:
    """The words of a document's first line serve as its title."""
    return t.lines().filter("ord = 0").select(F.explode(T.content_terms(F.col("phrase"), 3)).alias("term"))


@query("a8_concept_stats", f"""WITH {LINES_SQL}, {POST_SQL}, n AS (SELECT count(DISTINCT doc_id) AS n FROM po), s AS (SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS doc_count, n FROM po CROSS JOIN n GROUP BY term, n),
 w AS (SELECT s.*, term IN (SELECT term FROM ti) AS titled, freq * ln(n / doc_count + 1) * (1.0::DOUBLE + 0.12::DOUBLE * greatest(length(term) - 2, 0)) AS raw FROM s)
 SELECT term, freq, doc_count, titled FROM w WHERE (freq >= 2 OR titled) AND (round(raw, 1) >= 10 OR titled)""")
def a8(t: Tables):
    return C.concept_stats(postings(t), titles(t)).select("term", "freq", "doc_count", "titled")


@query("a9_cooccurrence", f"""WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), bw AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM i x JOIN i y ON x.o = y.o AND x.p < y.p GROUP BY ALL) SELECT a, b, n FROM bw WHERE n >= 2""")
def a9(t: Tables):
    posts = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("passage"), F.col("l_partkey").alias("term"))
    return C.cooccurrence(posts)


@query("c3_suffix_hypernyms", f"""WITH {LINES_SQL}, {POST_SQL}, f AS (SELECT term, count(*) AS freq, term IN (SELECT term FROM ti) AS alone FROM po GROUP BY term),
 s AS (SELECT f.term, f.freq, substr(f.term, length(f.term) - k + 1) AS h, k FROM f, range(2, 9) r(k) WHERE length(f.term) >= 4 AND k <= length(f.term) - 1)
 SELECT term, h AS hypernym FROM (SELECT s.term, h, row_number() OVER (PARTITION BY s.term ORDER BY k DESC) AS rn FROM s JOIN f ON f.term = h WHERE f.alone OR f.freq > s.freq) WHERE rn = 1""")
def c3(t: Tables):
    alone = titles(t).distinct().withColumn("alone", F.lit(True))
    terms = postings(t).groupBy("term").agg(F.count("*").alias("freq")).join(alone, "term", "left").na.fill(False, ["alone"])
    return C.suffix_hypernyms(terms)


DEF_PATTERN = r"(\p{L}+) (?:is|ist|est|es) (?:a |the |un |une |ein |eine |la |le )?(\p{L}+)"


@query("c4_definitions", rf"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{DEF_PATTERN}')) AS h FROM documents), d AS (SELECT doc_id, lower(regexp_extract(h, '{DEF_PATTERN}', 1)) AS term, lower(regexp_extract(h, '{DEF_PATTERN}', 2)) AS genus FROM h)
 SELECT DISTINCT doc_id, term, genus FROM d WHERE term <> genus""")
def c4(t: Tables):
    return C.definitions(t.documents, DEF_PATTERN)


SENT_SQL = f"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS passage FROM documents),
 st AS (SELECT doc_id, passage, unnest({SENTENCES_SQL}) AS sentence, generate_subscripts({SENTENCES_SQL}, 1) - 1 AS pos FROM ln)"""


def located_sentences(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("passage", "line"))
    return lines.select("doc_id", "passage", F.posexplode(T.sentences(F.col("line"))).alias("pos", "text")).withColumn("defines", F.col("text").startswith("The "))


@query("c5_gather_excerpts", f"""WITH {SENT_SQL}, bt AS (SELECT DISTINCT unnest({TERMS.format(x='text', n=6)}) AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, passage, pos, starts_with(sentence, 'The ') AS defines, unnest({TERMS.format(x='sentence', n=2)}) AS term FROM st),
 k AS (SELECT *, row_number() OVER (PARTITION BY term, doc_id, passage ORDER BY pos) AS k FROM w JOIN bt USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY defines DESC, doc_id, passage, pos) AS rank FROM k WHERE k <= 2)
 SELECT term, rank, doc_id, passage::INTEGER AS passage, pos::INTEGER AS pos FROM r WHERE rank <= 8""")
def c5(t: Tables):
    terms = t.benchmark.select(F.explode(T.content_terms(F.col("text"), 6)).alias("term")).distinct()
    return C.gather_excerpts(terms, located_sentences(t))


IDX_PAIRS = f"""{INDEX_SQL}, dl AS (SELECT DISTINCT phrase FROM idx), {grams_sql('lg', 'dl', 'phrase', 'phrase')}, lt AS (SELECT phrase, sum(n)::BIGINT AS lt FROM lg GROUP BY ALL), {ITEM_GRAMS}, {PAIRS},
 cv AS (SELECT item_id AS q, node * 1000000 + ord AS eid, phrase, ls::DOUBLE / lt AS coverage FROM pairs JOIN lt USING (phrase) JOIN idx USING (phrase) WHERE ls >= lt * 0.6::DOUBLE)"""


def best_excerpts(t: Tables, form=None, marks=None, floor: float = 0.6) -> DataFrame:
    idx = MP.index(t).withColumn("eid", F.col("node") * 1000000 + F.col("ord"))
    return M.best_covered(idx, "phrase", "eid", t.questions(), floor, form, marks)


@query("c6_pick_excerpt", rf"""WITH {IDX_PAIRS}, s AS (SELECT q, eid, coverage + CASE WHEN regexp_matches(phrase, '(?i)\b(is|are) (a|an|the)\b|\bmeans\b|\brefers to\b') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
   + 0.06::DOUBLE * least(CASE WHEN contains(phrase, 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(phrase, 'that') THEN 1 ELSE 0 END, 4) AS score FROM cv)
 SELECT q, eid AS excerpt_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, eid) AS rn FROM s) WHERE rn = 1""")
def c6(t: Tables):
    best = best_excerpts(t, *C.excerpt_bonus(F.col("body"), ["definition"], ["tion", "that"]))
    return best.select("q", F.col("eid").alias("excerpt_id"), "score")


@query("c7_search_excerpts", f"WITH {IDX_PAIRS} SELECT q, eid, coverage FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY coverage DESC, eid) AS rn FROM cv) WHERE rn = 1 AND coverage >= 0.58")
def c7(t: Tables):
    return best_excerpts(t).filter("coverage >= 0.58").select("q", "eid", "coverage")


TURN_PAIRS = f"""cv0 AS (SELECT conv_id * 1000 + turn AS u, text FROM conversations), {ITEM_GRAMS}, ct AS (SELECT DISTINCT text FROM cv0), {grams_sql('tg', 'ct', 'text', 'text')},
 tp AS (SELECT item_id, text, sum(qg.n)::BIGINT AS s FROM qg JOIN tg USING (gram) GROUP BY ALL), hit AS (SELECT u AS passage, item_id AS node, s::DOUBLE / qt AS score FROM tp JOIN qt USING (item_id) JOIN cv0 USING (text) WHERE s >= qt * 0.8::DOUBLE)"""


@query("c8_suggest_edges", f"""WITH {TURN_PAIRS}, d AS (SELECT node FROM hit GROUP BY node HAVING count(*) <= greatest((SELECT count(*) FROM conversations) * 0.25, 1)), k AS (SELECT * FROM hit WHERE node IN (SELECT node FROM d)),
 p AS (SELECT passage FROM k GROUP BY passage HAVING count(*) BETWEEN 2 AND 4), r AS (SELECT k.* FROM k JOIN p USING (passage)),
 a AS (SELECT x.node AS a, y.node AS b, count(*) AS n, round(max(least(x.score, y.score)), 3) AS strength, min(passage) AS receipt1, max(passage) AS receipt2 FROM r x JOIN r y USING (passage) WHERE x.node < y.node GROUP BY ALL HAVING count(*) >= 2)
 SELECT *, FALSE AS cycle FROM a WHERE NOT (a % 2 = 0 AND b = a + 1) ORDER BY strength DESC, n DESC, a, b LIMIT 25""")
def c8(t: Tables):
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("passage"), F.col("text").alias("body"))
    pairs = M.coverage_pairs(t.benchmark, "text", turns, "body", 0.8).select("it", "ot", M.coverage().alias("score"))
    hits = M.attach(M.attach(pairs, "it", t.benchmark, "text", ["item_id"]), "ot", turns, "body", ["passage"]).select("passage", F.col("item_id").alias("node"), "score")
    existing = t.benchmark.filter("item_id % 2 = 0").select(F.col("item_id").alias("src"), (F.col("item_id") + 1).alias("dst"))
    return C.suggest_edges(hits, turns, existing)


REL_PATTERN = r"(\p{L}{5,}) (of|de|der) (\p{L}{5,})"
REL_SQL = rf"""h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{REL_PATTERN}')) AS h FROM documents), rp AS (SELECT DISTINCT lower(regexp_extract(h, '{REL_PATTERN}', 1)) AS a, regexp_extract(h, '{REL_PATTERN}', 2) AS rel, lower(regexp_extract(h, '{REL_PATTERN}', 3)) AS b FROM h),
 ph AS (SELECT a AS phrase FROM rp UNION SELECT b FROM rp), nw AS (SELECT DISTINCT unnest({TERMS.format(x='text', n=7)}) AS node FROM benchmark), {grams_sql('pg', 'ph', 'phrase', 'phrase')}, {grams_sql('ng', 'nw', 'node', 'node')},
 pt AS (SELECT phrase, sum(n)::BIGINT AS t FROM pg GROUP BY ALL), nt AS (SELECT node, sum(n)::BIGINT AS t FROM ng GROUP BY ALL),
 sc AS (SELECT phrase, node, sum(pg.n)::BIGINT AS sp, sum(ng.n)::BIGINT AS sn FROM pg JOIN ng USING (gram) GROUP BY ALL),
 best AS (SELECT phrase, node, score FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, node) AS rn FROM (SELECT phrase, node, sqrt((sp::DOUBLE / pt.t) * (sn::DOUBLE / nt.t)) AS score FROM sc JOIN pt USING (phrase) JOIN nt USING (node)))
   WHERE rn = 1)"""


def relation_phrases(t: Tables):
    hits = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(REL_PATTERN), F.lit(0))).alias("h"))
    rels = hits.select(F.lower(F.regexp_extract("h", REL_PATTERN, 1)).alias("a"), F.regexp_extract("h", REL_PATTERN, 2).alias("rel"), F.lower(F.regexp_extract("h", REL_PATTERN, 3)).alias("b")).distinct()
    phrases = rels.select(F.explode(F.array("a", "b")).alias("phrase")).distinct()
    nodes = t.benchmark.select(F.explode(T.content_terms(F.col("text"), 7)).alias("node")).distinct()
    best = M.best_partners(phrases, "phrase", "phrase", nodes, "node", "node").withColumnRenamed("q", "phrase")
    return rels, phrases, best


@query("c9_suggest_relations", f"WITH {REL_SQL} SELECT a.node AS src, rel, b.node AS dst, max(least(a.score, b.score)) AS strength, count(*) AS n FROM rp JOIN best a ON a.phrase = rp.a JOIN best b ON b.phrase = rp.b WHERE a.score >= 0.6 AND b.score >= 0.6 AND a.node <> b.node GROUP BY ALL")
def c9(t: Tables):
    rels, _, best = relation_phrases(t)
    ok = best.filter("score >= 0.6")
    j = rels.join(ok.select(F.col("phrase").alias("a"), F.col("node").alias("src"), F.col("score").alias("sa")), "a").join(ok.select(F.col("phrase").alias("b"), F.col("node").alias("dst"), F.col("score").alias("sb")), "b")
    return j.filter("src <> dst").groupBy("src", "rel", "dst").agg(F.max(F.least("sa", "sb")).alias("strength"), F.count("*").alias("n"))


@query("c11_suggest_concepts", f"WITH {REL_SQL} SELECT ph.phrase, coalesce(score, 0.0) AS score FROM ph LEFT JOIN best ON best.phrase = ph.phrase WHERE coalesce(score, 0.0) < 0.72")
def c11(t: Tables):
    _, phrases, best = relation_phrases(t)
    return phrases.join(best.select("phrase", "score"), "phrase", "left").select("phrase", F.coalesce("score", F.lit(0.0)).alias("score")).filter("score < 0.72")


TURNS_SELF = f"""d AS (SELECT text, min(conv_id * 1000 + turn) AS id, count(*) AS times FROM conversations WHERE role = 'user' GROUP BY text), {grams_sql('g', 'd', 'id', 'text')}, tt AS (SELECT id, sum(n)::BIGINT AS t FROM g GROUP BY ALL),
 pr AS (SELECT x.id AS a, y.id AS b, sum(x.n)::BIGINT AS s FROM g x JOIN g y USING (gram) GROUP BY ALL), ln AS (SELECT a, b FROM pr JOIN tt ON id = a WHERE a <> b AND s >= t * 0.8::DOUBLE), u AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
 w(node, reach) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.reach), cc AS (SELECT node, min(reach) AS comp FROM w GROUP BY node)"""


@query("c10_suggest_nodes", f"WITH RECURSIVE {TURNS_SELF} SELECT comp AS cluster, sum(times)::BIGINT AS times, count(*) AS phrasings FROM d JOIN cc ON node = id GROUP BY comp HAVING sum(times) >= 3 AND count(*) >= 2")
def c10(t: Tables):
    return C.suggest_nodes(t.user_turns().select((F.col("conv_id") * 1000 + F.col("turn")).alias("u"), "text"), 0.8)


@query("w10_repeat_unknown", f"WITH RECURSIVE {TURNS_SELF} SELECT comp AS cluster, sum(times)::BIGINT AS times, count(*) AS phrasings FROM d JOIN cc ON node = id GROUP BY comp HAVING sum(times) >= 2 AND count(*) >= 2")
def w10(t: Tables):
    return C.suggest_nodes(t.user_turns().select((F.col("conv_id") * 1000 + F.col("turn")).alias("u"), "text"), 0.8, min_n=2)


SENSES_SQL = """sn AS (SELECT string_split(p_name, ' ')[2] AS word, p_partkey AS sense, lower(p_name || ' ' || p_type || ' ' || p_brand) AS definition, string_split(p_name, ' ')[1] AS genus FROM part)"""


@query("w2_margin_pick", """WITH r AS (SELECT p_brand, p_partkey, p_retailprice - 900 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice - 900 DESC, p_partkey) AS rn FROM part)
 SELECT a.p_brand, CASE WHEN a.score > 0 AND (b.score IS NULL OR a.score >= 1.001 * b.score) THEN a.p_partkey END AS p_partkey FROM r a LEFT JOIN r b ON b.p_brand = a.p_brand AND b.rn = 2 WHERE a.rn = 1""")
def w2(t: Tables):
    return C.margin_pick(t.part.select("p_brand", "p_partkey", (F.col("p_retailprice") - 900).alias("score")), "p_brand", "p_partkey", 1.001)


# A line is an entry: its first word is explained, the last one is the genus, the second one the object.
ENTRY_SQL = rf"""{LINES_SQL}, ws AS (SELECT doc_id * 1000 + ord AS sense, phrase, list_filter(regexp_split_to_array(lower(phrase), '[^\p{{L}}]+'), lambda w: length(w) >= 3) AS w FROM lines),
 en AS (SELECT sense, phrase AS definition, w[1] AS word, w[-1] AS genus, w[2] AS object, w[-1] LIKE '%ing' AS is_action, list_distinct(w) AS terms FROM ws WHERE len(w) >= 3),
 tm AS (SELECT word, sense, unnest(terms) AS t FROM en), idf AS (SELECT t, ln((SELECT count(*) FROM en)::DOUBLE / (1 + count(*))) AS w FROM tm GROUP BY t),
 fi AS (SELECT word, min(sense) AS sense, arg_min(genus, sense) AS genus, arg_min(object, sense) AS object, arg_min(is_action, sense) AS is_action FROM en GROUP BY word),
 kn AS (SELECT word AS genus, count(*) AS n, min(sense) AS only_one FROM en GROUP BY word), ak AS (SELECT f.word, f.sense, f.genus, n, only_one FROM fi f LEFT JOIN kn USING (genus) WHERE genus <> word AND genus NOT IN ('the', 'and')),
 sc AS (SELECT a.word, m.sense AS genus_sense, sum(w) AS score FROM ak a JOIN tm s ON s.word = a.word AND s.sense = a.sense JOIN tm m ON m.word = a.genus AND m.t = s.t JOIN idf ON idf.t = s.t WHERE n > 1 GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, genus_sense) AS rn FROM sc),
 pk AS (SELECT x.word, x.genus_sense FROM rk x LEFT JOIN rk y ON y.word = x.word AND y.rn = 2 WHERE x.rn = 1 AND x.score > 0 AND (y.score IS NULL OR x.score >= 1.3 * y.score)),
 lk AS (SELECT word, genus, CASE WHEN n > 1 THEN genus_sense ELSE only_one END AS genus_sense FROM ak LEFT JOIN pk USING (word) WHERE n IS NULL OR n = 1 OR genus_sense IS NOT NULL),
 ge AS (SELECT fi.word, lk.genus, lk.genus_sense, object, is_action FROM fi LEFT JOIN lk USING (word))"""


def entries(t: Tables) -> DataFrame:
    w = T.content_terms(F.col("phrase"), 3)
    rows = t.lines().select((F.col("doc_id") * 1000 + F.col("ord")).alias("sense"), F.col("phrase").alias("definition"), w.alias("w")).filter("size(w) >= 3")
    last = F.element_at("w", -1)
    return rows.select(F.col("w")[0].alias("word"), "sense", "definition", last.alias("genus"), F.col("w")[1].alias("object"), last.endswith("ing").alias("is_action"))


@query("c12_genus_chain", f"""WITH RECURSIVE {ENTRY_SQL}, wk(word, cur, depth) AS (SELECT word, genus, 1 FROM ge WHERE genus IS NOT NULL UNION ALL SELECT wk.word, ge.genus, depth + 1 FROM wk JOIN ge ON ge.word = wk.cur WHERE ge.genus IS NOT NULL AND depth < 200),
 ends AS (SELECT wk.word, cur AS root, depth FROM wk LEFT JOIN ge ON ge.word = wk.cur WHERE ge.genus IS NULL)
 SELECT ge.word, genus, genus_sense, object, is_action, CASE WHEN genus IS NULL THEN ge.word ELSE root END AS root, CASE WHEN genus IS NULL THEN 0 ELSE depth END AS depth FROM ge LEFT JOIN ends USING (word)""")
def c12(t: Tables):
    from ..operators.definitions import build_genus_chain

    return build_genus_chain(entries(t), ["the", "and"])


EV_SQL = f"""{BLOCKS_SQL}, ev AS (SELECT block AS topic, {DOMAIN_SQL} AS domain, regexp_extract(url, '/([a-z]{{2}})/', 1) AS value, contains(url, 'page=') AS denied, page_id FROM blocks JOIN pages USING (page_id))"""


def page_evidence(t: Tables) -> DataFrame:
    """Every block of a page is a topic; its domain is the source, the language part of the address the value, and a
    paged address counts as a denial."""
    return blocks(t).select(F.col("block").alias("topic"), T.url_domain(F.col("url")).alias("domain"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("value"), F.col("url").contains("page=").alias("denied"), "page_id", "ord")


@query("a11_corroborate", f"""WITH {EV_SQL}, c AS (SELECT topic, count(DISTINCT domain) FILTER (NOT denied AND domain <> '') AS domains, count(DISTINCT value) FILTER (NOT denied) AS values, count(*) FILTER (denied) AS denied FROM ev GROUP BY topic)
 SELECT *, CASE WHEN denied > 0 OR values > 1 THEN 'conflict' WHEN domains >= 2 THEN 'covered' ELSE 'missing' END AS status FROM c""")
def a11(t: Tables):
    return C.corroborate(page_evidence(t))


@query("c13_topic_records", f"""WITH {EV_SQL} SELECT topic, domain, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM ev GROUP BY ALL""")
def c13c(t: Tables):
    return page_evidence(t).groupBy("topic", "domain").agg(F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


# A page is a record: the first word of its first block is the topic, the second another name of it, all blocks are facts.
TOPIC_SQL = rf"""{BLOCKS_SQL}, bk AS (SELECT page_id, url, {DOMAIN_SQL} AS source, ord, block, lower(regexp_extract(block, '[A-Za-z\x{{C0}}-\x{{24F}}]+')) AS w1,
   lower(regexp_extract(block, '^[^A-Za-z\x{{C0}}-\x{{24F}}]*[A-Za-z\x{{C0}}-\x{{24F}}]+[^A-Za-z\x{{C0}}-\x{{24F}}]+([A-Za-z\x{{C0}}-\x{{24F}}]+)', 1)) AS w2 FROM blocks JOIN pages USING (page_id)),
 hd AS (SELECT page_id, arg_min(w1, ord) AS topic, arg_min(w2, ord) AS alias, arg_min(block, ord) AS title FROM bk GROUP BY page_id),
 rc AS (SELECT page_id AS rec, topic, CASE WHEN alias <> '' THEN alias END AS alias, source, url, title, block AS sentence FROM bk JOIN hd USING (page_id) WHERE topic <> ''),
 nm AS (SELECT DISTINCT topic, alias FROM rc WHERE alias IS NOT NULL UNION SELECT DISTINCT topic, topic FROM rc), li AS (SELECT topic AS a, alias AS b FROM nm UNION SELECT alias, topic FROM nm),
 rch(a, b) AS (SELECT a, a FROM li UNION SELECT rch.a, li.b FROM rch JOIN li ON li.a = rch.b), tg AS (SELECT a AS topic, min(b) FILTER (b IN (SELECT topic FROM nm)) AS root FROM rch WHERE a IN (SELECT topic FROM nm) GROUP BY a),
 rr AS (SELECT rc.*, root FROM rc JOIN tg USING (topic)), so AS (SELECT root, count(*) AS n, array_to_string(list(source ORDER BY source)[1:2], ', ') AS two FROM (SELECT DISTINCT root, source FROM rr) GROUP BY root)"""


def topic_records(t: Tables) -> DataFrame:
    letters = "[A-Za-z\u00c0-\u024f]"
    other = letters.replace("[", "[^")
    b = blocks(t).select("page_id", "url", "ord", "block", T.url_domain(F.col("url")).alias("source"))
    first = b.groupBy("page_id").agg(F.min_by("block", "ord").alias("title"))
    word = lambda pattern: F.lower(F.regexp_extract("title", pattern, 1))
    heads = first.select("page_id", "title", word(f"({letters}+)").alias("topic"), word(f"^{other}*{letters}+{other}+({letters}+)").alias("alias")).filter("topic <> ''")
    rows = b.join(heads, "page_id").select(F.col("page_id").alias("rec"), "topic", F.when(F.col("alias") != "", F.col("alias")).alias("alias"), "source", "url", "title", F.col("block").alias("sentence"))
    return rows


@query("c13_topic_nodes", f"""WITH RECURSIVE {TOPIC_SQL}
 SELECT DISTINCT 'claim:' || root AS node_id, 'claim' AS kind, alias AS phrase, n || ' sources: ' || two || CASE WHEN n > 2 THEN ' and others' ELSE '' END AS source FROM nm JOIN tg USING (topic) JOIN so USING (root)
 UNION ALL SELECT 'fact:' || root || ':' || substr(sha256(sentence), 1, 16), 'fact', sentence, arg_min(url, struct_pack(source, rec)) FROM rr GROUP BY root, sentence
 UNION ALL SELECT 'source:' || root || ':' || source, 'source', arg_max(title, rec), arg_max(url, rec) FROM rr GROUP BY root, source""")
def c13(t: Tables):
    from ..operators.topics import topic_graph

    return topic_graph(topic_records(t))[0]


@query("c13b_topic_edges", f"""WITH RECURSIVE {TOPIC_SQL}
 SELECT DISTINCT 'fact:' || root || ':' || substr(sha256(sentence), 1, 16) AS src, 'fulfils' AS rel, 'claim:' || root AS dst FROM rr
 UNION ALL SELECT DISTINCT 'source:' || root || ':' || source, 'proves', 'fact:' || root || ':' || substr(sha256(sentence), 1, 16) FROM rr
 UNION ALL SELECT DISTINCT 'claim:' || root, 'fulfils', 'goal' FROM tg""")
def c13b(t: Tables):
    from ..operators.topics import topic_graph

    return topic_graph(topic_records(t))[1]


@query("c14_relation_evidence")
def c14(t: Tables):
    s = located_sentences(t).select(F.lit("The").alias("topic"), (F.col("doc_id") * 1_000_000 + F.col("passage") * 1000 + F.col("pos")).alias("id"), "text")
    return C.relation_evidence(s, "The", [" in ", " of "], ["tion"], [",", " and "])


EVT_SQL = f"{BLOCKS_SQL}, ev AS (SELECT regexp_extract(url, '/([a-z]{{2}})/', 1) AS topic, {DOMAIN_SQL} AS source, page_id * 1000 + ord AS pos, block AS text FROM blocks JOIN pages USING (page_id)), f AS (SELECT *, row_number() OVER (PARTITION BY topic, source ORDER BY pos) > 1 AS late FROM ev), dv AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY late, pos) AS place FROM f)"


def topical(t: Tables) -> DataFrame:
    return blocks(t).select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("topic"), T.url_domain(F.col("url")).alias("source"), (F.col("page_id") * 1000 + F.col("ord")).alias("pos"), F.col("block").alias("text"))


@query("w4_diversified_top_n", f"WITH {EVT_SQL} SELECT topic, source, place, pos, text FROM dv WHERE place <= 12")
def w4(t: Tables):
    return C.diversified(topical(t), 12)


@query("c15_summarise", f"WITH {EVT_SQL} SELECT topic, string_agg(text, ' ' ORDER BY place) AS summary FROM dv WHERE place <= 5 GROUP BY topic")
def c15(t: Tables):
    return C.summarise(topical(t), 5)


@query("c16_compile_cases", """SELECT o_orderkey AS case_id, 'doctrine' AS kind, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'evidence', CAST(o_custkey AS VARCHAR) FROM orders""")
def c16(t: Tables):
    made = F.array(F.lit("# case"), F.concat(F.lit("- Doctrine: "), F.col("o_orderpriority")), F.concat(F.lit("  - evidence:  "), F.col("o_custkey"), F.lit(" ")), F.lit("free text"))
    return RD.compile_cases(t.orders.select(F.col("o_orderkey").alias("case_id"), F.posexplode(made).alias("pos", "line"))).select("case_id", "kind", "value")


@query("c17_import_node_link", """WITH n AS (SELECT p_partkey AS name FROM part) SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT name FROM n) AND l_suppkey IN (SELECT name FROM n) GROUP BY ALL""")
def c17(t: Tables):
    nodes = t.part.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("name"), F.array("p_name", "p_type", "p_name").alias("texts"))
    _, edges = C.import_node_link(nodes, t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("c18_co_occurs", """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, min(x.o) AS passage FROM i x JOIN i y ON x.o = y.o AND x.p < y.p GROUP BY ALL""")
def c18(t: Tables):
    items = t.lineitem.select(F.col("l_orderkey").alias("passage"), F.col("l_partkey").alias("term")).distinct()
    return C.pairs_within(items, ["passage"]).groupBy("a", "b").agg(F.min("passage").alias("passage"))


@query("c19_taxonomy_net", """WITH p AS (SELECT DISTINCT p_name || '/' || p_type AS h, p_brand AS b FROM part) SELECT h AS hypernym, count(*) AS n, string_agg(b, ',' ORDER BY b) AS hyponyms FROM p GROUP BY h HAVING count(*) <= 5""")
def c19(t: Tables):
    return C.taxonomy_net(t.part.select(F.concat_ws("/", "p_name", "p_type").alias("hypernym"), F.col("p_brand").alias("hyponym")))


@query("c20_mine_definitions", """SELECT DISTINCT p_type AS term, string_split(p_name, ' ')[-1] AS target, string_split(p_name, ' ')[1] AS action FROM part WHERE p_type <> 'PROMO'""")
def c20(t: Tables):
    rows = t.part.select(F.col("p_type").alias("word"), F.col("p_name").alias("definition"))
    return C.mine_definitions(rows, t.part.filter("p_type = 'PROMO'").select(F.col("p_type").alias("term")))


@query("c21_demand_terms", f"""WITH v AS (SELECT DISTINCT unnest({TERMS.format(x='text', n=3)}) AS term FROM documents), q AS (SELECT DISTINCT conv_id * 1000 + turn AS q, unnest({TERMS.format(x='text', n=3)}) AS term FROM conversations WHERE role = 'user')
 SELECT term, count(*) AS times, min(q) AS example FROM q WHERE term NOT IN (SELECT term FROM v) GROUP BY term""")
def c21(t: Tables):
    key = F.col("conv_id") * 1000 + F.col("turn")
    asked = t.conversations.select(key.alias("q"), key.alias("seq"), F.col("text").alias("question"), (F.col("role") == "user").alias("answerable"))
    return C.demand_terms(asked, t.documents.select(F.explode(F.array_distinct(T.content_terms(F.col("text"), 3))).alias("term")))


@query("j16_expand_synonyms", """WITH l AS (SELECT DISTINCT p_brand AS node, p_name AS phrase FROM part), h AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS lower, string_split(p_name, ' ')[2] AS upper FROM part),
 r1 AS (SELECT DISTINCT l.node, array_to_string(list_transform(string_split(phrase, ' '), lambda w: CASE WHEN w = upper THEN lower ELSE w END), ' ') AS phrase FROM l JOIN h ON list_contains(string_split(phrase, ' '), upper)),
 a1 AS (SELECT * FROM l UNION SELECT * FROM r1), n1 AS (SELECT * FROM r1 EXCEPT SELECT * FROM l),
 r2 AS (SELECT DISTINCT n1.node, array_to_string(list_transform(string_split(phrase, ' '), lambda w: CASE WHEN w = upper THEN lower ELSE w END), ' ') AS phrase FROM n1 JOIN h ON list_contains(string_split(phrase, ' '), upper))
 SELECT node, phrase FROM a1 UNION SELECT node, phrase FROM r2""")
def j16(t: Tables):
    name = F.split("p_name", " ")
    return C.expand_synonyms(t.part.select(F.col("p_brand").alias("node"), F.col("p_name").alias("phrase")), t.part.select(name[0].alias("lower"), name[1].alias("upper")))


@query("j18_definition_lookup", """WITH d AS (SELECT p_name AS term, min(p_type) AS definition FROM part GROUP BY p_name), q AS (SELECT DISTINCT p_name AS a, CASE WHEN p_size > 25 THEN string_split(p_name, ' ')[1] || ' bolt' END AS b FROM part)
 SELECT a, b, x.definition AS def_a, y.definition AS def_b, x.definition IS NOT NULL AND (b IS NULL OR y.definition IS NOT NULL) AS answered FROM q LEFT JOIN d x ON x.term = a LEFT JOIN d y ON y.term = b""")
def j18(t: Tables):
    from ..operators.definitions import definition_lookup

    defs = t.part.groupBy(F.upper("p_name").alias("term")).agg(F.min("p_type").alias("definition"))
    other = F.concat(F.split("p_name", " ")[0], F.lit(" bolt"))
    asked = F.when(F.col("p_size") > 25, F.concat(F.lit("What is the difference between "), "p_name", F.lit(" and "), other, F.lit("?"))).otherwise(F.concat(F.lit("What is "), "p_name", F.lit("?")))
    return definition_lookup(t.part.select(asked.alias("question")).distinct(), defs).select("a", "b", "def_a", "def_b", "answered")


# --- verdicts and measurement ---

VERDICT_SQL = f"""{SCORES_SQL}, b AS (SELECT q, node, score FROM (SELECT q, node, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS rn FROM node_scores) WHERE rn = 1),
 {MP.EVIDENCE_SQL.replace('hits AS', 'eh AS')}, e AS (SELECT node AS q, u FROM eh), k AS (SELECT q, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, -1) AS quality, node, score, q IN (SELECT q FROM e) AS ev, (q, node) IN (SELECT (q, u) FROM e) AS reach FROM b LEFT JOIN labels l ON l.doc_id = node),
 vd AS (SELECT q, node AS claim, score AS conf, CASE WHEN toxic = 1 AND NOT ev THEN 'B2' WHEN score < 0.45 THEN 'unknown' WHEN score < 0.7 THEN 'A' WHEN NOT ev THEN 'no-evidence' WHEN reach AND quality = 0 THEN 'accept-with-counter' WHEN reach THEN 'accept' ELSE 'B1' END AS verdict FROM k)"""


def verdict_rows(t: Tables) -> DataFrame:
    """Benchmark items judged: the best node is the claim, documents holding the item are its evidence, toxic documents a
    null class and plain bad ones counters."""
    best = MP.best_of(t, 1).groupBy("q").agg(F.max_by("node", F.struct("score", (-F.col("node")).alias("o"))).alias("node"), F.max("score").alias("conf"))
    found = M.evidence_hits(*MP.evidence_inputs(t)).select(F.col("node").alias("q"), F.col("u").alias("node")).distinct()
    any_ev = found.select("q").distinct().withColumn("ev", F.lit(True))
    j = best.join(t.labels.withColumnRenamed("doc_id", "node"), "node", "left").join(any_ev, "q", "left").join(found.withColumn("reach", F.lit(True)), ["q", "node"], "left")
    no = F.lit(False)
    v = M.verdict(
        evidence=F.coalesce("ev", no), claim=F.col("node"), conf=F.col("conf"), null_outcome=F.when(F.col("toxic") == 1, "B2").otherwise("real"), is_goal=no, is_axiom=no,
        reachable=F.coalesce("reach", no), elsewhere=no, is_concept=F.lit(True), countered=F.coalesce(F.col("quality") == 0, no), numeric=F.lit("none_needed"), streak=F.lit(0), ok_min=0.7)
    return j.select("q", F.col("node").alias("claim"), "conf", v.alias("verdict"))


@query("a5_verdicts", f"WITH {VERDICT_SQL} SELECT q, claim, conf, verdict FROM vd")
def a5(t: Tables):
    return verdict_rows(t)


@query("a6_verdict_counts", f"WITH {VERDICT_SQL} SELECT claim, count(*) AS n, count(*) FILTER (verdict NOT IN ('unknown', 'B2')) AS covered FROM vd GROUP BY claim")
def a6(t: Tables):
    return verdict_rows(t).groupBy("claim").agg(F.count("*").alias("n"), F.count_if(~F.col("verdict").isin("unknown", "B2")).alias("covered"))


@query("a16_gate_report", """WITH r AS (SELECT lang, source, quality = 1 AS answerable, CASE WHEN toxic = 1 THEN 'wrong' WHEN n_chars > 2000 THEN 'hold' ELSE 'correct' END AS outcome FROM documents JOIN labels USING (doc_id))
 SELECT lang, source, CAST(grouping_id(lang, source) AS BIGINT) AS level, count(*) AS cases, count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong,
  count(*) FILTER (answerable AND outcome = 'correct') / nullif(count(*) FILTER (answerable), 0) AS accuracy FROM r GROUP BY GROUPING SETS ((lang), (source), ())""")
def a16(t: Tables):
    r = t.documents.join(t.labels, "doc_id").select("lang", "source", (F.col("quality") == 1).alias("answerable"), F.when(F.col("toxic") == 1, "wrong").when(F.col("n_chars") > 2000, "hold").otherwise("correct").alias("outcome"))
    return Q.gate_report(r, ["lang", "source"])


@query("a17_latency_summary", """SELECT event_type, median(value) AS median, quantile_disc(value, 0.9) AS p90, max(value) AS max, count(*) AS cases FROM events WHERE value < 200 GROUP BY event_type""")
def a17(t: Tables):
    return Q.latency_summary(t.events.withColumn("error", F.col("value") >= 200), ["event_type"], "value")


@query("a20_label_status", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a20(t: Tables):
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("l1_ranked_proposals", """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, count(*) AS n FROM i x JOIN i y ON x.o = y.o AND x.p < y.p GROUP BY ALL ORDER BY n DESC, a, b LIMIT 25""")
def l1(t: Tables):
    items = t.lineitem.select(F.col("l_orderkey").alias("passage"), F.col("l_partkey").alias("term")).distinct()
    return C.pairs_within(items, ["passage"]).groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(25)


@query("l2_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def l2(t: Tables):
    return t.documents.select("doc_id").orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("u2_overlay_union", """SELECT DISTINCT a.item_id, a.phrase FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS phrase FROM benchmark UNION ALL SELECT item_id, text FROM benchmark) a
 WHERE (a.item_id, a.phrase) NOT IN (SELECT (item_id, text) FROM benchmark WHERE length(text) > 200)""")
def u2(t: Tables):
    base = t.benchmark.select("item_id", F.explode(F.split("text", "\n")).alias("phrase"))
    whole = t.benchmark.select("item_id", F.col("text").alias("phrase"))
    return TB.overlay(base, whole, whole.filter(F.length("phrase") > 200), ["item_id", "phrase"])


@query("u5_regression_diff", """SELECT doc_id, CASE WHEN coalesce(b.r, FALSE) = coalesce(a.r, FALSE) THEN 'same' WHEN coalesce(a.r, FALSE) THEN 'fixed' ELSE 'broken' END AS change FROM (SELECT doc_id, quality = 1 AS r FROM labels) b FULL JOIN (SELECT doc_id, n_chars < 3000 AS r FROM documents) a USING (doc_id)""")
def u5(t: Tables):
    return Q.regression_diff(t.labels.select("doc_id", (F.col("quality") == 1).alias("right")), t.documents.select("doc_id", (F.col("n_chars") < 3000).alias("right")), "doc_id")


@query("q7_tree_hash", """WITH h AS (SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), text, lang, source)) AS h FROM documents), a AS (SELECT h AS k, h || ':' || count(*) AS d FROM h GROUP BY h),
 b AS (SELECT substr(k, 1, 6) AS k6, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM a GROUP BY k6), c AS (SELECT substr(k6, 1, 3) AS k3, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM b GROUP BY k3)
 SELECT sha256(string_agg(d, ',' ORDER BY d)) AS digest FROM c""")
def q7(t: Tables):
    return Q.bucketed_digest(t.documents, F.concat_ws("|", F.col("doc_id").cast("string"), "text", "lang", "source"))


@query("q3_interception_audit", f"""WITH {SCORES_SQL}, {MP.THEFT_SQL} SELECT source, count(*) AS taken, count(*) FILTER (winners > 8) AS given_up FROM c GROUP BY source""")
def q3(t: Tables):
    return MP.thefts(t).groupBy("source").agg(F.count("*").alias("taken"), F.count_if("given_up").alias("given_up"))


@query("m3_nearest", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
 s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
 SELECT vec_id, other, score, k FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS k FROM s) WHERE k <= 3""")
def m3(t: Tables):
    from ..operators.vectors import nearest

    return nearest(t.embeddings, "vec_id", "embedding", "label", 3)


M1_SQL = f"""tr AS (SELECT doc_id, quality AS label, text FROM documents JOIN labels USING (doc_id)), td AS (SELECT * FROM tr WHERE doc_id % 2 = 0), sd AS (SELECT * FROM tr WHERE doc_id % 2 = 1)"""


@query("m1_label_scorer")
def m1(t: Tables):
    """Quality labels of documents, trained on even and applied to odd document numbers."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("quality").cast("string").alias("label"), "text")
    model = C.train_label_scorer(rows.filter("doc_id % 2 = 0").select("text", "label"), ["0", "1"])
    return C.apply_label_scorer(model, rows.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), "text"))
