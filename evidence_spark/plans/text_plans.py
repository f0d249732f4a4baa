"""Queries for projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula, text as T, vectors
from ..functions import words as W
from ..functions.counts import gram_counts
from .registry import WS_SQL, Tables, query

SHELL_SQL = ", ".join(f"'{w}'" for w in W.ENGLISH_QUESTION_WORDS)


@query("p1_mask_numbers", r"SELECT doc_id, regexp_replace(text, '\d+(?:\.\d+)?', '§', 'g') AS masked FROM documents")
def p1(t: Tables):
    return t.documents.select("doc_id", T.mask_numbers(F.col("text")).alias("masked"))


_SANITIZE = rf"""trim(substr(trim(regexp_replace(trim(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({{x}}, '<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
  '[\x{{{{00}}}}-\x{{{{08}}}}\x{{{{0b}}}}\x{{{{0c}}}}\x{{{{0e}}}}-\x{{{{1f}}}}\x{{{{7f}}}}]', ' ', 'g'),
  '{WS_SQL.replace("{", "{{").replace("}", "}}")}+', ' ', 'g')), '^"+|"+$', '', 'g')), 1, {{n}}))"""


def sanitize_sql(x: str, n: int = 2**31 - 1) -> str:
    return _SANITIZE.replace("{x}", x).replace("{n}", str(n)).replace("{{", "{").replace("}}", "}")


@query("p2_sanitize", f"SELECT page_id, {sanitize_sql('html')} AS clean FROM pages")
def p2(t: Tables):
    return t.pages.select("page_id", T.sanitize(F.col("html")).alias("clean"))


@query("p3_squeeze", rf"""SELECT doc_id, lower(regexp_replace(text, '{WS_SQL}', '', 'g')) AS squeezed,
  lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g')) AS joined FROM documents""")
def p3(t: Tables):
    return t.documents.select("doc_id", T.squeeze(F.col("text")).alias("squeezed"), T.joined(F.col("text")).alias("joined"))


# The splitting of whole documents into slices is quadratic in SQL, so the SQL twin slices line by line:
# a line break is a word break, hence the line-wise counts are those of the operator on each line.
@query("p4_char_grams", r"""WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS phrase FROM documents),
 m AS (SELECT doc_id, chr(2) || regexp_replace(trim(regexp_replace(phrase, '\d+(?:\.\d+)?', '§', 'g')),
   '[^\p{L}\p{N}]+', chr(3) || chr(2), 'g') || chr(3) AS t FROM l),
 g AS (SELECT doc_id, k, substr(t, i, k) AS gram FROM (
   SELECT doc_id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM m CROSS JOIN (VALUES (2), (3), (4)) AS s(k)))
 SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL""")
def p4(t: Tables):
    # The table as it is: texts are dealt by document anyway.
    return gram_counts(t.spark.read.parquet(t.path("documents")), "doc_id", "text")


@query("p5_flatten_jamo", """SELECT doc_id, replace(replace(replace(replace(replace(
  translate(text, 'aeiou', '각네디롱후'), '각', chr(4352) || chr(4449) || chr(4520)), '네', chr(4354) || chr(4454)),
  '디', chr(4355) || chr(4469)), '롱', chr(4357) || chr(4457) || chr(4540)), '후', chr(4370) || chr(4462)) AS letters
  FROM documents""")
def p5(t: Tables):
    return t.documents.select("doc_id", T.flatten_jamo(F.translate("text", "aeiou", "각네디롱후")).alias("letters"))


@query("p6_detect_lang_script", r"""WITH x AS (SELECT doc_id, translate(text, 'z', '각') AS t FROM documents), c AS (
  SELECT doc_id, len(regexp_extract_all(t, '[가-힣]')) AS h, len(regexp_extract_all(t, '[A-Za-z]')) AS l,
         len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_.\-]*')) AS w FROM x)
  SELECT doc_id, CASE WHEN h = 0 AND l = 0 THEN 'mixed' WHEN l = 0 THEN 'korean' WHEN h = 0 AND w < 2 THEN 'mixed'
    WHEN h = 0 THEN 'english' WHEN h >= 2 THEN 'korean' ELSE 'english' END AS script FROM c""")
def p6(t: Tables):
    return t.documents.select("doc_id", T.detect_lang_script(F.translate("text", "z", "각")).alias("script"))


@query("p7_strip_question_shell", rf"""WITH x AS (
  SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\-]*'),
    lambda w: lower(w) NOT IN ({SHELL_SQL})) AS core FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, CASE WHEN len(core) > 0 THEN array_to_string(core, ' ') ELSE text END AS content FROM x""")
def p7(t: Tables):
    return t.user_turns().select("conv_id", "turn", T.strip_question_shell(F.col("text")).alias("content"))


LATIN_FILLERS = ["The", "And", "Of"]
_BARE_SQL = r"""regexp_replace(trim(text), '^((The|And|Of)\b[ ,.…·~!?]*)+', '')"""


@query("p8_strip_fillers", f"""SELECT conv_id, turn, CASE WHEN {_BARE_SQL} = trim(text) THEN '' ELSE {_BARE_SQL} END AS bare
  FROM conversations""")
def p8(t: Tables):
    return t.conversations.select("conv_id", "turn", T.strip_fillers(F.col("text"), LATIN_FILLERS).alias("bare"))


CLAUSES_SQL = r"""list_filter(list_transform(regexp_split_to_array(
  regexp_replace(text, '([.!?。！？])[\t-\r ]+', '\1' || chr(10), 'g'), '[\n;]+'), lambda p: trim(p)), lambda p: length(p) > 3)"""


@query("p9_fragments", rf"""WITH x AS (SELECT conv_id, turn, text, {_BARE_SQL} AS rest, {CLAUSES_SQL} AS parts,
   list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\-]*'), lambda w: lower(w) NOT IN ({SHELL_SQL})) AS core
   FROM conversations WHERE role = 'user'),
 f AS (SELECT conv_id, turn, rest AS fragment, 0 AS o FROM x WHERE rest <> trim(text) AND rest <> ''
   UNION ALL SELECT conv_id, turn, text, CASE WHEN rest <> trim(text) AND rest <> '' THEN 1 ELSE 0 END FROM x
   UNION ALL SELECT conv_id, turn, unnest(parts), 2 FROM x WHERE len(parts) > 1
   UNION ALL SELECT conv_id, turn, CASE WHEN len(core) > 0 THEN array_to_string(core, ' ') ELSE text END, 3 FROM x)
 SELECT conv_id, turn, fragment, CASE WHEN min(o) = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS weight FROM f GROUP BY ALL""")
def p9(t: Tables):
    return t.user_turns().select(
        "conv_id", "turn", F.posexplode(T.fragments(F.col("text"), LATIN_FILLERS)).alias("pos", "fragment")
    ).select("conv_id", "turn", "fragment", F.when(F.col("pos") == 0, 1.0).otherwise(W.FRAGMENT_WEIGHT).alias("weight"))


SENTENCES_SQL = rf"""list_filter(list_transform(regexp_split_to_array(
  regexp_replace(text, '([.!?])[\t-\r ]+', '\1' || chr(10), 'g'), '\n+'),
  lambda s: trim(regexp_replace(s, '{WS_SQL}+', ' ', 'g'))), lambda s: length(s) >= 1)"""


@query("p10_sentences", f"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS sentence FROM documents)
  SELECT doc_id, sentence, count(*) AS n FROM s GROUP BY ALL""")
def p10(t: Tables):
    return (
        t.documents.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
        .groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))
    )


@query("p10b_complete_sentences", rf"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(
   regexp_replace(text, '([.!?。！？])([\t-\r ])', '\1' || chr(1) || '\2', 'g'), '[^.!?。！？\n\x01]{{12,}}[.!?。！？](?:\x01|$)')) AS raw FROM documents),
  c AS (SELECT doc_id, {sanitize_sql('raw')} AS sentence FROM s)
  SELECT DISTINCT doc_id, sentence FROM c WHERE NOT ends_with(sentence, '...') AND NOT ends_with(sentence, '…')""")
def p10b(t: Tables):
    rows = t.documents.select("doc_id", F.explode_outer(T.complete_sentences(F.col("text"))).alias("sentence"))
    return rows.filter(F.col("sentence").isNotNull())


# Words with a Hangul ending made from the given text, so that suffixes occur.
_PARTICLE_CASE = " ".join(
    f"WHEN ends_with(w, '{p}') AND length(w) - {len(p)} >= 2 THEN substr(w, 1, length(w) - {len(p)})"
    for p in sorted(set(W.KOREAN_PARTICLES), key=lambda v: (-len(v), v))
)


@query("p11_drop_particle", f"""WITH w AS (SELECT DISTINCT unnest(string_split(translate(text, 'eaond', '은에서도부'), ' ')) AS w
   FROM benchmark) SELECT w AS word, CASE {_PARTICLE_CASE} ELSE w END AS stem FROM w""")
def p11(t: Tables):
    words = t.benchmark.select(
        F.explode(F.split(F.translate("text", "eaond", "은에서도부"), " ")).alias("word")
    ).distinct()
    return words.select("word", T.drop_particle(F.col("word")).alias("stem"))


@query("p12_word_spans", """SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS spans,
  CAST(position('the' IN text) AS BIGINT) AS first_at FROM documents""")
def p12(t: Tables):
    return t.documents.select(
        "doc_id", T.word_count(F.col("text"), "the").cast("bigint").alias("spans"),
        F.regexp_instr("text", F.lit(T.word_span_pattern("the"))).cast("bigint").alias("first_at"),
    )


@query("p13_bare_words", f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'e', '은'), '[가-힣A-Za-z]{{2,6}}')) AS w
    FROM documents), b AS (SELECT doc_id, w FROM f UNION ALL SELECT doc_id, CASE {_PARTICLE_CASE} ELSE w END FROM f)
  SELECT DISTINCT doc_id, w AS word FROM b""")
def p13(t: Tables):
    return t.documents.select("doc_id", F.explode(T.bare_words(F.translate("text", "e", "은"))).alias("word"))


@query("p14_extract_numbers", """SELECT p_partkey, CAST(p_size AS DOUBLE) * 10000 AS value, '원' AS unit, TRUE AS certain FROM part
  UNION ALL SELECT p_partkey, p_retailprice, 'mm', TRUE FROM part""")
def p14(t: Tables):
    text = F.concat(F.col("p_type"), F.lit(" "), F.col("p_size"), F.lit("만원 at "), F.col("p_retailprice").cast("string"), F.lit(" mm"))
    return t.part.select("p_partkey", F.inline(T.extract_numbers(text)))


@query("p14b_numbers_in_documents")
def p14b(t: Tables):
    return t.documents.select("doc_id", F.inline(T.extract_numbers(F.col("text"))))


@query("p15_format_number", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity * 1000 >= 10000 THEN regexp_replace(regexp_replace(printf('%.4f', l_quantity / 10), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '만원'
       ELSE CAST(CAST(l_quantity * 1000 AS BIGINT) AS VARCHAR) || '원' END AS shown FROM lineitem""")
def p15(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             T.format_number(F.col("l_quantity") * 1000, F.lit("원")).alias("shown"))


@query("p16_eval_formula", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) / l_quantity AS unit_price,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS ratio, CAST(NULL AS DOUBLE) AS missing FROM lineitem""")
def p16(t: Tables):
    values = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "quantity": F.col("l_quantity"), "tax": F.col("l_tax")}
    rules = {"unit_price": "price * (1 - discount) / quantity", "ratio": "discount / tax", "missing": "price / people"}
    shown = [formula.value_column(rule, values).alias(name) for name, rule in rules.items()]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *shown)


INTENT_MARKERS = [("the", "topic"), ("with", "means"), ("tion", "event"), ("le", "place"), ("ung", "state"), ("that", "reason")]
_INTENT_ROWS = " UNION ALL ".join(
    f"SELECT item_id, CASE WHEN p - 1 + {len(k)} >= length(s) - 3 THEN 0 ELSE 1 END AS tail, p, -{len(k)} AS l, '{v}' AS v "
    f"FROM (SELECT item_id, s, position('{k}' IN s) AS p FROM b) WHERE p > 0" for k, v in INTENT_MARKERS)


@query("p17_intent", f"""WITH b AS (SELECT doc_id AS item_id, regexp_replace(text, '{WS_SQL}', '', 'g') AS s FROM documents), r AS ({_INTENT_ROWS}),
  k AS (SELECT item_id, v, row_number() OVER (PARTITION BY item_id ORDER BY tail, p, l, v) AS rn FROM r)
  SELECT b.item_id AS doc_id, coalesce(k.v, 'definition') AS intent FROM b LEFT JOIN k ON k.item_id = b.item_id AND rn = 1""")
def p17(t: Tables):
    return t.documents.select("doc_id", T.intent(F.col("text"), INTENT_MARKERS).alias("intent"))


# Kinds for the given languages, in the order they are tried.
KIND_RULES = [("definition", "^The "), ("causal", " that "), ("procedure", "^(In|Und|Et|Y) "),
              ("limitation", " (not|nicht|pas|no) "), ("evidence", "tion ")]
_KIND_CASE = " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{k}'" for k, p in KIND_RULES)
REVIEW_SQL = "regexp_matches(sentence, '(?i)^(this|that|these|those|it|they)\\b')"
KIND_SQL = f"CASE {_KIND_CASE} WHEN ends_with(sentence, '.') THEN 'statement' END"


@query("p18_classify_sentence", f"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS sentence FROM documents)
  SELECT {KIND_SQL} AS kind, {REVIEW_SQL} AS review, count(*) AS n FROM s GROUP BY ALL""")
def p18(t: Tables):
    s = t.documents.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy(
        T.classify_sentence(F.col("sentence"), KIND_RULES).alias("kind"), T.needs_review(F.col("sentence")).alias("review")
    ).agg(F.count("*").alias("n"))


@query("p19_jamo_distance", """SELECT c_custkey, CASE WHEN levenshtein(c_name, 'Customer#' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0')) <= 2
  THEN levenshtein(c_name, 'Customer#' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0')) ELSE -1 END::INTEGER AS distance FROM customer""")
def p19(t: Tables):
    other = F.concat(F.lit("Customer#"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0"))
    return t.customer.select("c_custkey", T.jamo_distance(F.col("c_name"), other, 2).alias("distance"))


@query("p20_signed_hash_vector")
def p20(t: Tables):
    return vectors.signed_hash_vectors(t.benchmark, "item_id", "text")


@query("p21_quantize", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  s AS (SELECT label, max(abs(x)) / 127 AS scale FROM e GROUP BY label),
  d AS (SELECT vec_id, i, e.label, scale, x, greatest(-127, least(127, round(x / scale))) AS q FROM e JOIN s USING (label))
  SELECT label, round(max(scale), 9) AS scale, round(max(abs(q * scale - x)), 9) AS max_error, CAST(sum(q) AS BIGINT) AS q_sum,
    CAST(sum(q * i) AS BIGINT) AS q_check, count(DISTINCT vec_id) AS vectors FROM d GROUP BY label""")
def p21(t: Tables):
    packed = vectors.quantize(t.embeddings, "embedding", ["label"], bits=8)
    cells = packed.select("vec_id", "label", "scale", F.posexplode("q").alias("i", "q"), "embedding")
    back = F.col("q") * F.col("scale")
    exact = F.get("embedding", F.col("i")).cast("double")
    return cells.groupBy("label").agg(
        F.round(F.max("scale"), 9).alias("scale"), F.round(F.max(F.abs(back - exact)), 9).alias("max_error"),
        F.sum(F.col("q").cast("bigint")).alias("q_sum"), F.sum(F.col("q").cast("bigint") * (F.col("i") + 1)).alias("q_check"),
        F.countDistinct("vec_id").alias("vectors"))


@query("p22_truncate_excerpt", r"""WITH x AS (SELECT doc_id, text, substr(text, 1, 190) AS cut FROM documents),
  y AS (SELECT *, regexp_extract(cut, '(?s)^(.*) ', 1) AS b FROM x)
  SELECT doc_id, CASE WHEN length(text) > 190 THEN regexp_replace(CASE WHEN b = '' THEN cut ELSE b END, '[ ,]+$', '') || '…'
    WHEN right(text, 1) IN ('.', '다', '요', '함', '음', '…') THEN text ELSE text || '.' END AS excerpt FROM y""")
def p22(t: Tables):
    return t.documents.select("doc_id", T.truncate_excerpt(F.col("text")).alias("excerpt"))


DOMAIN_SQL = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query("p23_strip_url_domain", f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def p23(t: Tables):
    return t.pages.select("page_id", T.url_domain(F.col("url")).alias("domain"))
