"""Scalar text functions as Column expressions: all stay inside the JVM, one row in, one value out."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

START, END = "\x02", "\x03"
HANGUL = "가-힣"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a `let` for Column expressions)."""
    return F.transform(F.array(value), body)[0]


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+(?:\.\d+)?", "§")


def squeeze(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, W.WS, ""))


def joined(c: Column) -> Column:
    """Lower case, only digits, Latin letters and Hangul syllables."""
    return F.lower(F.regexp_replace(c, f"[^0-9A-Za-z{HANGUL}]", ""))


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, W.WS + "+", " "))


def unescape(c: Column) -> Column:
    for name, char in W.HTML_ENTITIES.items():  # the ampersand entity comes last
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def sanitize(c: Column, n: int | None = None) -> Column:
    """One clean line: tags vanish (words stay whole), entities resolved, controls and runs become a space; with ``n`` cut
    after so many characters."""
    c = unescape(F.regexp_replace(c, "<[^>]+>", ""))
    c = one_space(F.regexp_replace(c, r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}]", " "))
    c = F.trim(F.regexp_replace(c, r'^"+|"+$', ""))
    return c if n is None else F.trim(F.substring(c, 1, n))


def flatten_jamo(c: Column) -> Column:
    """Spell Hangul syllables as their letters; every other character is kept."""
    # The letters of each slot are consecutive code points, so three constant strings hold them all.
    lead = "".join(chr(0x1100 + i) for i in range(19))
    vowel = "".join(chr(0x1161 + i) for i in range(21))
    tail = "".join(chr(0x11A8 + i) for i in range(27))

    def letters(ch: Column) -> Column:
        k = F.ascii(ch) - 44032
        spelled = F.concat(
            F.substring(F.lit(lead), F.floor(k / 588).cast("int") + 1, F.lit(1)),
            F.substring(F.lit(vowel), F.floor((k % 588) / 28).cast("int") + 1, F.lit(1)),
            F.when(k % 28 > 0, F.substring(F.lit(tail), (k % 28).cast("int"), F.lit(1))).otherwise(""),
        )
        return F.when(ch.rlike(f"[{HANGUL}]"), spelled).otherwise(ch)

    spelled = F.array_join(F.transform(F.split(c, ""), letters), "")
    return F.when(c.rlike(f"[{HANGUL}]"), spelled).otherwise(c)


def marked(base: Column) -> Column:
    """Every word carries its own start and end mark."""
    return F.concat(F.lit(START), F.regexp_replace(base, W.WORD_BREAK, END + START), F.lit(END))


def _slices(t: Column, sizes: Sequence[int]) -> Column:
    """All overlapping slices, cut from the character array so that non-ASCII text stays linear."""

    def cut(chars: Column, n: int) -> Column:
        heads = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.concat(x, *[F.get(chars, i + j) for j in range(1, n)]))

    return bind(F.split(t, ""), lambda chars: F.concat(*[cut(chars, n) for n in sizes]))


def run_lengths(ordered: Column) -> Column:
    """Sorted array -> array<struct<gram, n>> in linear time."""

    def starts(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(a) - 1)
        return F.filter(places, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))

    def counted(a: Column) -> Column:
        return bind(
            starts(a),
            lambda s: F.transform(
                s,
                lambda p, k: F.struct(
                    F.get(a, p).alias("gram"),
                    (F.coalesce(F.get(s, k + 1), F.size(a)) - p).cast("bigint").alias("n"),
                ),
            ),
        )

    return bind(ordered, counted)


def gram_list(c: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """All character slices with repeats; letter-level slices are added only where there is Hangul."""
    base = F.trim(mask_numbers(c))
    return _slices(marked(base), sizes)


def jamo_gram_list(c: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    base = F.trim(mask_numbers(c))
    return _slices(marked(flatten_jamo(base)), sizes)


def char_grams(c: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """array<struct<gram, n>>: gram counts of the masked, word-marked text."""
    return run_lengths(F.sort_array(gram_list(c, sizes)))


def weighted_grams(c: Column) -> Column:
    """array<struct<gram, n>> where n is an integer weight.

    A slice of the plain text weighs 2 and one of the letter spelling 1 (i.e. 1.0 and 0.5, doubled so
    that sums stay exact).  Without Hangul both spellings are the same text, so each slice weighs 3.
    """
    plain = F.transform(char_grams(c), lambda x: F.struct(x["gram"].alias("gram"), (x["n"] * 3).alias("n")))
    both = F.concat(gram_list(c), gram_list(c), jamo_gram_list(c))
    return F.when(c.rlike(f"[{HANGUL}]"), run_lengths(F.sort_array(both))).otherwise(plain)


def detect_lang_script(c: Column) -> Column:
    hangul = F.regexp_count(c, F.lit(f"[{HANGUL}]"))
    latin = F.regexp_count(c, F.lit("[A-Za-z]"))
    latin_words = F.regexp_count(c, F.lit(r"[A-Za-z][A-Za-z0-9_.\-]*"))
    return (
        F.when((hangul == 0) & (latin == 0), "mixed")
        .when(latin == 0, "korean")
        .when((hangul == 0) & (latin_words < 2), "mixed")
        .when(hangul == 0, "english")
        .when(hangul >= 2, "korean")
        .otherwise("english")
    )


def strip_question_shell(c: Column, shell: Sequence[str] = W.ENGLISH_QUESTION_WORDS) -> Column:
    """Content words of a question: Latin words that do not merely frame it, then the Hangul words."""
    latin = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_.\-]*"), F.lit(0))
    core = F.filter(latin, lambda w: ~F.lower(w).isin(list(shell)))
    hangul = F.regexp_extract_all(c, F.lit(f"[{HANGUL}]+"), F.lit(0))
    return F.when(F.size(core) > 0, F.array_join(F.concat(core, hangul), " ")).otherwise(c)


def strip_fillers(c: Column, heads: Sequence[str] = W.FILLER_HEADS) -> Column:
    """Text without its leading fillers; empty when nothing was stripped or nothing would remain."""
    parts = []
    for head in sorted(heads, key=lambda h: (-len(h), h)):
        guard = ""
        if len(head) == 1:
            guard = r"(?=$|[,.…~·])"
        elif head[-1].isascii() and head[-1].isalpha():
            guard = r"(?![\p{L}\p{N}])"
        parts.append(re.escape(head) + guard)
    pattern = "^(?:(?:" + "|".join(parts) + r")[ ,.…·~!?]*)+"
    text = F.trim(c)
    rest = F.regexp_replace(text, pattern, "")
    return F.when(rest == text, "").otherwise(rest)


def clauses(c: Column) -> Column:
    """Sentence-like parts longer than three characters."""
    parts = F.transform(F.split(c, r"(?<=[.!?。！？])[\t-\r ]+|[\n;]+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) > 3)


def fragments(c: Column, heads: Sequence[str] = W.FILLER_HEADS) -> Column:
    """Candidate readings in order: the filler-free text if any, the text, its clauses, its content words."""
    parts = clauses(c)
    bare = strip_fillers(c, heads)
    empty = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.when(bare != "", F.array(bare)).otherwise(empty),
            F.array(c),
            F.when(F.size(parts) > 1, parts).otherwise(empty),
            F.array(strip_question_shell(c)),
        )
    )


def sentences(c: Column, lo: int = 1, hi: int | None = None) -> Column:
    """Clean sentences, all that are not empty; with bounds those whose length lies in [lo, hi]."""
    parts = F.transform(F.split(c, r"(?<=[.!?])[\t-\r ]+|\n+"), one_space)
    return F.filter(parts, lambda s: F.length(s) >= lo if hi is None else F.length(s).between(lo, hi))


def complete_sentences(c: Column) -> Column:
    """Distinct sentences of at least 12 characters that end in terminal punctuation, in order."""
    # A match begins where its run does: a later start in a run that ends wrongly would read the rest of it again.
    found = F.regexp_extract_all(c, F.lit(r"(?<![^.!?。！？\n])[^.!?。！？\n]{12,}+[.!?。！？](?=\s|$)"), F.lit(0))
    clean = F.transform(found, lambda s: sanitize(s))
    return F.array_distinct(F.filter(clean, lambda s: ~s.endswith("...") & ~s.endswith("…")))


def _longest_first(values: Sequence[str]) -> str:
    return "|".join(re.escape(v) for v in sorted(set(values), key=lambda v: (-len(v), v)))


def drop_particle(c: Column, suffixes: Sequence[str] = W.KOREAN_PARTICLES) -> Column:
    """Strip the longest declared suffix, provided two characters remain."""
    return F.regexp_replace(c, f"(?s)^(.{{2,}}?)(?:{_longest_first(suffixes)})$", "$1")


def word_span_pattern(word: str, suffixes: Sequence[str] = W.KOREAN_PARTICLES) -> str:
    """Regex for ``word`` used as a word: nothing of the script before, end or a declared suffix after."""
    h = f"[{HANGUL}]"
    return f"(?<!{h}){re.escape(word)}(?=$|(?!{h})|(?:{_longest_first(suffixes)})(?!{h}))"


def word_count(c: Column, word: str, suffixes: Sequence[str] = W.KOREAN_PARTICLES) -> Column:
    return F.regexp_count(c, F.lit(word_span_pattern(word, suffixes)))


def latin_word_pattern(word: str) -> str:
    """The same for languages that write spaces: bounded by non-letters on both sides."""
    return rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])"


def bare_words(c: Column) -> Column:
    """Distinct 2-6 letter words together with their suffix-free forms."""
    found = F.regexp_extract_all(c, F.lit(f"[{HANGUL}A-Za-z]{{2,6}}"), F.lit(0))
    return F.array_distinct(F.concat(found, F.transform(found, lambda w: drop_particle(w))))


def content_terms(c: Column, min_len: int = 2) -> Column:
    """Lower-case letter runs, with repeats."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= min_len)


def extract_numbers(c: Column) -> Column:
    """array<struct<value, unit, certain>>.

    Scale words multiply, falling scales add up to one number, a range or a spelled-out count makes every
    number uncertain.
    """
    scales = "".join(W.NUMBER_SCALES)
    number = rf"\d[\d,]*(?:\.\d+)?(?:\s*[{scales}])*\s*(?:[%％]|[{HANGUL}a-zA-Z]{{0,4}})"
    vague = c.rlike(r"[~–—-]\s*\d|\d\s*[~–—]") | c.rlike(r"[영일이삼사오육칠팔구]\s*[십백천만억조]")
    head = rf"^(\d[\d,]*(?:\.\d+)?)((?:\s*[{scales}])*)\s*(.*)$"
    # Keep the gap before each number too: only numbers at most two characters apart join.  Each piece starts
    # where the last one ended (\\G), so text without digits is scanned once.
    pieces = F.regexp_extract_all(c, F.lit(rf"\G\D*+{number}"), F.lit(0))

    def parse(piece: Column) -> Column:
        tail = F.regexp_extract(piece, r"(?s)^\D*+(.*)$", 1)
        gap = F.length(piece) - F.length(tail)
        digits = F.regexp_extract(tail, head, 2)
        factor = F.lit(1.0)
        for word, size in W.NUMBER_SCALES.items():
            factor = factor * F.pow(F.lit(float(size)), F.regexp_count(digits, F.lit(word)))
        value = F.regexp_replace(F.regexp_extract(tail, head, 1), ",", "").try_cast("double") * factor
        unit = F.trim(F.regexp_extract(tail, head, 3))
        return F.struct(
            value.alias("value"), unit.alias("unit"), F.lit(True).alias("certain"),
            factor.alias("scale"), gap.cast("int").alias("gap"),
        )

    parsed = F.transform(pieces, parse)
    start = F.array().cast("array<struct<value:double,unit:string,certain:boolean,scale:double,gap:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["unit"] == "") & (x["gap"] <= 2)
        merged = F.struct(
            (last["value"] + x["value"]).alias("value"), x["unit"].alias("unit"),
            (last["certain"] & (x["scale"] < last["scale"])).alias("certain"),
            x["scale"].alias("scale"), x["gap"].alias("gap"),
        )
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(
            F.concat(acc, F.array(x))
        )

    folded = F.aggregate(parsed, start, step)
    unread = F.array(F.struct(F.lit(None).cast("double").alias("value"), F.lit("").alias("unit"),
                              F.lit(False).alias("certain")))
    result = bind(vague, lambda v: F.transform(folded, lambda x: F.struct(
        x["value"].alias("value"), x["unit"].alias("unit"), (x["certain"] & ~v).alias("certain"))))
    return F.when((F.size(parsed) == 0) & vague, unread).otherwise(result)


def format_number(value: Column, unit: Column) -> Column:
    """Six significant digits without padding; large amounts of the scaled unit use its scale words."""

    def g(v: Column) -> Column:
        text = F.format_string("%.10f", F.round(v, 10))
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return (
        F.when((unit == "원") & (value >= 10**8), F.concat(g(value / 10**8), F.lit("억원")))
        .when((unit == "원") & (value >= 10**4), F.concat(g(value / 10**4), F.lit("만원")))
        .otherwise(F.concat(g(value), unit))
    )


def intent(c: Column, markers: Sequence[tuple[str, str]], default: str = "definition") -> Column:
    """The declared marker that wins: one ending within the last three characters, then the earliest, then the longest."""
    t = F.regexp_replace(c, W.WS, "")

    def rank(text: Column, size: Column) -> Column:
        rows = []
        for key, value in markers:
            flat = "".join(key.split())
            at = F.instr(text, flat)
            tail = at - 1 + len(flat) >= size - 3
            rows.append(F.when(at > 0, F.struct(
                F.when(tail, 0).otherwise(1).alias("t"), at.alias("p"), F.lit(-len(flat)).alias("l"),
                F.lit(value).alias("v"))))
        return F.array_min(F.array_compact(F.array(*rows)))["v"]

    return F.coalesce(bind(t, lambda x: rank(x, F.length(x))), F.lit(default))


# Sentence kinds in the order they are tried.
CLAIM_RULES = [
    ("definition", r"(?i)\b(is|are) (a|an|the)\b|\bmeans\b|\brefers to\b"),
    ("causal", r"(?i)\b(because|therefore|causes?|leads? to|results? in)\b"),
    ("procedure", r"(?i)^(first|then|next|finally|step)\b"),
    ("limitation", r"(?i)\b(however|but|cannot|not|only|limited)\b"),
    ("evidence", r"(?i)\b(shows?|according to|measured|observed)\b"),
]
PRONOUN_RULE = r"(?i)^(this|that|these|those|it|they)\b"


def classify_sentence(c: Column, rules: Sequence[tuple[str, str]] = CLAIM_RULES) -> Column:
    """First rule that matches; a finished sentence that is no question is a statement; else null."""
    found = F.coalesce(*[F.when(c.rlike(pattern), F.lit(kind)) for kind, pattern in rules])
    return F.coalesce(found, F.when(c.endswith("."), F.lit("statement")))


def needs_review(c: Column) -> Column:
    """Starts with a pronoun whose referent was left behind."""
    return c.rlike(PRONOUN_RULE)


def jamo_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance on letters; -1 when it exceeds ``limit``."""
    return F.levenshtein(flatten_jamo(a), flatten_jamo(b), limit)


def truncate_excerpt(c: Column, n: int = 190) -> Column:
    """Cut at the last comma or space before ``n`` and add an ellipsis; short text gets its full stop."""
    cut = F.substring(c, 1, n)
    at_break = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    kept = F.regexp_replace(F.when(at_break == "", cut).otherwise(at_break), "[ ,]+$", "")
    done = c.rlike(r"[.다요함음…]$")
    return F.when(F.length(c) > n, F.concat(kept, F.lit("…"))).when(done, c).otherwise(F.concat(c, F.lit(".")))


def url_domain(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def signed_hash(gram: Column, dim: int = 4096) -> tuple[Column, Column]:
    """(slot, sign) of a gram."""
    raw = F.encode(gram, "UTF-8")
    slot = F.pmod(F.crc32(raw), F.lit(dim)).cast("int")
    sign = F.when(F.pmod(F.crc32(F.concat(raw, F.lit(bytearray(b"\x00")))), F.lit(2)) == 1, 1).otherwise(-1)
    return slot, sign


def html_blocks(c: Column) -> Column:
    """Visible text blocks of at least 30 characters, in document order, first of equals only."""
    for tag in W.HTML_DROP:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(W.HTML_BLOCK)})\b[^>]*>", "\x1e")
    parts = F.transform(F.split(c, "\x1e"), lambda b: sanitize(b))
    return F.array_distinct(F.filter(parts, lambda b: F.length(b) >= 30))
