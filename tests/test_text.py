from pyspark.sql import functions as F

from evidence_spark.functions import formula, text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_mask_and_grams(spark):
    assert one(spark, "12.5 and 3", T.mask_numbers) == "§ and §"
    got = {(r["gram"], r["n"]) for r in one(spark, "ab", T.char_grams)}
    s, e = "\x02", "\x03"
    assert got == {(g, 1) for g in (s + "a", "ab", "b" + e, s + "ab", "ab" + e, s + "ab" + e)}


def test_jamo_and_particles(spark):
    a, b = one(spark, "해고", T.flatten_jamo), one(spark, "해구", T.flatten_jamo)
    assert len(a) == len(b) == 4 and a[:3] == b[:3] and a[3] != b[3]
    assert one(spark, "생태는", T.drop_particle) == "생태"
    assert one(spark, "사과", T.drop_particle) == "사과"
    assert one(spark, "가격을 봤다", lambda c: T.word_count(c, "가격")) == 1
    assert one(spark, "가격표를 봤다", lambda c: T.word_count(c, "가격")) == 0


def test_numbers(spark):
    got = one(spark, "12만원", T.extract_numbers)
    assert [(r["value"], r["unit"], r["certain"]) for r in got] == [(120000.0, "원", True)]
    assert all(not r["certain"] for r in one(spark, "3~4명", T.extract_numbers))
    assert [(r["value"], r["unit"]) for r in one(spark, "3억 5천만원", T.extract_numbers)] == [(350000000.0, "원")]


def test_fillers_shell_script(spark):
    assert one(spark, "so, what is DNS", T.strip_fillers) == "what is DNS"
    assert one(spark, "sofa", T.strip_fillers) == ""
    assert one(spark, "what is DNS", T.strip_question_shell) == "DNS"
    assert one(spark, "CCTV", T.detect_lang_script) == "mixed"
    assert one(spark, "CCTV 확인", T.detect_lang_script) == "korean"


def test_formula(spark):
    df = spark.createDataFrame([(120000.0, 3.0, 0.0)], "total double, people double, none double")
    v = {c: F.col(c) for c in df.columns}
    row = df.select(formula.value_column("total / people", v).alias("a"), formula.value_column("total / none", v).alias("b"),
                    formula.value_column("total / who", v).alias("c"), formula.value_column("__import__('os')", v).alias("d")).first()
    assert row["a"] == 40000 and row["b"] is None and row["c"] is None and row["d"] is None


def test_html_blocks(spark):
    html = "<nav><p>menu menu menu menu menu menu menu menu</p></nav><p>A <b>visible</b> block of more than thirty characters.</p><p>short</p>" * 2
    assert one(spark, html, T.html_blocks) == ["A visible block of more than thirty characters."]


def test_complete_sentences_in_linear_time(spark):
    import time

    text = "a line without an end " * 20_000 + "\nBut this one has one. And so has this! short. a.bc defghijklmnop. No end"
    t0 = time.time()
    assert one(spark, text, T.complete_sentences) == ["But this one has one.", "And so has this!", "bc defghijklmnop."]
    assert time.time() - t0 < 30
