"""Texts are copied, and links leave tasks, once for each group, not for each of its blocks."""

from evidence_spark.operators import match as M


def test_copies_and_links_do_not_grow_with_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIR_BLOCK", 10)
    texts = [f"the long sentence about bridges and rivers in the north x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = spark.createDataFrame([*enumerate(texts)], "u int, text string")
    asked = rows.withColumnRenamed("text", "question")
    side = round((4 * spark.sparkContext.defaultParallelism) ** 0.5)  # tiles and blocks of texts that are as many
    assert M._deal(rows, "text", asked, "question").count() == 2 * side * 120
    links = M.coverage_pairs(rows, "text", asked, "question", 0.8, forest=True).select("it", "ot")
    assert 119 <= links.count() < 2 * side * 120
