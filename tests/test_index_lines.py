import tempfile

import duckdb

from evidence_spark.plans import catalog


def test_index_keeps_blank_and_one_letter_lines(spark):
    """a4 gives the rows of its SQL for lines of spaces and of one letter as well."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = [(1, "a\n \nsecond line\n\n\t", "en", "src0"), (2, "x", "en", "src1"), (3, "   ", "en", "src1"), (4, None, "en", "src0")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["a4_build_index"](spark, root).select("source", "node", "ord", "priority", "phrase").collect()
    want = con.execute(catalog.ORACLES["a4_build_index"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) == 6
