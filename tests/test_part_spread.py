"""A table in one small file is spread over the cores before heavy work on each row."""

from evidence_spark.plans.catalog import QUERIES


def test_coverage_of_parts_uses_all_cores(spark):
    df = QUERIES["x2_coverage_function"](spark, "/root/testdata/sf0.001")
    assert "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()
