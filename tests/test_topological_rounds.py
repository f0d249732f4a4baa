"""Levels of plans: right with cycles and missing steps, and dependencies are worked out once, not in every round."""

from pyspark.sql import functions as F

from evidence_spark.operators import graph as G


def test_levels_read_their_dependencies_once(spark):
    steps = [(1, s) for s in range(6)] + [(2, s) for s in range(3)] + [(3, 0), (4, 0), (4, 1)]
    needs = [(1, s, s - 1) for s in range(1, 6)] + [(1, 5, 0), (2, 1, 0), (2, 0, 1), (3, 0, 9), (4, 1, 0)]
    seen = spark.sparkContext.accumulator(0)

    def look(step):
        seen.add(1)
        return step

    depends = spark.createDataFrame(needs, "plan int, step int, needs int").withColumn("step", F.udf(look, "int")("step"))
    got = sorted((r.plan, r.step, r.level) for r in G.topological_levels(spark.createDataFrame(steps, "plan int, step int"), depends).collect())
    assert got == [(1, s, s) for s in range(6)] + [(4, 0, 0), (4, 1, 1)]
    assert seen.value == len(needs)
