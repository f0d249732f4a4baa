"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from evidence_spark.plans.catalog import QUERIES  # noqa: E402
from evidence_spark.session import local_session  # noqa: E402

HEADLINE = [
    "p10_sentences", "a4_build_index", "f4_topic_related", "j3_evidence_join", "j13_sentence_overlap", "a1_route", "e1_current_state", "e7_state_as_of",
    "g1_reachable", "g4_components", "r1_closure", "a8_concept_stats", "a11_corroborate", "c1_extract_claims", "j10_valid_at", "m3_nearest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a20_label_status"](spark, folder).collect()  # start workers
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
