"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected); one warm-up run, then the median of
$BENCH_RUNS timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["chunk_docs", "chunk_ids", "bm25_topk", "tfidf_topk", "dense_topk", "bleu",
            "meteor_exact", "citation_scores", "section_prompt", "judge_summary", "rouge_l", "topk_padded",
            "hash_embed", "outline_prompt"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from scriptorium.plans.catalog import QUERIES
    from scriptorium.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="scriptorium-bench", input_partitions=int(cpus))
    times = {}
    for name in only or HEADLINE:
        fn = QUERIES[name]

        def run():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up
        times[name] = round(statistics.median(run() for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
