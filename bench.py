"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docspark.session import local_session  # noqa: E402
from docspark_checks import catalogue  # noqa: E402

HEADLINE = (
    "sentence_split", "pack_chunks", "chunk_overlap", "subchunk_numbering", "section_chunks",
    "html_to_markdown", "page_markdown", "html_table_grid", "latest_wins", "kb_join", "term_search",
    "vector_ids", "knn_exact", "knn_lsh", "retrieval_quality", "context_budget", "gold_sections",
    "keywords_topk", "stratified_pick", "quality_scores", "group_summary_ci", "model_profile",
    "interesting_cases", "corr_matrix", "quartiles", "metrics_from_log",
)


def run(fn, spark, sf: str) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "6g"))
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        fn = catalogue.QUERIES[name]
        run(fn, spark, sf)  # warm
        times[name] = round(statistics.median(run(fn, spark, sf) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
