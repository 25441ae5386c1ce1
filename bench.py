"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termweave.plans import catalogue  # noqa: E402
from termweave.session import get_session  # noqa: E402

HEADLINE = (
    "lexical_bm25_topk", "lexical_min_should_match", "exact_and_phrase_match", "bm25_corpus_stats", "knn_cosine_topk", "knn_min_score", "hybrid_score_topk", "three_arm_candidates", "semantic_rank",
    "concept_small_union", "concept_small_left", "dedup_first", "candidate_dedup", "relation_expand", "maps_to_standard", "standardize_two_rounds", "llm_response_parse", "run_agreement", "run_pivot", "mode_answer",
    "recall_at_k", "coverage_recall", "bootstrap_ci", "index_offset_join", "cascade_score_lookup", "llm_metrics_by_tag", "grouped_levels", "unpivot_scores", "date_normalize", "streaming_ingest_final",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    run("dedup_first")  # starts the JVM's pools and the file caches
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": d.rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
