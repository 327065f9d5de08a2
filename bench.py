"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on the standard output."""

from __future__ import annotations

import json
import os
import statistics
import time

from quillgraph.operators.storage import released
from quillgraph.plans import catalog
from quillgraph.session import get_session

HEADLINE = [
    "vector_topk", "similarity_join", "knn_per_source", "cooccurrence_edges", "entity_degree", "edge_rewire", "comentioned_chunks",
    "outside_neighbours", "community_rank_distinct", "bm25_topk", "hybrid_union_topk", "report_keyword_topk", "budget_prefix", "budget_bins",
    "local_context_rows", "doc_features", "stratified_docs", "chunk_windows", "testable_questions", "token_f1", "latency_percentiles", "metric_pivot",
]


def main(runs: int = 3) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            released(spark)
        took[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "catalogue headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
