"""Time queries on the tables in $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

    python bench.py            headline queries
    python bench.py all        every registered query
    python bench.py key ...    the named queries
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelmill.plans.queries import QUERIES
from reelmill.session import local_session

HEADLINE = [
    "trending_weekly", "trending_all_windows", "search_stats", "tag_index", "movie_rating_rollup", "movie_activity_stats",
    "interactions_union", "interactions_recent", "cf_pair_weights", "implicit_pair_strength", "rank_labels_binary",
    "rank_labels_multitask", "kcore_filter", "negatives_global", "holdout_last", "split_stratified", "vocab_index",
    "item_stats_vector", "user_recent_sequence", "user_long_interest_tags", "user_static_tag_ctr", "rank_matrix_multitask",
    "user_top_preferences", "user_excluded_items", "recall_tag", "recall_vector", "recommend_users",
    "auc_exact", "hit_rate_at_k", "search_browse", "search_fulltext", "search_like", "search_page", "movie_documents",
    "movie_chunks", "embedding_upsert", "similar_items", "rag_evidence", "citation_audit", "task_progress", "qc_keys",
    "stream_trending_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    keys = list(QUERIES) if wanted == ["all"] else wanted
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["trending_weekly"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times: dict[str, float] = {}
    for key in keys:
        start = time.perf_counter()
        try:
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # keep measuring the others
            print(f"{key}: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr, flush=True)
            times[key] = -1.0
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{times[key]:8.2f}  {key}", file=sys.stderr, flush=True)
    total = round(sum(t for t in times.values() if t > 0), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
