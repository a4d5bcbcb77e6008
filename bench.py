"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the no-op sink, so all its rows and columns are computed, and is timed once after a shared
warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from leafmill.plans.registry import all_queries
from leafmill.session import local_session

HEADLINE = [
    "keyword_context", "clean_corpus", "chunk_pages", "chunk_overlap", "cosine_topk", "hybrid_topk", "html_to_text", "html_blocks",
    "paragraphs", "find_matches", "page_diffs", "diff_summary", "dedupe_corpus", "concat_docs", "locate_snippets", "validate_questions",
    "parse_entries", "group_annotations_page", "doc_profile", "rate_limit", "store_reads", "fulltext",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds: dict[str, float] = {}
    # one query touching scans, shuffles and Python workers warms the session up
    queries["chunk_pages"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in only or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
