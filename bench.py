"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs once to warm the JVM and is
then timed; all rows are computed and handed to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import time

from labelweave.queries.registry import QUERIES
from labelweave.session import build_session

HEADLINE = [
    "zero_shot_vectors", "zero_shot_prefix_bleed", "definition_match", "knn_transfer", "compare_approaches",
    "text_label_match", "text_variant_predictions", "compare_text_variants", "text_term_vectors", "accuracy",
    "performance_tiers", "confusion_topk", "category_confusion", "label_counts", "summary_table", "clean_documents",
    "page_texts", "flatten_catalogue", "enriched_items", "item_alignment", "profile_items", "length_reduction",
    "submission_roundtrip", "wanted_page_texts", "knn_transfer_indexed", "text_label_match_sparse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
