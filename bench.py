"""Time the headline queries. Prints one JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from checks.queries import QUERIES  # noqa: E402
from mailsift.session import build_session  # noqa: E402

HEADLINE = [
    "dedup_keep_first",
    "dedup_count",
    "sender_parts",
    "text_stats",
    "date_features",
    "clean_text",
    "known_domain_flags",
    "clean_emails",
    "tfidf_terms",
    "tfidf_weights",
    "standard_scale",
    "embed_text",
    "stratified_split",
    "stratified_folds",
    "binary_metrics",
    "roc_auc",
    "triage_crosstab",
    "classification_report",
    "method_compare",
    "silhouette",
    "ari",
    "oof_logistic",
    "kmeans_best",
    "pca_2d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths and the Python workers before timing
    QUERIES["clean_text"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
