"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each headline query runs once to
warm up and is then timed; all rows are computed, none are collected.
"""

from __future__ import annotations

import json
import os
import time

from wordtide import registry
from wordtide.session import local_session

HEADLINE = [
    "hits_per_period",
    "hits_roundtrip",
    "kwic",
    "doc_split_clean",
    "attr_pivot_binned",
    "bigram_llr",
    "trigram_counts",
    "sample_per_period",
    "min_size_gate",
    "usage_distribution",
    "pair_agreement",
    "standardize",
    "calinski_harabasz",
    "silhouette",
    "kmeans_assign",
    "prototypes",
    "snippet_sample",
    "kmeans_layers",
]
# Long ones, timed without a run to warm up.
HEAVY = ["kmeans_sweep", "usage_clusters", "neighbour_bundle", "bigram_counts_across", "usage_pairs"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog, times = registry.queries(), {}
    for name in HEADLINE + HEAVY:
        for _ in range(2 if name in HEADLINE else 1):
            start = time.perf_counter()
            catalog[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
