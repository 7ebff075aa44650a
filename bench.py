"""Time the headline queries and print one line of JSON.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every
query writes all of its rows to nowhere, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lexigrid.catalog import QUERIES
from lexigrid.session import local_session

HEADLINE = (
    "social_clean", "simple_clean", "annotated_tokens", "char_ngrams", "multi_ngrams", "text_stats",
    "embedding_mean", "vocabulary", "tf_idf", "stratified_split", "language_identification", "nb_scores",
    "classify_best", "out_of_fold", "alpha_grid", "learning_curve", "class_report", "roc_auc",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["language_identification"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.monotonic() - started, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
