"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query.

Each query runs to completion into Spark's ``noop`` sink (full
execution, no collection to the driver). ``index_build`` is the cold build
of the stored TF-IDF index, which the similarity queries read; no other
query shares anything. ``rows_per_sec`` divides the rows of a query's
input tables by its seconds, ``ms_per_row`` is the inverse.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketlens.plans import queries as Q  # noqa: E402
from ticketlens.session import get_session  # noqa: E402

#: Headline query: the tables whose rows it handles.
HEADLINE = {
    "index_build": ("documents",), "q_analytics_rollup": ("events",), "q_analytics_bundle": ("events",), "q_review_queue": ("events",),
    "q_mark_reviewed": ("events",), "q_build_text": ("documents",), "q_ngrams": ("documents",), "q_vocabulary": ("documents",),
    "q_tfidf_weights": ("documents",), "q_similar_scores": ("benchmark",), "q_similar_topk": ("benchmark",), "q_score_multi": ("embeddings",),
    "q_batch_score": ("documents",), "q_class_report": ("embeddings",), "q_confusion": ("embeddings",), "q_split": ("documents",),
    "q_report": ("embeddings",), "q_triage": ("embeddings",),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = get_session(master=f"local[{cpus}]", app="ticketlens-bench")
    # warm the JVM (codegen, class loading) on a tiny query
    Q.q_kpis(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, rates = {}, {}
    for n in names:
        rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in HEADLINE.get(n, ()))
        t0 = time.perf_counter()
        if n == "index_build":
            Q.corpus_index(spark, sf_dir)
        else:
            Q.REGISTRY[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        rates[n] = round(rows / times[n], 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows_per_sec": rates,
        "ms_per_row": {n: round(1000 / r, 4) for n, r in rates.items() if r},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
