"""Wall time of the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the warm runs of which the best counts.
Every query writes all its columns to Spark's no-op sink, so nothing is pruned away or collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewick import catalog
from candlewick.catalog import QUERIES
from candlewick.operators import evaluation, ranking, sampling
from candlewick.operators.features import add_features
from candlewick.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# the catalog queries on hourly bars, and the same operators on minute bars (20 times the rows)
HEADLINE = {
    **{
        name: QUERIES[name]
        for name in (
            "bars",
            "bars_per_minute",
            "feature_frame",
            "event_signals",
            "split_summary",
            "downsample",
            "rank",
            "fold_evaluation",
            "event_diagnostics",
            "ts_cv_folds",
            "blocked_signals",
            "global_row_index",
            "precision_at_k_cells",
            "quality_summary",
            "run_listing",
            "training_summary",
            "train_score",
        )
    },
    "features_per_minute": lambda spark, sf: add_features(catalog.hourly(spark, sf, "minute"), tie=()),
    "signals_per_minute": lambda spark, sf: catalog.signalled(spark, sf, "minute"),
    "rank_per_minute": lambda spark, sf: ranking.add_rank(catalog.scored(spark, sf, "minute")),
    "precision_per_minute": lambda spark, sf: evaluation.fold_evaluation(
        catalog.scored(spark, sf, "minute"), catalog.TOP_K
    ),
    "downsample_per_minute": lambda spark, sf: sampling.downsample_negatives(
        catalog.folded(spark, sf, "minute").filter("fold = 'train'"), catalog.RATIO
    ),
}


def run(spark, build) -> float:
    started = time.perf_counter()
    build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = local_session(CPUS, app="bench")
    run(spark, QUERIES["bars"])  # start-up costs belong to no query
    seconds = {}
    for name, build in HEADLINE.items():
        seconds[name] = round(min(run(spark, build) for _ in range(RUNS)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total best-of-runs wall time of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR,
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
