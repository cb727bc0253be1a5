"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
Shared tables (market, scored spaces, text index) are built inside the first query that needs
them, which has an entry of its own; later entries read them, as an analyst's session would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from checks import binding, market_queries, text_queries, view_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def _finish(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def market_build(spark, sf):
    """Facts to cells to space, company and brand tables."""
    m = binding.market(spark, sf)
    m.write_facts()
    return m.space_facts


def analysis_context(spark, sf):
    """Growth, competition, right to win, signals and scores of every space."""
    return binding.market(spark, sf).scored


def index_build(spark, sf):
    return binding.text_index(spark, sf).terms


QUERIES = {
    "market_build": market_build,
    "analysis_context": analysis_context,
    "scorecard": market_queries.scorecard,
    "sensitivity": market_queries.sensitivity_query,
    "forecast": market_queries.forecast,
    "whitespace": market_queries.whitespace,
    "deep_dive": view_queries.deep_dive,
    "rank_spaces": market_queries.rank_spaces,
    "space_membership": market_queries.space_membership,
    "index_build": index_build,
    "bm25": text_queries.bm25,
    "rrf_search": text_queries.rrf_search,
    "dense_rank": text_queries.dense_rank,
    "grounding_report": text_queries.grounding_report,
    "guard_verdict": text_queries.guard_verdict,
    "injection_scan": text_queries.injection_scan,
    "eval_summary": text_queries.eval_summary,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    _finish(spark.range(1000).groupBy("id").count())
    times = {}
    for name, query in QUERIES.items():
        started = time.perf_counter()
        _finish(query(spark, SF_DIR))
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
