"""Runs headline queries once each at one scale and prints their seconds as one JSON line."""

from __future__ import annotations

import json
import os
import time

from awardlens.plans import catalogue
from awardlens.session import local_session

HEADLINE = (
    "office_hhi", "headline_stats", "firm_rollup", "office_rollup", "firm_office_rollup", "co_award_pairs", "agency_concentration",
    "yearly_shares", "footprint_pairs", "pettitt_change_points", "temporal_link_auc", "temporal_motifs", "flag_identical_bids",
    "flag_rotating", "flag_timing", "risk_scores", "splitting_pairs_30d", "jv_components", "pagerank", "triads", "cycles_2_4",
    "parse_contractors", "canonical_names", "entity_search_similar", "vector_cosine_topk", "merged_turns", "quality_completeness", "dynasties_found",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalogue.queries()
    queries["office_hhi"](spark, folder).collect()  # warm up
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
