"""Times the headline queries and prints one JSON line. BENCH_SF_DIR is the tables' folder, BENCH_CPUS the threads."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["c04_hops_region_orders", "c04_blast_radius", "c07_optional_match", "c12_anti_keyed", "c14_variable_length", "c19_derived_edge", "c24_context", "d03_upsert", "e16_invariants", "e17_parity", "e31_nearest_rank", "e32_cumulative_share", "e33_latest_per_group", "f09_richest_wins", "g04_shred_nodes", "g19_variant_ids", "h16_identity_facts", "h22_promote", "h23_freshness", "i02_bm25", "i08_path_tree", "i14_link_aggregation", "i20_components", "j04_byte_cap"]


def main() -> None:
    from weftgraph.catalogue import QUERIES
    from weftgraph.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session's machinery
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
