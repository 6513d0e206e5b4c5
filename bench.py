"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and threads; ``BENCH_QUERIES``
a comma-separated subset.  Every query is run to its full result (``noop``
sink), after a short warm-up that is not counted.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans.lineage import clear_steps  # noqa: E402
from tablewright.plans.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = """simjoin_rs simjoin_self_set simjoin_self_list simjoin_self_idf token_candidates pair_features page_links
page_records count_histogram table_summary group_quartiles crosstab_margins hexbin spearman spearman_matrix
bootstrap_interval permutation_test chi_squared one_hot standardize standardize_cells rare_group_score graph_degree
pagerank graph_components betweenness dfs_features dfs_select match_exact match_nearest match_score two_line_ate
backdoor_linear kmeans_anomaly station_model permutation_importance partial_dependence shapley_values""".split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["year_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        clear_steps(spark)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
             "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
