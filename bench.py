"""Wall time per operator on the driver tables; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (optional) a comma-separated list.
Every query is written to the ``noop`` sink, so all of its rows and columns are computed and none reach the driver.
"""

import json
import os
import time

import pyarrow.parquet as pq

from leafgraph.registered import QUERIES
from leafgraph.session import build_session

HEADLINE = (
    "k1_knn k3_knn_two_columns k5_knn_filtered k10_backoff_search k8_knn_approx f8_absolute_url j1_resolve_links "
    "h1_main_content h5_split_by_heading h5_split_nested e5_anchor_url h3_replace_elements e6_split_sentences "
    "e7_pack_sentences e9_recursive_chunk e11_relations j4_split_siblings w1_context_budget f19_render_prompt "
    "u2_embed u3_judge_relevance u4_generate_answer a1_program_options r1_log_questions r3_refresh_pages "
    "s14_snapshot_changed").split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("leafgraph-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.leafgraph.partitions": cpus,
        "spark.checkpoint.dir": os.environ.get("BENCH_WORK_DIR", os.path.abspath("spark-warehouse/work")), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = {t: pq.read_metadata(f"{folder}/{t}.parquet").num_rows
            for t in ("documents", "embeddings", "pages", "part", "conversations", "events")}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "input_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
