"""Wall seconds of the headline queries: ``python bench.py`` prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldloom.plans.queries import QUERIES  # noqa: E402
from fieldloom.session import build_session  # noqa: E402

HEADLINE = [
    "f1_hourly_rollup", "b9_schema_signature", "b1_explode_fields", "b14_field_summary", "c15_translate", "d17_assemble_messages",
    "d18_normalize", "d11_violations", "e6_to_metrics", "e5_format_jsonld", "e10_dry_run", "f2_refresh_rollup", "d16_device_upsert",
    "a7_decode_json", "a8_decode_xml", "a9_decode_csv", "c5_knn_join", "c10_cap_per_window", "g1_clean_text", "g6_size_gate",
    "g10_threat_scan", "h1_message_counts", "h2_latency_histogram", "s1_run_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    cold = {"f1_hourly_rollup": run("f1_hourly_rollup")}
    run("b9_schema_signature")  # the first queries of a session still compile
    run("f1_hourly_rollup")
    warm = {name: run(name) for name in HEADLINE}
    messages = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "total wall time of the headline queries, warm",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "messages_per_second": round(messages / warm["f1_hourly_rollup"], 1),
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
