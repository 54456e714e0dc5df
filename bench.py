"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import importlib
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "outstanding_failures", "command_ledger", "session_turns", "twin_dedupe", "asof_tool_start", "run_length_collapse", "file_change_ledger", "file_rollup_shared", "tier_fit", "search_literal", "clip_functions",
    "op1_packing", "op2_chat_formatting", "op3_html_extraction", "op4_near_duplicates", "op5_class_scores", "op6_decontamination", "op7_personal_data", "op8_line_dedup", "op9_quality_rules", "op10_toxicity", "op11_license_scan", "op12_source_divergence", "op13_filter_interactions", "pipeline",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = importlib.import_module("__spark_entry__").queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up is not a query's time
    took = {}
    for name in HEADLINE:
        if name in made:
            began = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
