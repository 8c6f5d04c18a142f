"""Time the headline queries; prints one JSON line.

Each query is built and written to the ``noop`` sink: one warm-up, then the best of BENCH_RUNS (2).
"""

from __future__ import annotations

import json
import os
import sys
import time

from recordshield.queries import load
from recordshield.session import build_session

HEADLINE = [
    "flagship_deidentify_orders",
    "s1_incremental_scan",
    "s5_id_ranges",
    "s7_key_list_lookup",
    "j3_two_hop_map",
    "j5_resolve_identity",
    "j7_reference_path",
    "j11_backfill",
    "j13_dump_difference",
    "a3_one_active_check",
    "a15_source_history_report",
    "w1_repair_flags",
    "w2_next_row_ids",
    "w3_encounter_surrogates",
    "u5_versioned_merge",
    "r13_whole_table",
    "r13_whole_table_with_bridge",
    "r14_image_headers",
    "x1_mask_patient_values",
    "x6_generic_mask_documents",
    "x7_shift_dates_in_text",
    "x14_dictionary_mask",
    "x18_note_steps",
    "m1_unify_patients",
    "q2_expected_ignored",
    "q15_column_qc",
    "d1_patient_id_columns",
    "t3_stratified_sample",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", cores, int(cores))
    found, _ = load()

    def once(name: str) -> float:
        start = time.perf_counter()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in chosen:
        once(name)
        seconds[name] = round(min(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    spark.stop()
    result = {
        "metric": "headline queries, sum of best runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf,
        "cores": int(cores),
        "lineitem_rows": lines,
        "line_rows_per_sec_bridge_masking": round(lines / seconds["r13_whole_table_with_bridge"]) if "r13_whole_table_with_bridge" in seconds else None,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
