"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.plans import QUERIES  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = ("a5_resample_ticks_4h", "m_strategy_metrics", "w5_macd", "w18_w20_knn_trend", "w27_volume_features_daily",
            "a14_j13_excursions", "a16_volume_profile_daily", "w24_channels", "w32_bracket_trades", "g1_sweep_sma",
            "g2_sweep_macd", "g3_sweep_knn", "asset_master", "d7_dedupe_companies", "j10_classification_fuzzy",
            "j3_align_asof", "a10_ratio_stats", "s11_list_items", "f6_clean_text", "s17_upsert", "a30_d4_audit_duplicates",
            "w39_unique_symbols")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus,
                      "macd_parameter_sets": 2250 * 5}))
    spark.stop()


if __name__ == "__main__":
    main()
