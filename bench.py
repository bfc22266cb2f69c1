"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pixelmill.session import build  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "tile_grid", "blend_tiles", "upscale", "upscale_with_model", "resize_hermite", "resize_lanczos",
    "cas_sharpen", "adaptive_sharpen", "prepare", "merge_islands", "ema", "running_progress",
    "img_candidates", "dedupe_urls", "write_manifest", "resolve_url", "skip_reason", "natural_sort",
    "unique_names", "palette_map", "extract_image_url", "match_domains_suffix", "frame_signature",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["filter_extension"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # The noop sink runs the whole plan and moves no row to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
