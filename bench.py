"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nightsieve import catalog  # noqa: E402
from nightsieve.session import ensure_checkpoint_dir, local_session  # noqa: E402

HEADLINES = [
    "rank_percentile", "traffic_light", "auto_thresholds", "apply_thresholds", "summary_rollup", "reject_counters",
    "threshold_sweep", "multi_sort", "move_manifest", "nearest_rank_percentile", "mad", "box_blur", "local_maxima",
    "measure_stars", "weighted_median", "kernel_smooth", "isolated_points", "thin_by_distance", "density_map", "live_rescore",
]


def analyze_frame(spark, folder: str) -> float:
    """Seconds for the metrics of one seeded 16.4-megapixel frame, read from a file: noise and 500 bright squares."""
    import numpy as np

    from nightsieve.operators import slabs
    from nightsieve.sources import files, fits

    rng = np.random.default_rng(42)
    image = rng.integers(0, 65536, (3520, 4656))
    for x, y in zip(rng.integers(10, 4640, 500), rng.integers(10, 3500, 500)):
        image[y:y + 7, x:x + 7] = 65000
    cards = [("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 4656), ("NAXIS2", 3520), ("BZERO", 32768), ("BSCALE", 1)]
    head = "".join(f"{k:<8}= {v}".ljust(80) for k, v in cards) + "END".ljust(80)
    body = (image - 32768).astype(">i2").tobytes()
    with open(f"{folder}/frame.fits", "wb") as out:
        out.write(head.encode().ljust(2880) + body + b"\0" * (-len(body) % 2880))
    started = time.perf_counter()
    header = fits.header_table(files.discover_files(spark, folder)).cache()
    found = slabs.frame_metrics(fits.luminance_slabs(header, halo=slabs.HALO), header, ["path"])
    found.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, app="bench")
    ensure_checkpoint_dir(spark)
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINES
    queries["auto_thresholds"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's machinery
    times = {}
    for name in (n for n in names if n != "frame_16mp"):
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    if not sys.argv[1:] or "frame_16mp" in sys.argv[1:]:
        with tempfile.TemporaryDirectory() as scratch:
            times["frame_16mp"] = round(analyze_frame(spark, scratch), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
