"""bench.py keeps the driver's contract: exactly one JSON line on stdout with the required keys."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line(small_dir):
    env = dict(os.environ, BENCH_SF_DIR=small_dir, BENCH_KEYS="top_pages,funnel_counts",
               BENCH_REPEATS="1", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= d.keys()
    assert d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"top_pages", "funnel_counts"} and not d["failed"]
    assert d["value"] == round(sum(d["queries"].values()), 3)
