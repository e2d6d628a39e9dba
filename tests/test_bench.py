"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "change_rate_by_hour", "threshold_sweep"],
                         capture_output=True, text=True, env=env, timeout=600, cwd="/tmp")
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert len(lines) == 1, out.stdout + out.stderr
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and set(d["queries"]) == {"change_rate_by_hour", "threshold_sweep"}
    assert abs(d["value"] - sum(d["queries"].values())) < 0.01


def test_chain_launcher_help():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "run_chain.py"), "--help"],
                         capture_output=True, text=True, timeout=120, cwd="/tmp")
    assert out.returncode == 0 and "--input" in out.stdout and "--start" in out.stdout
