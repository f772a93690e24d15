import json
import os
import subprocess
import sys
from pathlib import Path

BENCH = Path(__file__).resolve().parents[1] / "bench.py"


def test_bench_times_one_query():
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1"}
    done = subprocess.run([sys.executable, str(BENCH), "drift_status"], capture_output=True, text=True, env=env, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    said = json.loads(done.stdout.strip().splitlines()[-1])
    assert set(said["queries"]) == {"drift_status"} and said["value"] > 0


def test_headline_queries_are_registered():
    sys.path.insert(0, str(BENCH.parent))
    import bench
    from callsieve.plans.queries import QUERIES

    assert set(bench.HEADLINE) <= set(QUERIES)
