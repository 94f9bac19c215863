"""The driver's path: a fresh interpreter outside the repo, a plain local session."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_allocation_from_outside_the_repo():
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4") \\
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
import __spark_entry__ as E
n = E.entry(spark).count()
m = E.queries()["mold_assignments"](spark, "/root/testdata/sf0.001").count()
print("OK", n, m)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", code], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=900)
    last = res.stdout.strip().splitlines()[-1] if res.stdout.strip() else ""
    assert res.returncode == 0 and last.startswith("OK"), res.stderr[-2000:]
    _, n, m = last.split()
    assert int(n) > 0 and int(m) > 0
