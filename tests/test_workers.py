"""Queries run where the workers don't hold the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHILD = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in sys.argv[3:]:
    print(name, len(e.queries()[name](spark, sys.argv[2]).collect()), flush=True)
"""


def rows_from_elsewhere(tmp_path, names):
    """Rows of each query, in a process that only its driver can load the package in."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CHILD, ROOT, "/root/testdata/sf0.001", *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
    return {x.split()[0]: int(x.split()[1]) for x in got.stdout.splitlines() if x.split()[:1] and x.split()[0] in names}


def test_ranker_without_the_package(tmp_path):
    got = rows_from_elsewhere(tmp_path, ["summary_hybrid", "recommend"])
    assert got["summary_hybrid"] == 1 and got["recommend"] > 0
