"""Python workers must not need the package on their path (the driver may run
from any directory): the grouped id-suffix function ships by value."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from permgrid.operators.importer import assign_user_ids
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
df = spark.createDataFrame([("a.b@x", 0), ("a-b@y", 1)], "email string, first_row long")
ex = spark.createDataFrame([("a_b",)], "user_id string")
got = sorted((r.email, r.user_id) for r in assign_user_ids(df, ex).collect())
assert got == [("a-b@y", "a_b_2"), ("a.b@x", "a_b_1")], got
print("OK")
"""


def test_grouped_function_runs_outside_repo():
    cwd = tempfile.mkdtemp(prefix="pg-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-3000:]
