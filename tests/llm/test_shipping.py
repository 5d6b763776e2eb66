"""Workers need no copy of the package: what they run is shipped with the job."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.append({repo!r})
from pyspark.sql import SparkSession
from ledgerloom.llm.common import prepared
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import ledgerloom.llm.queries as q
prepared(spark)
for name in ("op5_language_id", "op10_url_filter"):
    print(name, q.QUERIES[name](spark, {sf!r}).count(), flush=True)
"""


def test_from_an_empty_folder_without_a_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=str(REPO), sf="/root/testdata/sf0.001")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "op5_language_id" in done.stdout and "op10_url_filter" in done.stdout
