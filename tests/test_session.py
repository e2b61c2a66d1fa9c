"""A session in which no shared folder is set beforehand."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FIT = """
from wordtide.plans.usage_types import cluster_usages
from wordtide.session import cut_lineage, local_session, shared_folder

spark = local_session(2, "bare")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut_lineage(spark.range(3)).count() == 3
assert shared_folder(spark) == shared_folder(spark)
rows = [("w", i, [float(i % 2) * 9 + i / 100, 1.0 - i / 50]) for i in range(12)]
df = spark.createDataFrame(rows, "word string, usage_id long, vector array<double>")
found = {r["usage_id"]: r["label"] for r in cluster_usages(df, k_range=[2, 3], criterion="calinski").collect()}
assert sorted(found) == list(range(12)) and None not in found.values()
print("fitted")
"""


def test_a_fit_without_a_preset_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", FIT], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "fitted" in done.stdout
