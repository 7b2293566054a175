"""The package reaches Python workers that do not see the driver's folder."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from sievewatch.session import build_session
from sievewatch.plans.nearest import nearest
spark = build_session("ship", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
df = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "id string, embedding array<float>")
asked = df.withColumnRenamed("id", "query_id")
print("ROWS", nearest(asked, df, 1).count(), nearest(asked, df, 1, broadcast_bytes=0).count())
"""


def test_package_is_shipped(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 2 2" in done.stdout, done.stderr[-2000:]
