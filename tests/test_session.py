"""A session without any setting finds a folder of its own; on a cluster that is an error."""

import os
import subprocess
import sys

_JOB = """
from hushmark.session import cut, local_session, shared_folder, work_folder
spark = local_session("2", 2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_folder(spark)
assert folder == shared_folder(spark) and work_folder(spark, "x").startswith(folder)
print("rows", cut(spark.range(5)).count())
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", _JOB], env=env | {"SPARK_CONF_DIR": str(tmp_path)}, cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=300)
    assert "rows 5" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_the_setting():
    from hushmark.session import shared_folder

    class Bare:
        master = "yarn"
        conf = sparkContext = property(lambda self: self)

        def getCheckpointDir(self):
            return None

        def get(self, key, default):
            return default

    try:
        shared_folder(Bare())
    except ValueError:
        return
    raise AssertionError("a cluster without the setting must be an error")
