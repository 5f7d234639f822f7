"""What a session sets up: the package on the workers, and the shared folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from corvane.session import shared_dir

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from corvane.session import session
from corvane.functions.vectors import embed
from pyspark.sql import functions as F
spark = session(master="local[2]", **{{"spark.ui.enabled": "false"}})
print("rows", spark.range(3).select(embed(F.col("id").cast("string")).alias("v")).where("size(v) > 0").count())
"""


def test_workers_find_the_package_without_a_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3" in out.stdout, out.stderr[-2000:]


class Fake:
    """A session with settings and a master."""

    def __init__(self, master, folder=None):
        self.values = {"spark.checkpoint.dir": folder}
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master})()

    def get(self, key, default=None):
        return self.values.get(key) or default

    def set(self, key, value):
        self.values[key] = value


def test_shared_folder():
    assert shared_dir(Fake("spark://a:7077", "hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        shared_dir(Fake("spark://a:7077"))
    here = Fake("local[4]")
    assert os.path.isdir(shared_dir(here)) and shared_dir(here) == here.get("spark.checkpoint.dir")
