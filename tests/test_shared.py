import os
import subprocess
import sys

from tensorloom.shared import application_folder, drop_all_staged, drop_staged, stage

ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tensorloom.shared import shared_root, stage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_root(spark) == shared_root(spark) and shared_root(spark).startswith("file:")
d = stage(spark.range(5), "numbers")
assert d.count() == 5 and "Scan parquet" in d._jdf.queryExecution().executedPlan().toString()

class Far:
    class sparkContext:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
    class conf:
        get = staticmethod(lambda key, default: default)

try:
    shared_root(Far)
except RuntimeError as e:
    assert "spark.checkpoint.dir" in str(e)
else:
    raise AssertionError("a machine-local folder on a cluster")
print("fine")
"""


def test_without_the_setting(tmp_path):
    """A session whose configuration lacks the key: staging works locally, and fails clearly on a cluster."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}  # no defaults file
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    p = subprocess.run([sys.executable, "-c", ALONE, root], capture_output=True, text=True, env=env, timeout=180)
    assert p.stdout.strip().endswith("fine"), p.stderr[-2000:]


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_staged_tables_go(spark):
    a, b = stage(spark.range(3), "a"), stage(spark.range(4), "b")
    drop_staged(spark, a)
    assert not exists(spark, a._tensorloom_path) and b.count() == 4
    drop_all_staged(spark)
    assert not exists(spark, application_folder(spark))
