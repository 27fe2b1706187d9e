"""Every op query runs where the workers cannot import the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def found(batches):
    for batch in batches:
        try:
            import convlake
            yield batch
        except ImportError:
            pass

assert spark.range(1).mapInArrow(found, "id long").count() == 0
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_op_queries_without_the_package_on_the_workers(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran op") >= 10 and "ran pipeline" in done.stdout
