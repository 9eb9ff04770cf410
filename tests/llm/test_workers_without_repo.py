"""Workers that cannot import this repository must still run every operator."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
    .config("spark.driver.memory", "2g").config("spark.ui.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.range(4).repartition(2).rdd.map(lambda x: 1).count()  # workers start before the path is set
sys.path.insert(0, {root!r})
import corpus_pipeline
from panelloom.llm.queries import QUERIES
for name, query in {{**QUERIES, "pipeline": corpus_pipeline.run}}.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
    print("ran", name)
"""


def test_all_queries_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_LOCAL_DIRS")}
    env["SPARK_LOCAL_DIRS"] = str(tmp_path / "spark")
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 13
