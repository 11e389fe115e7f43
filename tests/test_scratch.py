"""The driver and the executors hand back memory between steps."""

import gc
import os
import subprocess
import sys
from pathlib import Path

import pyspark

from spanlake.sources import scratch


def test_heap_of_a_step_that_is_over_goes_back(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rows = spark.range(10)
    held = [gateway.new_array(jvm.long, 8 << 20) for _ in range(16)]
    before = jvm.Runtime.getRuntime().totalMemory()
    held.clear()
    gc.collect()
    scratch._rested[0] = float("-inf")
    assert scratch.materialize(rows).count() == 10
    assert before - jvm.Runtime.getRuntime().totalMemory() > 256 << 20


def test_driver_rests_once_in_a_while_only(spark):
    scratch._rested[0] = float("-inf")
    assert scratch.rest_driver(spark) and not scratch.rest_driver(spark)
    assert "rim" in scratch._trim_native(spark)


CLUSTER = """
import re, sys
from pathlib import Path
from pyspark.sql import SparkSession
from spanlake.sources import scratch

conf = {"spark.master": "local-cluster[1,2,1500]", "spark.executor.memory": "1200m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"}
conf["spark.executor.extraJavaOptions"] = "-XX:ActiveProcessorCount=2"
spark = SparkSession.builder.config(map=conf).getOrCreate()

def executor_mb():
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if "CoarseGrainedExecutorBackend" in (line := (p / "cmdline").read_text()) and spark.sparkContext.applicationId in line:
                return int(re.search(r"\\nAnonymous:\\s+(\\d+)", (p / "smaps_rollup").read_text())[1]) // 1024
        except OSError:
            pass

spark.range(0, 2, 1, 2).selectExpr("length(repeat(string(id), 150000000))").collect()
scratch._rested[0] = float("-inf")
before = executor_mb()
rows = scratch.materialize(spark.range(10)).count()
print("SEEN", rows, before, executor_mb())
spark.stop()
"""


def test_heap_of_executors_goes_back(tmp_path):
    (tmp_path / "home/work").mkdir(parents=True)  # executors have their folders in Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(Path(__file__).parents[1])}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert "SEEN" in out.stdout, out.stderr[-2000:]
    rows, before, after = map(int, out.stdout.split("SEEN")[1].split())
    assert rows == 10 and before - after > 100
