import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
import surelake
from surelake.functions import answers
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
surelake.ship(spark)
print("found", spark.range(1).select(answers.answer_span(F.lit("so \\\\boxed{4}"))["value"].alias("v")).first().v)
"""


def test_a_script_elsewhere_can_ship_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "job.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "found 4" in done.stdout, done.stderr[-2000:]
