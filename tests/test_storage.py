import subprocess
import sys
from pathlib import Path

from codequarry.storage import discard, keep

PROGRAM = """
import sys
from pyspark.sql import SparkSession
from codequarry.storage import keep
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
kept = keep(spark.range(9), "numbers")
assert kept.count() == 9 and kept._kept_path.startswith(sys.argv[1])
spark.stop()
"""


def test_kept_tables_go_when_the_application_ends(tmp_path):
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", PROGRAM, f"file://{tmp_path}/shared"], check=True, cwd=root, timeout=120)
    assert not list((tmp_path / "shared").glob("numbers-*"))


def test_discarded_tables_are_gone_at_once(spark):
    kept = keep(spark.range(5), "few")
    assert kept.count() == 5
    discard(kept)
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
