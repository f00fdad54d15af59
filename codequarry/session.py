"""Getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: texts make rows of any length: batches that go to Python workers are bounded by bytes, not by rows alone
BATCH_BYTES = 4 << 20
#: stored bytes that a partition of sources is to come from, and what sources that do not know their size report at least
PARTITION_BYTES = 16 << 20
UNKNOWN_BYTES = 1 << 60
#: partitions at most, however large the sources: the driver holds a status for each pair of map task and partition group
MOST_PARTITIONS = 10_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per application; spark-submit --py-files does the same.

    Also bounds the session's Arrow batches by BATCH_BYTES, unless the application is configured otherwise.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if not getattr(context, "_codequarry_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="codequarry-ship-")) / "codequarry.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as package:
            for source in sorted(root.rglob("*.py")):
                package.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        context._codequarry_shipped = True
    return spark


def partitions_for(sources: DataFrame, partition_bytes: int = PARTITION_BYTES) -> int:
    """One partition for each partition_bytes of the stored tables that the plan of sources reads, but no fewer than the shuffle's number or four for each of the cluster's cores, whichever is
    less, and no more than MOST_PARTITIONS. Sources that report no size do not count.
    """
    session = sources.sparkSession
    leaves = sources._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < UNKNOWN_BYTES)
    least = min(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return max(least, min(MOST_PARTITIONS, -(-size // partition_bytes)))
