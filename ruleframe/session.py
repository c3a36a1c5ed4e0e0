"""Session helpers: the shared folder, size-checked broadcasts, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table may be broadcast (a few MB at the widths used here).
BROADCAST_ROWS = 200_000

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Unset, it is a local folder in local mode (tests) and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = _local.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="ruleframe-")
        _local[context.applicationId] = path
    return path.rstrip("/")


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/ruleframe/{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage with a parquet table in the shared folder; it outlives any executor."""
    spark = df.sparkSession
    path = workspace(spark, tag)
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if a count shows at most ``limit`` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def estimated_bytes(df: DataFrame) -> float:
    """Spark's estimate of the size of ``df``; 0 if it has none."""
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0.0  # sources without statistics claim the highest number


def spread(df: DataFrame) -> DataFrame:
    """``df``, a projection of a table, in as many partitions as there are cores, if its size makes fewer: for work that costs far more than a shuffle of its rows.

    A table of one small file would otherwise be one task; large tables have many partitions and are left alone. The test is
    on sizes, so nothing runs for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(cores) if estimated_bytes(df) < cores * split else df


def partitions(spark: SparkSession, size: float = 0.0, each: int = 128 << 20) -> int:
    """Partitions for a shuffle: the session's number, or more where ``size`` bytes would make them larger than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // each) + 1)
