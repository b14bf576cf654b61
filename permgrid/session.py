"""SparkSession construction and the shared checkpoint folder.

Everything here is plain Spark configuration.  The settings matter at scale:

* AQE re-plans joins from runtime shuffle statistics (size-checked broadcast,
  partition coalescing) and splits skewed partitions of sort-merge joins, which
  is how a hot group or a hot volume is spread over many tasks.
* ``spark.sql.autoBroadcastJoinThreshold`` is the only broadcast rule we use:
  Catalyst (and AQE at runtime) broadcast a side only after checking its size.
  Operators hint ``broadcast()`` only through ``bounded``, after a count of rows and bytes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "permgrid",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster leave ``master`` as ``None`` so spark-submit decides, and size
    ``shuffle_partitions`` to the data (about 128-256 MB of shuffle per task).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("PERMGRID_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only a local session (tests, bench)
    without the setting gets a fresh private folder; on a cluster an unset
    value is an error, because a machine-local folder would not survive the
    loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="permgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def saved(df):
    """``df`` computed once and read from a reliable checkpoint below ``spark.checkpoint.dir`` from then on."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint only when its rows and their bytes prove that it is small: the driver
    holds it as well, and lists may make few rows large.

    ``df`` should be materialised.  Beyond the bounds it is returned as it is, and Spark joins it by shuffling."""
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df.schema)).alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes else df


def _row_bytes(schema):
    """About the bytes of a row: 8 a value, those of a list's values times its length, and those of texts."""
    def fixed(t):
        return sum(fixed(f.dataType) for f in t.fields) if isinstance(t, StructType) else 8

    total = F.lit(0).cast("long")
    for f in schema.fields:
        total = total + F.lit(fixed(f.dataType))
        if isinstance(f.dataType, ArrayType):
            total = total + F.greatest(F.size(f.name), F.lit(0)) * fixed(f.dataType.elementType)
        elif isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
    return total


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the checkpoint root for one job's output."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
