"""A file store of CSV files derived from ``lineitem``, laid out per volume
folder, so that listing, content and preview jobs run on real files whose
number and size grow with the data.

Layout: ``<root>/workspace_id=<ws>/uc_catalog=<c>/uc_schema=<s>/volume=<v>/folder=<f>/part-*.csv``.
Rows are range-partitioned on the layout columns plus a row key first: each
folder's rows are contiguous, so a folder gets one file (or a few when it spans
partitions) instead of one per writing task, and a hot folder is still split
over several tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permgrid.session import checkpoint_root
from permgrid.sources.fixtures import WORKSPACE_IDS, table

LAYOUT = ["workspace_id", "uc_catalog", "uc_schema", "volume", "folder"]
_written: dict[tuple[str, str], str] = {}


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    s = lambda c: c.cast("string")
    return li.select(
        F.concat(F.lit("ws"), s(k % WORKSPACE_IDS)).alias("workspace_id"),
        F.concat(F.lit("cat"), s(k % 2)).alias("uc_catalog"),
        F.concat(F.lit("sch"), s(k % 3)).alias("uc_schema"),
        F.concat(F.lit("vol"), s(k % 4)).alias("volume"),
        F.when(k % 2 == 1, F.lit("/"))
         .otherwise(F.concat(F.lit("/y"), s(F.year("l_shipdate")), F.lit("/"))).alias("folder"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))


def write_store(df: DataFrame, root: str) -> str:
    (df.repartitionByRange(*LAYOUT, "l_orderkey", "l_linenumber")
       .write.mode("overwrite").partitionBy(*LAYOUT)
       .option("header", True).csv(root))
    return root


def volume_store(spark: SparkSession, sf_dir: str) -> str:
    """Path of the store for ``sf_dir`` below the checkpoint root, written once
    per session and reused while its ``_SUCCESS`` marker is there."""
    from permgrid.sources.tables import path_exists
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    path = _written.get(key)
    if path and path_exists(spark, os.path.join(path, "_SUCCESS")):
        return path
    path = os.path.join(checkpoint_root(spark), "volume_store-" + os.path.basename(sf_dir.rstrip("/")))
    write_store(store_rows(spark, sf_dir), path)
    _written[key] = path
    return path
