"""Stored tables: declared-schema reads, by-name appends and idempotent table creation.

Parquet tables cannot UPDATE, DELETE or MERGE; ``sources.buckets`` rewrites the parts of a table
that a change names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permgrid.schemas import GRANTS, USERS, WORKSPACES


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name, cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with a declared schema: no inference, no footer merge."""
    return spark.read.schema(schema).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append by column *name* (Parquet stores names; never positional)."""
    df.write.mode("append").parquet(path)


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (any scheme)."""
    fs, p, _ = _hadoop_fs(spark, path)
    return bool(fs.exists(p))


TABLES = {"download_workspaces": WORKSPACES, "download_user": USERS, "download_permissions": GRANTS}


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def create_tables(spark: SparkSession, database: str, location: str) -> list[str]:
    """Idempotent: the database and the three tables at ``<location>/<table>``.
    A blank database name or location is an error before anything is made."""
    blank = [what for what, given in {"database": database, "location": location}.items() if not (given or "").strip()]
    if blank:
        raise ValueError("create_tables needs a value for " + " and ".join(blank))
    location = location.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}/_db'")
    for table, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{table}` ({_ddl(schema)}) "
                  f"USING parquet LOCATION '{location}/{table}'")
    return [f"{database}.{table}" for table in TABLES]
