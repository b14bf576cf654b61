"""Tables in buckets of volumes, changed by rewriting only the buckets that a change names.

A table is a Parquet folder partitioned by ``bucket``, a hash of the volume key.  ``replace_buckets`` writes
through Spark's own dynamic partition overwrite: files are staged and take the place of the named buckets
when the job commits, so a repeated or lost task changes nothing and other buckets are not touched.  Every
replaced bucket also gets one row with ``live`` = false, so that a bucket without rows is replaced too;
readers never see it.  Bucket numbers are at most ``buckets`` integers, which a caller may hold in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permgrid.schemas import VOL_KEY

BUCKETS = 64


def bucket_of(buckets: int = BUCKETS) -> Column:
    """The bucket of a row's volume key."""
    return F.pmod(F.xxhash64(*VOL_KEY), F.lit(buckets)).cast("int")


def buckets_named(changes: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets that ``changes`` (rows with a volume key) fall into, at most ``buckets`` numbers."""
    return sorted(r[0] for r in changes.select(bucket_of(buckets).alias("b")).distinct().collect())


def replace_buckets(df: DataFrame, path: str, named: list[int], buckets: int = BUCKETS, note: DataFrame | None = None) -> None:
    """Writes the rows of ``df`` as the whole content of the buckets ``named``.

    ``df`` may be read from the same table.  ``note`` (bucket, note) is kept beside a bucket's rows."""
    spark = df.sparkSession
    rows = df.withColumn("bucket", bucket_of(buckets)).where(F.col("bucket").isin(named))
    marks = spark.createDataFrame([(b,) for b in named], "bucket int")
    marks = marks.join(note, "bucket", "left") if note is not None else marks.withColumn("note", F.lit(None).cast("string"))
    out = (rows.withColumn("live", F.lit(True)).withColumn("note", F.lit(None).cast("string"))
           .unionByName(marks.withColumn("live", F.lit(False)), allowMissingColumns=True))
    (out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def write_buckets(df: DataFrame, path: str, buckets: int = BUCKETS, note: DataFrame | None = None) -> None:
    """Writes all buckets of a table."""
    replace_buckets(df, path, list(range(buckets)), buckets, note)


def _read(spark: SparkSession, path: str, schema: T.StructType, named: list[int] | None) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("live", T.BooleanType()), T.StructField("note", T.StringType()),
                         T.StructField("bucket", T.IntegerType())])
    df = spark.read.schema(full).parquet(path)
    return df if named is None else df.where(F.col("bucket").isin(named))


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, named: list[int] | None = None) -> DataFrame:
    """The table's rows; of the buckets ``named`` only, if given (others are pruned)."""
    return _read(spark, path, schema, named).where("live").select(*schema.fieldNames())


def read_notes(spark: SparkSession, path: str, schema: T.StructType, named: list[int]) -> dict[int, str]:
    """The notes of the buckets ``named``."""
    return {r["bucket"]: r["note"] for r in _read(spark, path, schema, named).where("not live").select("bucket", "note").collect()}
