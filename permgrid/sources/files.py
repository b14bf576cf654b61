"""File sources: inventory listing, file lines, file heads.

A listing selects only ``path``, ``length`` and ``modificationTime`` of ``binaryFile``,
so it never reads file bytes.  Spark keeps the statuses of all files it lists in the
driver; for stores of very many files keep an inventory table and read that.

Contents are read as lines, in splits: a file of any size is spread over tasks and
never becomes one row.  Lines carry their place (file, line number).

Known gap (Spark behaviour): names starting with ``_`` or ``.`` are skipped and empty
directories never reported; an inventory table has neither gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permgrid.functions.text import utf8_lossy


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, modified) of every file below ``root`` (recursive)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", F.col("length").alias("size"),
                               F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


_HIVE = r"(?:^|/){key}=([^/]*)/"


def inventory_from_store(listing: DataFrame) -> DataFrame:
    """Inventory rows for a store laid out by ``partitionBy`` as
    ``.../workspace_id=../uc_catalog=../uc_schema=../volume=../folder=../<file>``
    (partition values are %-escaped by Spark, '/' as %2F)."""
    def part(key: str):
        raw = F.regexp_extract("path", _HIVE.format(key=key), 1)
        return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    folder = part("folder")
    return listing.select(part("workspace_id").alias("workspace_id"), part("uc_catalog").alias("uc_catalog"),
                          part("uc_schema").alias("uc_schema"), part("volume").alias("volume"),
                          folder.alias("folder"), F.substring_index("path", "/", -1).alias("name"),
                          "size", "modified", "path")


def read_lines(spark: SparkSession, root: str, layout: list[str]) -> DataFrame:
    """Lines of the files below ``root``: the layout columns (directory partitions, so
    a join or filter on them prunes directories), ``path``, ``split``, ``pos`` and ``line``.

    Within a file, lines are in the order of (split, pos)."""
    schema = "value string, " + ", ".join(f"{c} string" for c in layout)
    return (spark.read.schema(schema).text(root)
            .select(*layout, F.input_file_name().alias("path"), F.input_file_block_start().alias("split"),
                    F.monotonically_increasing_id().alias("pos"), utf8_lossy(F.col("value").cast("binary")).alias("line")))


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``line_no`` (from 0, per file): rows before a split come from one count per
    split, rows within it from a window bounded by the split."""
    split = ["path", "split"]
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (lines.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("pos")) - 1
    return lines.withColumn("_in", inside).join(offsets, split).withColumn("line_no", F.col("_before") + F.col("_in")).drop("_in", "_before")


def read_heads(spark: SparkSession, root: str, max_bytes: int, glob: str | None = None) -> DataFrame:
    """(path, size, text, bytes_left): the first ``max_bytes`` of each file, decoded as UTF-8
    with replacement, and how many bytes the limit left out.  For a limit that the caller
    wants (a peek at small files); ``read_lines`` reads whole files of any size."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", F.col("length").alias("size"), utf8_lossy(F.substring("content", 1, max_bytes)).alias("text"),
                               F.greatest(F.col("length") - F.lit(max_bytes), F.lit(0)).cast("bigint").alias("bytes_left"))
