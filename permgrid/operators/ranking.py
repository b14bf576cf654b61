"""Running aggregates within a key, without putting a key in one task.

``prefix_agg`` gives each row the sum (or max) of a value over the rows before
it, in a given order, among rows with the same key.  A window partitioned by the
key alone would sort a hot key in one task.  Here the caller names a *bucket*: a
column that never falls along the order (an hour of a timestamp, a block of row
numbers).  Then

1. a window runs inside each (key, bucket), bounded by the rows of one bucket;
2. one total per (key, bucket) gives running offsets over the buckets of a key;
3. the answer is the offset combined with the value inside.

There is one path for every size, nothing is sampled or materialised, and keys
join null-safely: rows with a NULL key are a group of their own, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max}


def _combine(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long")
    return F.greatest(a, b)  # NULLs are skipped; NULL only when both are


def block(col: str, rows: int = 100_000) -> Column:
    """Bucket of a numeric order: blocks of ``rows`` numbers."""
    return F.floor(F.col(col) / F.lit(rows))


def hour(col: str) -> Column:
    """Bucket of a time order."""
    return F.date_trunc("hour", F.col(col))


def prefix_agg(df: DataFrame, keys: list[str], order: list[str], value: str, how: str = "sum",
               out: str = "prefix", bucket: Column | None = None) -> DataFrame:
    """``df`` plus ``out`` = ``how`` of ``value`` over the rows strictly before
    each row within ``keys``, ordered by ``order`` (unique within a key for a
    deterministic answer).  Sums start at 0; a max with no earlier value is NULL.
    ``bucket`` must not fall along ``order``; default: blocks of its first column."""
    agg = _AGG[how]
    s = df.withColumn("_b", block(order[0]) if bucket is None else bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_k{i}" for i in range(len(keys))]
    offsets = (s.groupBy(*keys, "_b").agg(agg(value).alias("_t"))
               .withColumn("_off", agg("_t").over(over)).drop("_t")
               .select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_b").alias("_kb"), "_off"))
    s = s.withColumn("_in", agg(value).over(inside))
    same = F.col("_b").eqNullSafe(F.col("_kb"))
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return (s.join(offsets, same).withColumn(out, _combine(how, F.col("_off"), F.col("_in")))
            .drop("_b", "_kb", "_in", "_off", *names))


def prefix_count(df: DataFrame, keys: list[str], order: list[str], flag: str,
                 out: str = "prefix", bucket: Column | None = None) -> DataFrame:
    """Number of rows with ``flag`` = 1 strictly before each row within ``keys``."""
    return prefix_agg(df, keys, order, flag, "sum", out, bucket)
