"""Connected components of link tables, and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.session import bounded, checkpoint_root, scratch_path  # noqa: F401  (bounded: for the operators)


def saved(df: DataFrame) -> DataFrame:
    """Materialised below ``spark.checkpoint.dir`` (reliable, lineage cut)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again: later jobs read the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_batches(spark, rows: int = 2500) -> None:
    """Texts travel to Python in Arrow batches of at most ``rows`` rows from here on (Spark's own
    default suits narrow rows): a batch is held by the JVM and the Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable by ``edges`` (a, b), per node of an edge.

    Alternates the large-star and small-star steps until the edges form stars.
    Every step is an aggregation with map-side partial minima and an equi-join, so a
    hub with very many neighbours is never gathered in one place.  Null ends and loops
    are ignored; an empty table gives an empty result.
    """
    e = saved(edges.where("a is not null and b is not null and a <> b")
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _is_star_forest(e):
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        e = saved(large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(m.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")


def _is_star_forest(e: DataFrame) -> bool:
    """True when every upper end has one lower end, which is no upper end itself."""
    ends = (e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low"), "v")
            .unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low"), F.lit(None).cast("long").alias("v"))))
    odd = (ends.groupBy("x").agg(F.max("up").alias("up"), F.max("low").alias("low"), F.min("v").alias("p"), F.max("v").alias("q"))
           .where("(up = 1 and low = 1) or p <> q"))
    return odd.limit(1).count() == 0
