"""Records of CSV files, read in splits although quoted fields may hold line breaks.

A line can only be cut into fields when it is known whether it starts inside a quoted field, and that
depends on every line before it.  Each line is a function from "starts inside" to "ends inside", one of
four: always outside, always inside, unchanged, or the reverse.  The state before a line is that of the last
line whose end does not depend on its start, reversed once per reversing line since.  So it follows from
running values inside a split, one row per split, and running values over the splits of a file: no file
is read by one task.  For files in which every quote stands in a quoted field this is the parity of quotes;
a quote inside an unquoted field is a plain character and reverses nothing.

A record that ends on the line it starts on stays where it is.  Only the lines of longer records are grouped.
Lines end with LF or CR LF; the CR before a record's end is dropped, those inside quotes are kept.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permgrid.sources.files import number_lines

SPLIT = ["path", "split"]
OUTSIDE, IN_FIELD, QUOTED, AFTER_QUOTE = range(4)


def ends_inside(line: Column, starts_inside: bool) -> Column:
    """Is a quoted field open at the end of ``line``?  Walks the pieces between quotes."""
    piece = F.split(line, '"', -1)

    def quote(state: Column, before: Column) -> Column:
        opens = before.endswith(",") | ((before == "") & state.isin(OUTSIDE, AFTER_QUOTE))
        return F.when(state == QUOTED, F.lit(AFTER_QUOTE)).when(opens, F.lit(QUOTED)).otherwise(F.lit(IN_FIELD))

    end = F.aggregate(F.slice(piece, 1, F.size(piece) - 1), F.lit(QUOTED if starts_inside else OUTSIDE), quote)
    return F.when(F.contains(line, F.lit('"')), end == QUOTED).otherwise(F.lit(starts_inside))


def _state_before(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``known`` (the last fixed end before the row, or NULL) and ``odd`` (reversed since then?).

    ``fixed`` is a row's end state when it does not depend on its start, ``turns`` whether it reverses."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(F.col("turns").cast("long")).over(before), F.lit(0))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turned")), ignorenulls=True).over(before)
    return (df.withColumn("turned", turned).withColumn("last", last)
            .withColumn("known", F.col("last.fixed"))
            .withColumn("odd", (F.col("turned") - F.coalesce("last.turned", F.lit(0))) % 2 == 1).drop("last"))


def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, pos, line): lines as they stand, in the order of (split, pos) within a file."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.input_file_name().alias("path"), F.input_file_block_start().alias("split"),
                    F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")))


def csv_records(lines: DataFrame) -> DataFrame:
    """(path, split, pos, record) with the place of each record's first line, blank records left out."""
    out, kept = ends_inside(F.col("line"), False), ends_inside(F.col("line"), True)
    li = (lines.withColumn("out", out).withColumn("kept", kept)
          .withColumn("fixed", F.when(F.col("out") == F.col("kept"), F.col("out")))
          .withColumn("turns", F.col("out") & ~F.col("kept")))
    li = _state_before(li, SPLIT, "pos")
    # one row per split: its end state when that is fixed, and whether it reverses otherwise
    fixed = F.col("fixed").isNotNull()
    ends = li.groupBy(*SPLIT).agg(F.max_by(F.struct("fixed", "turned"), F.when(fixed, F.col("pos"))).alias("last"),
                                  F.sum(F.col("turns").cast("long")).alias("all"))
    odd_after = (F.col("all") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    ends = ends.select(*SPLIT, (F.col("last.fixed") != odd_after).alias("fixed"),
                       (F.col("last").isNull() & odd_after).alias("turns"))
    starts = _state_before(ends, ["path"], "split").select(
        *SPLIT, (F.coalesce("known", F.lit(False)) != F.col("odd")).alias("split_inside"))
    li = li.join(starts, SPLIT).withColumn("inside", F.coalesce("known", "split_inside") != F.col("odd"))
    whole = li.where(~F.col("inside") & ~F.col("out"))
    # lines of longer records: the place of the record's first line, in this split or one before
    upto = Window.partitionBy(*SPLIT).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(~F.col("inside"), F.struct("split", "pos"))
    carried = (li.groupBy(*SPLIT).agg(F.max(begins).alias("own"))
               .withColumn("carried", F.last("own", ignorenulls=True).over(earlier)).drop("own"))
    parts = (li.withColumn("own", F.last(begins, ignorenulls=True).over(upto)).where(F.col("inside") | F.col("out"))
             .join(carried, SPLIT).withColumn("first", F.coalesce("own", "carried")))
    longer = parts.groupBy("path", "first").agg(F.sort_array(F.collect_list(F.struct("split", "pos", "line"))).alias("lines"))
    records = (whole.select(*SPLIT, "pos", F.col("line").alias("record"))
               .unionByName(longer.select("path", F.col("first.split").alias("split"), F.col("first.pos").alias("pos"),
                                          F.array_join("lines.line", "\n").alias("record"))))
    return records.withColumn("record", F.regexp_replace("record", "\r\\z", "")).where("record <> ''")


class DifferentHeaders(ValueError):
    """Files of one upload whose header lines are not the same."""


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as text columns named by their header, with ``row_no``: the record's number
    (from 0, header not counted) in its file.

    Header names count as they are written; of a repeated name the last column is taken; a byte order mark
    is dropped; short records give NULLs and cells beyond the header are dropped.  Files must agree on the
    header, or :class:`DifferentHeaders` is raised.  The records are saved below ``spark.checkpoint.dir``."""
    from permgrid.session import checkpoint_root
    checkpoint_root(spark)
    numbered = number_lines(csv_records(read_csv_lines(spark, path))).select("path", "line_no", "record").checkpoint()
    head = numbered.where("line_no = 0").select(F.ltrim(F.col("record"), F.lit("\ufeff")).alias("head"))
    heads = head.distinct().limit(2).collect()
    if len(heads) > 1:
        raise DifferentHeaders("the files of the upload have different headers")
    names = next(csv.reader([heads[0]["head"]])) if heads else []
    at = {n: i for i, n in enumerate(names)}
    schema = ", ".join(f"c{i} string" for i in range(len(names))) or "c0 string"
    cells = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    rows = numbered.where("line_no > 0").select((F.col("line_no") - 1).alias("row_no"), cells.alias("cells"))
    return rows.select(*[F.col(f"cells.c{i}").alias(n) for n, i in at.items()], "row_no")
