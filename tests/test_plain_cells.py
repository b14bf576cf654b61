"""Preview cells of lines that have nothing to trim come from one split."""

from pyspark.sql import functions as F

from permgrid.functions.text import JS_SPACE, csv_line_cells, js_trim

LINES = ["", ",", "a", "a,b", "a,,b,", 'a,"b"', '"a","",b"', " a , b ", "a, b", "﻿a,b", "a\n", "a,b\n", "a\n,b", "a\r", "ä,漢", "a\tb,c", "!,~,#", "\x7f,a",
         "a\x00,b", *(f"a,{c}b{c}" for c in JS_SPACE), *(f"a{c}" for c in JS_SPACE), None]


def test_cells_are_split_trimmed_and_unquoted(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    each = F.transform(F.split(js_trim("line"), ","), lambda c: F.regexp_replace(js_trim(c), '^"|"$', ""))
    for r in df.select("line", csv_line_cells("line").alias("got"), each.alias("want")).collect():
        assert r["got"] == r["want"], repr(r["line"])


def test_plain_lines_do_without_work_per_cell(spark):
    """The plan tells plain lines before it works on cells."""
    df = spark.createDataFrame([("1,2,3.5,R,1995-01-01",)], "line string")
    tree = df.select(csv_line_cells("line").alias("cells"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in tree and "RLIKE" in tree and tree.index("RLIKE") < tree.index("transform")
    assert df.select(csv_line_cells("line").alias("cells")).first()["cells"] == ["1", "2", "3.5", "R", "1995-01-01"]
