"""Literal cases for the string and path expressions."""

import datetime as dt
import os

from pyspark.sql import functions as F

from permgrid.functions.paths import (bundle_name, child_path, entry_folder, folder_ancestors,
                                      parse_volume_path, volume_path)
from permgrid.functions.text import JS_SPACE, py_strip, slug_root, user_slug, utf8_lossy
from permgrid.functions.time import token_expiry
from permgrid.operators.files import preview


def ts_parse_csv(content):
    """Plain restatement of the preview split rule (JS trim/split semantics)."""
    import re
    ws = JS_SPACE
    lines = [ln for ln in content.strip(ws).split("\n") if ln.strip(ws)]
    if not lines:
        return [], []
    parse = lambda ln: [re.sub(r'^"|"$', "", c.strip(ws)) for c in ln.split(",")]
    rows = [parse(ln) for ln in lines[1:]]
    return parse(lines[0]), rows


def test_py_strip(spark):
    vals = [" a ", "\t\nb\r\x0b", "　c ", "\x1cd\x1f", "  ", None, "e"]
    got = [r.s for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(py_strip("v").alias("s")).collect()]
    assert got == [v.strip() if v is not None else None for v in vals]


def test_csv_preview_cases(spark):
    texts = {
        "empty": "",
        "header_only": "a,b\n",
        "one_row": "a,b\n1,2\n",
        "crlf_blank": "a,b\r\n\r\n1,2\r\n   \r\n3,4",
        "quoted": 'h1,h2\n"x, y",z\n',
        "200": "h\n" + "\n".join(str(i) for i in range(200)),
        "201": "h\n" + "\n".join(str(i) for i in range(201)),
    }
    lines = [(name, 0, i, ln) for name, text in texts.items() for i, ln in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "path string, split long, pos long, line string")
    got, capped = {}, {}
    for r in preview(df).collect():
        got.setdefault(r.path, {})[r.row_no] = list(r.cells)
    for r in preview(df, max_rows=200).collect():
        capped.setdefault(r.path, []).append(r)
    for name, text in texts.items():
        h, rows = ts_parse_csv(text)
        have = [got.get(name, {})[i] for i in range(len(got.get(name, {})))]
        assert have == ([h] + rows if h else []), name
        assert len(capped.get(name, [])) == len(have[:201]), name
        assert all(r.rows_left == max(len(rows) - 200, 0) for r in capped.get(name, [])), name


def test_lines_of_files_keep_their_order_over_splits(spark, tmpdir_path):
    from permgrid.sources.files import number_lines, read_lines
    want = [f"line {i}" for i in range(4000)]
    os.makedirs(os.path.join(tmpdir_path, "folder=x"))
    with open(os.path.join(tmpdir_path, "folder=x", "a.txt"), "w") as f:
        f.write("\n".join(want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = read_lines(spark, tmpdir_path, ["folder"])
        assert lines.rdd.getNumPartitions() > 1
        got = sorted((r.line_no, r.line, r.folder) for r in number_lines(lines).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, ln, "x") for i, ln in enumerate(want)]


def test_utf8_lossy_and_byte_limit(spark):
    raw = b"ok \xff\xfe bad \xe2\x82 end"
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    got = df.select(utf8_lossy("b").alias("t")).collect()[0].t
    assert got == raw.decode("utf-8", errors="replace")
    big = bytearray(b"x" * (1_048_576 + 10))
    df = spark.createDataFrame([(big,)], "b binary")
    n = df.select(F.length(F.substring("b", 1, 1_048_576)).alias("n")).collect()[0].n
    assert n == 1_048_576


def test_folder_ancestors_and_paths(spark):
    cases = {"/": [], "/a/": ["/"], "/a/b/c/": ["/", "/a/", "/a/b/"], "a/b/": ["a/"],
             "/a/b": ["/", "/a/"]}
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    got = {r.f: list(r.a) for r in df.select("f", folder_ancestors("f").alias("a")).collect()}
    assert got == cases
    day = F.lit("2024-03-05").cast("date")
    names = {r.f: r.n for r in spark.createDataFrame([("/",), ("/a/",), ("/a/b/",)], "f string")
             .select("f", bundle_name("f", day).alias("n")).collect()}
    assert names == {"/": "_20240305.zip", "/a/": "a_20240305.zip", "/a/b/": "a_b_20240305.zip"}
    r = spark.range(1).select(
        volume_path(F.lit("c"), F.lit("s"), F.lit("v"), F.lit("/a/b/"), F.lit("f.csv")).alias("p"),
        child_path(F.lit("/a/"), F.lit("sub//")).alias("cp"),
        entry_folder(F.lit("VOLUME"), F.lit("/x/")).alias("e1"),
        entry_folder(F.lit(None).cast("string"), F.lit("/x/")).alias("e2")).collect()[0]
    assert r.p == "/Volumes/c/s/v/a/b/f.csv" and r.cp == "/a/sub/" and r.e1 == "/" and r.e2 == "/x/"
    p = spark.createDataFrame([("dbfs:/Volumes/c/s/v/f.csv",), ("/Volumes/c/s/v/a/b/g.txt",)], "path string")
    got = [tuple(x) for x in p.select(*parse_volume_path("path")).collect()]
    assert got == [("c", "s", "v", "/", "f.csv"), ("c", "s", "v", "/a/b/", "g.txt")]


def test_slug_and_expiry(spark):
    df = spark.createDataFrame([("a.b-c@x.com",), ("a_1_2@y",)], "e string")
    got = [(r.s, r.r) for r in df.select(user_slug("e").alias("s"), slug_root(user_slug("e")).alias("r")).collect()]
    assert got == [("a_b_c", "a_b_c"), ("a_1_2", "a")]
    t = dt.datetime(2024, 1, 1, 0, 0, 7, 900000)
    r = spark.createDataFrame([(t,)], "m timestamp_ntz").select(token_expiry("m").alias("x")).collect()[0]
    assert r.x == dt.datetime(2024, 1, 1, 0, 10, 7)
