"""CSV records read in splits, against Python's csv module over the whole file."""

import csv
import io
import os
import random

import pytest

from permgrid.sources.csv_records import DifferentHeaders, ends_inside, read_csv_text

FIELDS = ["plain", "", "two words", "a,b", 'say "hi"', "line\nbreak", "cr\r\nlf", '"', '""', ',"\n', "é中", "x" * 300, "\n\n", '5" pipe', " pad "]


def write(folder, name, text, bom=False):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return path


def by_csv(text):
    rows = list(csv.DictReader(io.StringIO(text, newline="\n")))
    return [{k: v or "" for k, v in r.items() if k} for r in rows]


def by_spark(spark, path, splits="2k"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_csv_text(spark, path)
        rows = sorted((r.asDict() for r in df.collect()), key=lambda r: r["row_no"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.pop("row_no") for r in rows] == list(range(len(rows)))
    return [{k: v or "" for k, v in r.items()} for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_csv_module(spark, tmpdir_path, end, seed):
    rnd, out = random.Random(seed), io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    w.writerow(["a", "b", "c"])
    for i in range(900):
        w.writerow([str(i), *rnd.choices(FIELDS, k=2)])
    text = out.getvalue()
    path = write(tmpdir_path, "up.csv", text, bom=seed == 1)
    assert spark.read.text(path).count() > 900
    assert by_spark(spark, path) == by_csv(text)


def test_a_break_inside_quotes_over_many_splits(spark, tmpdir_path):
    long = "\n".join(f"line {i}, with a comma" for i in range(2000))
    text = f'a,b\n1,x\n2,"{long}"\n3,"say ""hi""\n"\n4,y'
    assert by_spark(spark, write(tmpdir_path, "up.csv", text), "1k") == by_csv(text)


def test_quotes_in_unquoted_fields_are_plain(spark, tmpdir_path):
    text = 'a,b\n5" pipe,one\n6" pipe,"two\nlines"\nx"y"z,three\n,\n"",""\n'
    assert by_spark(spark, write(tmpdir_path, "up.csv", text)) == by_csv(text)


def test_blank_lines_short_and_long_records(spark, tmpdir_path):
    text = "a,b\r\n\r\n1\r\n\r\n2,3,4\r\n"
    assert by_spark(spark, write(tmpdir_path, "up.csv", text)) == [{"a": "1", "b": ""}, {"a": "2", "b": "3"}]


def test_several_files_and_their_headers(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "many")
    os.makedirs(folder)
    for i in range(3):
        write(folder, f"{i}.csv", f'a,b\n{i},"x\ny"\n{i},z\n')
    got = read_csv_text(spark, folder).collect()
    assert sorted((r.row_no, r.a, r.b) for r in got) == sorted([(0, str(i), "x\ny") for i in range(3)] + [(1, str(i), "z") for i in range(3)])
    write(folder, "odd.csv", "a,c\n1,2\n")
    with pytest.raises(DifferentHeaders):
        read_csv_text(spark, folder)


def test_empty_files(spark, tmpdir_path):
    assert read_csv_text(spark, write(tmpdir_path, "e.csv", "")).count() == 0
    assert by_spark(spark, write(tmpdir_path, "h.csv", "a,b\n")) == []


def test_line_states(spark):
    lines = ['a,b', '"a', 'a"', 'a,"b', '"a""b', '"a"",b', '"a",b"c', '"a"b"c,"d', '""', '"""', '', ',', '"a","b', 'x"",y', '","', '""","']
    df = spark.createDataFrame([(x,) for x in lines], "line string")

    def inside(line, start):
        """A reader that needs one more line to finish its record is inside quotes."""
        text = ('"' if start else "") + line + "\n" + "END"
        return len(list(csv.reader(io.StringIO(text, newline="\n")))) == 1 and bool(line or start)

    got = df.select("line", ends_inside(df.line, False).alias("o"), ends_inside(df.line, True).alias("k")).collect()
    assert [(r.line, r.o, r.k) for r in got] == [(x, inside(x, False), inside(x, True)) for x in lines]
