"""CSV files of one table whose headers differ."""

import pytest

from quarry.operators.profile import normalize_columns
from quarry.sources import tables


def write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, newline="")
    return str(folder)


def rows(frame, *cols):
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=str)


def test_parts_with_other_column_order(spark, tmp_path):
    path = write(tmp_path / "t.csv", p1="a,b\n1,x\n2,y\n", p2="b,a\nz,3\n", p3="a,b\n4,w\n")
    assert rows(tables.read_dataset(spark, path), "a", "b") == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "w")]


def test_parts_that_lack_or_add_columns(spark, tmp_path):
    path = write(tmp_path / "t.csv", p1="a,b\n1,x\n", p2="a\n2\n", p3="c,a\nq,3\n", p4="")
    assert rows(tables.read_dataset(spark, path), "a", "b", "c") == [("1", "x", None), ("2", None, None), ("3", None, "q")]


@pytest.mark.parametrize("header,raw,clean", [
    ("a,A", ["a", "A_2"], ["a", "a_2"]), ("a,a,a", ["a", "a_1", "a_2"], ["a", "a_1", "a_2"]),
    ("x.y,,z z", ["x.y", "Unnamed: 1", "z z"], ["x_y", "unnamed_1", "z_z"]), ('"q,r",s', ["q,r", "s"], ["q_r", "s"]), ("﻿a,b", ["a", "b"], ["a", "b"])])
def test_header_names(spark, tmp_path, header, raw, clean):
    path = tmp_path / "t.csv"
    path.write_text(header + "\n" + ",".join("123"[:len(raw)]) + "\n", encoding="utf-8")
    frame = tables.read_dataset(spark, str(path))
    assert frame.columns == raw
    assert normalize_columns(frame).columns == clean
    assert tuple(frame.first()) == tuple("123"[:len(raw)])


def test_many_blocks_of_one_file(spark, tmp_path):
    """A header is the first line of its file, not of each block."""
    path = tmp_path / "t.csv"
    path.write_text("n,text\n" + "".join(f"{i},row {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        frame = tables.read_dataset(spark, str(path))
        assert frame.columns == ["n", "text"] and frame.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_header_over_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"a\nb",c\n1,"x\ny"\n')
    frame = tables.read_csv_strings(spark, str(path), multi_line=True)
    assert frame.columns == ["a\nb", "c"] and [tuple(r) for r in frame.collect()] == [("1", "x\ny")]


def test_a_file_without_a_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text("")
    assert tables.read_dataset(spark, str(tmp_path / "t.csv")).columns == []


def test_paths_with_blanks(spark, tmp_path):
    path = write(tmp_path / "my table.csv", **{"part 1": "a,b\n1,x\n", "part 2": "b,a\ny,2\n"})
    assert rows(tables.read_dataset(spark, path), "a", "b") == [("1", "x"), ("2", "y")]
