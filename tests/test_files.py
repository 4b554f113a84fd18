"""The sink of named files: exact names and texts, retried tasks, failed jobs."""

import os

import pytest
from pyspark.sql import functions as F

from daybook.sources import files


def tree(folder):
    return {os.path.relpath(os.path.join(at, f), folder): open(os.path.join(at, f), newline="").read() for at, _, some in os.walk(folder) for f in some}


ROWS = [("weekly/2024-01-02_03-04.md", "one\r\ntwo"), ("a b+c%20é/ü.md", "  "), ("top.md", None), ("deep/er/x", "no end"), ("deep/y", "\n")]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "name string, text string").repartition(parts)


def test_files_equal_rows(spark, tmp_path):
    folder = str(tmp_path / "out dir")
    files.write_files(table(spark, ROWS), folder)
    want = {n: t or "" for n, t in ROWS}
    assert tree(folder) == want
    assert {r["name"]: r["text"] for r in files.read_files(spark, folder).collect()} == want
    assert {r["name"] for r in files.read_files(spark, folder, "*.md").collect()} == {n for n in want if n.endswith(".md")}


def test_append_and_overwrite(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.write_files(table(spark, ROWS), folder)
    files.write_files(table(spark, [("top.md", "new"), ("more", "m")]), folder)
    assert tree(folder) == {n: t or "" for n, t in ROWS} | {"top.md": "new", "more": "m"}
    files.write_files(table(spark, [("deep/y", "left")]), folder, mode="overwrite")
    assert tree(folder) == {"deep/y": "left"}
    files.write_files(table(spark, []), folder)
    assert tree(folder) == {"deep/y": "left"}


def test_repeated_names(spark, tmp_path):
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1), ("b", "y", 1), ("b", None, 1)], "name string, text string, at int").repartition(5)
    files.write_files(rows, str(tmp_path / "o"), order=["at"])
    assert tree(tmp_path / "o") == {"a": "new", "b": "y"}


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", "a//b", "", None, ".aside/x", "a/./b", "a\\b"])
def test_bad_names_leave_nothing(spark, tmp_path, name):
    folder = tmp_path / "o"
    files.write_files(table(spark, [("kept", "k")]), str(folder))
    with pytest.raises(Exception):
        files.write_files(table(spark, [*ROWS, (name, "x"), ("kept", "changed")], 4), str(folder))
    assert tree(folder) == {"kept": "k"}
    assert not (folder / ".aside").exists()


def test_a_task_that_ran_twice_leaves_one_file(tmp_path):
    import pyarrow as pa

    def rows(texts):
        return iter([pa.RecordBatch.from_pydict({"name": list(texts), "text": list(texts.values())})])

    writer = files._Writer(str(tmp_path), ["name", "text"], False)
    lost = writer.write(rows({"a": "first try", "c": "first try"}))  # ended, but another attempt counts
    kept = writer.write(rows({"a": "second try"}))
    other = writer.write(rows({"b": "b"}))
    assert lost.place != kept.place and tree(tmp_path).keys().isdisjoint({"a", "b", "c"})
    writer.commit([kept, None, other])
    assert tree(tmp_path) == {"a": "second try", "b": "b"}


def test_a_failing_task_is_tried_again(spark, tmp_path):
    mark = str(tmp_path / "failed")

    @F.udf("string")
    def once(text):
        if text == "fails" and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("first attempt")
        return text

    rows = spark.createDataFrame([("x", "fails"), ("y", "fine")], "name string, text string")
    # local masters try a task once only, so the job fails as a whole, and the next one starts clean
    with pytest.raises(Exception):
        files.write_files(rows.select("name", once("text").alias("text")), str(tmp_path / "o"))
    assert tree(tmp_path / "o") == {} if (tmp_path / "o").exists() else True
    files.write_files(rows.select("name", once("text").alias("text")), str(tmp_path / "o"))
    assert tree(tmp_path / "o") == {"x": "fails", "y": "fine"}


def test_names_are_confined():
    assert files.confined("/d", "a/../b") == "/d/b"
    with pytest.raises(ValueError):
        files.confined("/d", "../e")
