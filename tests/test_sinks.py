import csv

import pytest

from corpusloom import sinks
from corpusloom.sources.files import read_matrix, read_pairs


def rows_of(folder):
    return [line for f in sorted(folder.glob("part-*.csv")) for line in csv.reader(f.open())]


def test_pairs_and_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.123456), ("c", "a", 0.5)], "repo_a string, repo_b string, value double")
    sinks.write_csv(df, str(tmp_path / "p"), "repo_a")
    assert {(r["repo_a"], r["repo_b"], r["value"]) for r in read_pairs(spark, str(tmp_path / "p"), "repo_a", "repo_b", "value").collect()} == {("a", "b", 0.1235), ("c", "a", 0.5)}
    sinks.write_matrix(df, "repo_a", "repo_b", "value", str(tmp_path / "m"))
    assert rows_of(tmp_path / "m") == [["name", "a", "b", "c"], ["a", "1.000", "0.123", "0.500"], ["b", "0.123", "1.000", "0.000"], ["c", "0.500", "0.000", "1.000"]]
    assert {(r["name"], r["other"], r["value"]) for r in read_matrix(spark, str(tmp_path / "m")).collect()} == {("a", "b", 0.123), ("a", "c", 0.5)}
    with pytest.raises(ValueError, match="matrix"):
        sinks.write_matrix(df, "repo_a", "repo_b", "value", str(tmp_path / "n"), most=2)


def test_vectors_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "v")
    frame = lambda rows: spark.createDataFrame(rows, "id long, vec array<float>")
    sinks.upsert_vectors(frame([(1, [1.0]), (2, [2.0])]), path, "id")
    sinks.upsert_vectors(frame([(2, [3.0]), (4, [4.0])]), path, "id")
    (tmp_path / "v/state=3").mkdir()  # a lost writer's
    assert sorted((r["id"], r["vec"]) for r in sinks.read_vectors(spark, path).collect()) == [(1, [1.0]), (2, [3.0]), (4, [4.0])]


def test_pages(spark):
    df = spark.createDataFrame([("a|b", "<x>"), (None, "y")], "k string, v string").coalesce(1)
    assert sinks.markdown_report("T", [("one", df)]) == "# T\n\n## one\n\n| k | v |\n| --- | --- |\n| a\\|b | <x> |\n|  | y |\n"
    assert "<td>&lt;x&gt;</td>" in sinks.html_report("T", [("one", df)])
    with pytest.raises(ValueError, match="page"):
        sinks.markdown_table(spark.range(10_001))
