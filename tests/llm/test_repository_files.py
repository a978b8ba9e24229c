from corpusloom.llm import queries


def test_paths_in_windows_style_are_compared_in_one_style(spark, tmp_path):
    scans = [(1, "r", [r"src\a.py", r".\gen\b.py", "src/c.py"])]
    spark.createDataFrame(scans, "scan_id long, repo string, files array<string>").write.parquet(str(tmp_path / "repo_analysis.parquet"))
    files = [(1, "r", "src/a.py", "# Generated by tool. DO NOT EDIT!\nx = 1\n"), (2, "r", r"gen\b.py", "# Generated by tool. DO NOT EDIT!\ny = 1\n"), (3, "r", "src/c.py", "x = 1\n")]
    spark.createDataFrame(files, "file_id long, repo string, path string, content string").write.parquet(str(tmp_path / "file_embedding.parquet"))
    assert [tuple(r) for r in queries.p1_repository_files(spark, str(tmp_path)).collect()] == [(1, 3, 2)]
