"""Sources: source trees, delimited tables with aliases, JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that are never part of a repository's own code; fixed values of the job.
SKIPPED = ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "env", "site-packages"]


def read_trees(spark: SparkSession, root: str, pattern: str = "*", limit: int | None = None, skipped: list[str] | None = None) -> DataFrame:
    """``(repo, path, name, ext, content)`` for every file below ``root/<repo>/`` (or ``root/<repo>/repo/``).

    Bytes that are no UTF-8 are replaced; ``limit`` keeps the leading characters. Skipped and dot directories are cut off.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.rstrip("/") + "/")
    rest = F.substring(F.col("path"), F.locate(root.rstrip("/") + "/", F.col("path")) + F.length(base), F.length("path"))
    files = raw.select(rest.alias("rest"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    files = files.select(F.split("rest", "/")[0].alias("repo"), F.regexp_replace(F.regexp_replace("rest", r"^[^/]+/", ""), r"^repo/", "").alias("path"), "text")
    parts = F.split("path", "/")
    own = ~F.exists(parts, lambda p: p.isin(*(skipped or SKIPPED)) | p.startswith("."))
    content = F.col("text") if limit is None else F.substring("text", 1, limit)
    return files.where(own).select("repo", "path", F.element_at(parts, -1).alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), content.alias("content"))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of several columns that is there and not blank, trimmed."""
    present = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """``(student_name, email, repo_url)`` of a CSV with a header in any of the known spellings; blank rows drop out."""
    table = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    table = table.toDF(*(c.strip() for c in table.columns))
    out = table.select(
        first_of(table, "student_name", "What is your full name?", "student", "name").alias("student_name"),
        first_of(table, "email", "Email Address").alias("email"),
        first_of(table, "repo_url", "Repo URL", "GitHub Repo").alias("repo_url"),
    )
    return out.where("student_name is not null or email is not null or repo_url is not null")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_pairs(spark: SparkSession, path: str, a: str, b: str, value: str) -> DataFrame:
    """``(a, b, value)`` of a headed CSV of pairs; a missing column is an error, a value that is no number null."""
    table = require_columns(spark.read.option("header", "true").option("escape", '"').csv(path), a, b, value)
    return table.select(F.trim(a).alias(a), F.trim(b).alias(b), F.expr(f"try_cast(`{value}` AS double)").alias(value))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(name, other, value)``, name < other: the pairs of a wide symmetric matrix that are not 0."""
    table = spark.read.option("header", "true").csv(path)
    first, *names = table.columns
    cells = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.expr(f"try_cast(`{n}` AS double)") for n in names))))
    return table.select(F.col(f"`{first}`").alias("name"), cells.alias("other", "value")).where("name < other and value <> 0")
