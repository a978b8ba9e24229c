"""Sinks: delimited and JSON reports, matrices, tables of vectors, and pages rendered from bounded query results."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page; a longer result belongs in a table.
PAGE_ROWS = 10_000


def write_csv(rows: DataFrame, path: str, *order: str, digits: int = 4) -> None:
    """A headed CSV in the given order, fractions rounded; every task writes its own range of the order."""
    kept = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    (rows.select(*kept).orderBy(*order) if order else rows.select(*kept)).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_matrix(pairs: DataFrame, a: str, b: str, value: str, path: str, most: int = 2000) -> None:
    """A wide symmetric matrix with a unit diagonal, three digits, missing pairs 0; refused beyond ``most`` names."""
    both = pairs.select(F.col(a).alias("name"), F.col(b).alias("other"), F.col(value).alias("v")).unionByName(pairs.select(F.col(b).alias("name"), F.col(a).alias("other"), F.col(value).alias("v")))
    names = [r["name"] for r in both.select("name").distinct().orderBy("name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"a matrix of more than {most} names is for no reader; write the pairs")
    full = both.unionByName(both.select("name", F.col("name").alias("other"), F.lit(1.0).alias("v")).distinct())
    wide = full.groupBy("name").pivot("other", names).agg(F.first("v")).na.fill(0.0)
    wide.select("name", *(F.format_number(F.col(f"`{n}`"), 3).alias(n) for n in names)).orderBy("name").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def upsert_vectors(rows: DataFrame, path: str, key: str) -> None:
    """Adds points to a table of vectors; a point whose key is there already takes the old one's place. The new state is
    written beside the old one and read by its name, ``<path>/state=<n>``, so a lost writer leaves the old state whole."""
    spark = rows.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    states = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder)) if files.exists(folder) else []
    done = [n for n in states if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/state={n}/_SUCCESS"))]
    out = rows
    if done:
        old = spark.read.parquet(f"{path}/state={done[-1]}")
        out = rows.unionByName(old.join(rows.select(key), key, "left_anti"))
    out.write.parquet(f"{path}/state={(states[-1] if states else 0) + 1}")


def read_vectors(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The newest whole state of a table of vectors."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    states = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")))
    return spark.read.parquet(f"{path}/state={states[-1]}")


def _bounded(rows: DataFrame) -> list:
    got = rows.limit(PAGE_ROWS + 1).collect()
    if len(got) > PAGE_ROWS:
        raise ValueError(f"a page holds at most {PAGE_ROWS} rows")
    return got


def markdown_table(rows: DataFrame) -> str:
    """A result as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in _bounded(rows))]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def markdown_report(title: str, parts: Iterable[tuple[str, DataFrame]]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(rows)}" for name, rows in parts)


def html_report(title: str, parts: Iterable[tuple[str, DataFrame]]) -> str:
    """Results as tables of a page, every value escaped."""
    e = lambda v: html.escape("" if v is None else str(v))
    tables = [f"<h2>{e(name)}</h2><table><tr>{''.join(f'<th>{e(c)}</th>' for c in rows.columns)}</tr>{''.join('<tr>' + ''.join(f'<td>{e(v)}</td>' for v in r) + '</tr>' for r in _bounded(rows))}</table>" for name, rows in parts]
    return f"<!doctype html><meta charset='utf-8'><title>{e(title)}</title><h1>{e(title)}</h1>{''.join(tables)}\n"
