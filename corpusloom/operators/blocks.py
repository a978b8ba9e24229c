"""Code blocks: extraction from files, features of functions, near copies."""

from __future__ import annotations

import ast
import difflib
import functools
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.python_ast import complexity_of, features_of, neutral_identifiers, parsed, renamed, tree_outline
from corpusloom.operators.setsim import alike_classes
from corpusloom.runtime import cut, release

#: A function or class becomes a block from this many lines on; fixed values of the job.
LEAST_LINES = 5
NEAR, STRUCTURAL = 0.85, 0.70
LINES_SHARED, SHAPES_SHARED = 0.4, 0.65
BOILERPLATE = r"from fastapi import|from pydantic import|import uvicorn|if __name__ == [\"']__main__[\"']|app = FastAPI\(|@app\.(get|post|put|patch|delete)|HTTPException|status_code="


def normalized_code(code: str | Column) -> Column:
    """Comments and docstrings dropped, lines trimmed, empty lines left out."""
    text = F.col(code) if isinstance(code, str) else code
    bare = F.regexp_replace(text, r"(?md)#.*$", "")
    for quote in ('"""', "'''"):
        bare = F.regexp_replace(bare, rf"(?s){quote}.*?{quote}", "")
    lines = F.transform(F.split(bare, r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, r"^[\s]+|[\s]+$", "")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def code_fingerprint(code: str | Column) -> Column:
    return F.md5(normalized_code(code))


def _block(node: ast.AST, kind: str, lines: list[str]) -> tuple:
    """A function or class as a block: its text, complexity, calls, signature, decorators and forms without names."""
    calls = sorted({ast.unparse(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)})[:20]
    decorators = ",".join(map(ast.unparse, node.decorator_list))
    signature = f"{node.name}({', '.join(map(ast.unparse, node.bases))})" if kind == "class" else f"{node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
    code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
    outline = hashlib.md5(tree_outline(node).encode()).hexdigest()
    dump = ast.dump(renamed(ast.parse(ast.unparse(node))))[:2000]
    return kind, node.name, code, node.lineno, node.end_lineno, complexity_of(node), ",".join(calls), signature, decorators, hashlib.md5(dump.encode("utf-8", "surrogatepass")).hexdigest(), outline


def blocks_of(text: str) -> list[tuple]:
    """``(type, name, code, start, end, complexity, calls, signature, decorators, shape, outline)`` of a file's functions
    and classes; a file that doesn't parse is one segment. Equal shapes differ in names and long literals only."""
    tree = parsed(text)
    lines = text.split("\n")
    if tree is None:
        told = [line for line in lines if line.strip()]
        return [("segment", "<file>", text[:2000], 1, len(lines), 0, "", "", "", "", "")] if len(told) >= LEAST_LINES else []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [_block(node, kinds[type(node)], lines) for node in ast.walk(tree) if type(node) in kinds and node.end_lineno - node.lineno >= LEAST_LINES]


def extract_blocks(files: DataFrame, file_id: str, path: str, content: str) -> DataFrame:
    """One row per block of every Python file; null ids, paths and contents are left out."""
    rows = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(content).alias("text")).where(F.col(path).endswith(".py") & F.col("file_id").isNotNull() & F.col("text").isNotNull())

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "block_type", "name", "code", "start_line", "end_line", "complexity", "calls", "signature", "decorators", "shape", "outline"]
        for pdf in batches:
            yield pd.DataFrame([(i, *b) for i, t in zip(pdf["file_id"], pdf["text"], strict=True) for b in blocks_of(t)], columns=names)

    return rows.mapInPandas(extract, "file_id bigint, block_type string, name string, code string, start_line int, end_line int, complexity int, calls string, signature string, decorators string, shape string, outline string")


def file_features(files: DataFrame, file_id: str, repo: str, path: str, content: str) -> DataFrame:
    """``(file_id, repo, kind, value, number)``: the features of every Python file's syntax tree, in one pass; null ids and
    files that don't parse give none, repeated rows repeat theirs."""
    rows = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(repo).alias("repo"), F.col(content).alias("text")).where(F.col(path).endswith(".py") & F.col("file_id").isNotNull())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, r, *row) for i, r, t in zip(pdf["file_id"], pdf["repo"], pdf["text"], strict=True) for row in features_of(t)]
            yield pd.DataFrame(out, columns=["file_id", "repo", "kind", "value", "number"])

    return rows.mapInPandas(walk, "file_id bigint, repo string, kind string, value string, number double")


@functools.lru_cache(1)
def _places(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def may_match(x: str, y: str, least: int) -> bool:
    """Whether the longest common subsequence has ``least`` characters, found by bits; given up once too many of x are
    left over. What a sequence matcher matches is a common subsequence. Calls with one y in a row find its bits once."""
    full, spare, places = (1 << len(y)) - 1, len(x) - least, _places(y).get
    if spare < 0:
        return False
    free = full
    for at in range(0, len(x), 16):
        part = x[at : at + 16]
        for c in part:
            hit = free & places(c, 0)
            free = free + hit | free - hit
        free &= full
        if at + len(part) - (len(y) - free.bit_count()) > spare:
            return False
    return True


def string_ratio(x: str, y: str, least: float = 0.0) -> float:
    """The sequence matcher's ratio, or 0 where the longest common subsequence already stays below the least that counts."""
    if least > 0 and not may_match(x, y, math.ceil(least * (len(x) + len(y)) / 2 - 1e-9)):
        return 0.0
    return difflib.SequenceMatcher(None, x, y).ratio()


def _judged(same: float, cx: str, cy: str) -> tuple[float, str] | None:
    """Similarity and kind of a pair whose texts have the ratio: near exact by it, or structural where only names differ."""
    shape = string_ratio(neutral_identifiers(cx), neutral_identifiers(cy))
    if same >= NEAR:
        return max(same, shape), "near_exact"
    return (shape, "structural") if shape >= NEAR else None


def _normal_blocks(blocks: DataFrame, block_id: str, repo: str, code: str) -> DataFrame:
    rows = blocks.select(F.col(block_id).alias("id"), F.col(repo).alias("repo"), F.col(code).alias("code")).where("id is not null and code is not null").dropDuplicates(["id"])
    return rows.where(~F.regexp_like("code", F.lit(BOILERPLATE))).withColumn("n", normalized_code("code")).where("n <> ''")


def distinct_blocks(blocks: DataFrame, block_id: str, repo: str, code: str) -> DataFrame:
    """``(id, repo, n, code, t)``: every block with its normalised text and ``t``, the smallest id of that text. Null ids
    and codes, empty texts and blocks with boilerplate are left out; repeated rows of an id count once."""
    norm = _normal_blocks(blocks, block_id, repo, code)
    return norm.join(norm.groupBy("n").agg(F.min("id").alias("t")), "n").select("id", "repo", "n", "code", "t")


def _alike(lines: DataFrame, threshold: float, together: int) -> DataFrame:
    """``(a, b)``, a < b: texts whose sets of lines reach the threshold, those of equal sets included."""
    pairs, owners = alike_classes(lines, "t", "line", threshold, together)
    x, y = owners.toDF("ea", "a"), owners.toDF("eb", "b")
    across = pairs.select("a", "b").join(x, "a").join(y, "b")
    within = owners.toDF("ea", "c").join(owners.toDF("eb", "c"), "c").where("ea < eb")
    return across.select("ea", "eb").unionByName(within.select("ea", "eb")).select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b"))


def near_copies(blocks: DataFrame, block_id: str, repo: str, code: str) -> DataFrame:
    """``(id_a, id_b, similarity, match_type)``, id_a < id_b: different texts that stand in different repositories and are
    alike; an id stands for all blocks of its text (``distinct_blocks`` has the membership), so copies are not spelt out.

    Candidates share lines to a Jaccard similarity of ``LINES_SHARED``, or pairs of neighbouring lines with names and
    numbers masked (``SHAPES_SHARED``), exact by prefix filtering, and differ by at most three tenths of the longer one's lines, five at
    least. Similarity and kind follow the job's rules: ``near_exact`` from a text ratio of 0.85 on, ``structural`` from 0.7
    on where the ratio with neutral names reaches 0.85. The ratio is the sequence matcher's, from the smaller id on.
    """
    kind = dict(blocks.select(F.col(block_id).alias("id")).dtypes)["id"]
    same_text = _normal_blocks(blocks, block_id, repo, code).groupBy("n")
    texts = cut(same_text.agg(F.min("id").alias("t"), F.min("repo").alias("first"), F.max("repo").alias("last"), F.min_by("code", "id").alias("code")).withColumn("lines", F.size(F.split("n", "\n"))))
    lines = cut(texts.select("t", F.posexplode(F.split("n", "\n")).alias("pos", "line")))
    shape = F.regexp_replace("line", r"[A-Za-z_]\w*|\d+", "v")
    # Two neighbouring masked lines are an element, since single ones are too common to tell; of equal elements of a text
    # the second is another than the first.
    shaped = lines.select("t", "pos", shape.alias("s")).withColumn("shape", F.concat_ws("\n", "s", F.lead("s").over(W.partitionBy("t").orderBy("pos"))))
    nth = F.row_number().over(W.partitionBy("t", "shape").orderBy("pos"))
    shapes = shaped.select("t", F.concat_ws("#", "shape", nth.cast("string")).alias("line"))
    near = _alike(lines, LINES_SHARED, 1).unionByName(_alike(shapes, SHAPES_SHARED, 3)).distinct()
    release(lines)
    facts = texts.select("t", "first", "last", "lines", F.char_length("n").alias("size"))
    pairs = near.join(facts.toDF("a", "fa", "la", "na", "sa"), "a").join(facts.toDF("b", "fb", "lb", "nb", "sb"), "b")
    close = F.abs(F.col("na") - F.col("nb")) <= F.greatest(F.lit(5.0), 0.3 * F.greatest("na", "nb"))
    able = F.lit(2.0) * F.least("sa", "sb") / (F.col("sa") + F.col("sb")) >= STRUCTURAL  # the ratio's bound by sizes
    pairs = cut(pairs.where(close & able & ~((F.col("fa") == F.col("lb")) & (F.col("la") == F.col("fb")))).select("a", "b"))
    both = pairs.join(texts.select(F.col("t").alias("a"), F.col("n").alias("x")), "a").join(texts.select(F.col("t").alias("b"), F.col("n").alias("y")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = [string_ratio(x, y, STRUCTURAL) for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)]
            yield pdf[["a", "b"]].assign(same=pd.Series(same, pdf.index, "float64")).query(f"same >= {STRUCTURAL}")

    # Codes go only to the pairs whose texts are alike, which are few.
    same = cut(both.mapInPandas(compare, f"a {kind}, b {kind}, same double"))
    both = same.join(texts.select(F.col("t").alias("a"), F.col("code").alias("ca")), "a").join(texts.select(F.col("t").alias("b"), F.col("code").alias("cb")), "b")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, *three in zip(*(pdf[c].tolist() for c in ("a", "b", "same", "ca", "cb")), strict=True):
                got = _judged(*three)
                if got:
                    out.append((a, b, round(got[0], 6), got[1]))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "similarity", "match_type"])

    return both.mapInPandas(judge, f"id_a {kind}, id_b {kind}, similarity double, match_type string")
