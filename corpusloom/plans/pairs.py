"""Similarity of pairs of repositories on every metric of the job, and what follows from it.

The pairs are a stated set (those a matcher named), so nothing is compared with everything. Set metrics work on one
long table of (repository, kind, value): pairs meet the values of both sides by equality, all kinds in one pass, and a
repository's values are never gathered in a row. Weights and scales are fixed values of the job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans import features
from corpusloom.runtime import cut, read_table

DEEP_WEIGHTS = {"style": 0.05, "architecture": 0.10, "api_design": 0.15, "complexity": 0.05, "dependencies": 0.10, "frameworks": 0.10, "semantic": 0.20, "fingerprint": 0.25}
V2_WEIGHTS = {"vector": 0.30, "dependency": 0.15, "framework": 0.15, "class": 0.10, "function": 0.10, "import": 0.10, "crud": 0.10}
SMART_WEIGHTS = {"project": 0.15, "function": 0.35, "class": 0.20, "file": 0.10, "fingerprint": 0.20}
BLEND_WEIGHTS = {"project": 0.25, "function": 0.35, "class": 0.25, "file": 0.15}
FLAGS = ["app_folder", "tests_folder", "models_file", "routes_file", "schemas_file", "crud_file", "config_file", "dockerfile", "compose"]


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo_a, repo_b)``: every unordered pair of different repositories that a match row names."""
    m = read_table(spark, sf_dir, "code_match").select(F.lower(F.trim("repo1")).alias("x"), F.lower(F.trim("repo2")).alias("y")).where("x <> '' and y <> '' and x <> y")
    return m.select(F.least("x", "y").alias("repo_a"), F.greatest("x", "y").alias("repo_b")).distinct()


def _first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of a repository; cut off within each partition first."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("repo").orderBy(*order))).where(F.col("nth") <= n)


def values_of(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """``(repo, kind, v)``, distinct: the sets that are compared."""
    scans = read_table(spark, sf_dir, "repo_analysis").where("repo is not null")
    functions = read_table(spark, sf_dir, "function_embedding").where("repo is not null")
    pick: dict[str, Callable[[], DataFrame]] = {
        "dependency": lambda: scans.select("repo", F.explode("dependencies").alias("v")),
        "framework": lambda: scans.select("repo", F.explode("frameworks").alias("v")),
        "class": lambda: features.listed(spark, sf_dir, "classes", "v").select("repo", "v"),
        "function": lambda: _first(features.listed(spark, sf_dir, "functions", "v"), 50, "path", "file_id", "pos").select("repo", "v"),
        "import": lambda: features.listed(spark, sf_dir, "imports", "i").select("repo", F.split(F.col("i"), r"\.")[0].alias("v")),
        "file": lambda: _first(features.files(spark, sf_dir), 100, "path", "file_id").select("repo", F.col("path").alias("v")),
        "file400": lambda: _first(features.files(spark, sf_dir), 400, "path", "file_id").select("repo", F.col("path").alias("v")),
        "endpoint": lambda: features.endpoints(spark, sf_dir).select("repo", F.concat_ws(" ", "verb", "path").alias("v")),
        "response": lambda: features.sources(spark, sf_dir).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"response_model\s*=\s*(\w+)"), F.lit(1))).alias("v")),
        "status": lambda: features.sources(spark, sf_dir).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"HTTPException\s*\(\s*status_code\s*=\s*(\d+)"), F.lit(1))).alias("v")),
        "signature": lambda: functions.select("repo", F.col("signature").alias("v")),
        "variable": lambda: _first(features.sources(spark, sf_dir).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*([A-Za-z_]\w*)[ \t]*=[^=]"), F.lit(1))).alias("v")).distinct(), 50, "v").select("repo", "v"),
        "message": lambda: features.sources(spark, sf_dir).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)(?:detail|message|msg)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))).alias("v")),
        "gram7": lambda: features.gram7(spark, sf_dir).select("repo", F.col("h").alias("v")),
        "gram5": lambda: gram5(spark, sf_dir),
        "name": lambda: functions.select("repo", F.col("name").alias("v")),
    }
    tables = [pick[k]().select("repo", F.lit(k).alias("kind"), "v").where("v is not null").distinct() for k in kinds]
    return reduce(DataFrame.unionByName, tables)


def gram5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: ``(repo, v)``, five-word grams of each source file, together for a repository; a shorter file counts whole."""
    words = features.sources(spark, sf_dir).select("repo", F.filter(F.split(features.normalized_code("content"), r"\s+"), lambda x: x != "").alias("w"))
    gram = lambda i: F.substring(F.md5(F.array_join(F.slice(F.col("w"), i, 5), " ")), 1, 8)
    grams = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), gram)).otherwise(F.array(F.md5(F.array_join("w", " "))))
    return words.select("repo", F.explode(grams).alias("v"))


def overlaps(pairs: DataFrame, values: DataFrame, kinds: list[str]) -> DataFrame:
    """``(repo_a, repo_b)`` with ``<kind>_shared``, ``<kind>_union`` and ``<kind>`` (the Jaccard similarity, 0 where
    both are empty) for each kind."""
    values = cut(values)
    sizes = values.groupBy("repo").pivot("kind", kinds).count()
    a = pairs.join(values.withColumnRenamed("repo", "repo_a"), "repo_a")
    met = a.join(values.withColumnRenamed("repo", "repo_b"), ["repo_b", "kind", "v"])
    shared = met.groupBy("repo_a", "repo_b").pivot("kind", kinds).count()
    side = lambda s: sizes.select(F.col("repo").alias(f"repo_{s}"), *(F.col(k).alias(f"{k}_{s}") for k in kinds))
    both = pairs.join(shared, ["repo_a", "repo_b"], "left").join(side("a"), "repo_a", "left").join(side("b"), "repo_b", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [x for k in kinds for union in [n(f"{k}_a") + n(f"{k}_b") - n(k)] for x in (n(k).alias(f"{k}_shared"), union.alias(f"{k}_union"), F.coalesce(F.try_divide(n(k), union), F.lit(0.0)).alias(k))]
    return both.select("repo_a", "repo_b", *out)


def sided(pairs: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """The pairs with the facts of both repositories, as ``<fact>_a`` and ``<fact>_b``."""
    names = [c for c in facts.columns if c != "repo"]
    for s in "ab":
        pairs = pairs.join(facts.select(F.col("repo").alias(f"repo_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in names)), f"repo_{s}", how)
    return pairs


def numeric_similarity(a: Column, b: Column, scale: float) -> Column:
    """1 less the difference in units of the scale, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.lit(float(scale))) if scale else (a == b).cast("double")


def _near(name: str, scale: float) -> Column:
    side = lambda s: F.coalesce(F.col(f"{name}_{s}").cast("double"), F.lit(0.0))
    return numeric_similarity(side("a"), side("b"), scale)


def _mean(*parts: Column) -> Column:
    return reduce(lambda x, y: x + y, parts) / F.lit(float(len(parts)))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("repo_a", "repo_b", *(F.round(n, 6).alias(n) for n in names))


def pair_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M8: set similarities of the second comparison and the share of equal CRUD flags."""
    kinds = ["dependency", "framework", "class", "function", "import", "file"]
    pairs = matched_pairs(spark, sf_dir)
    told = overlaps(pairs, values_of(spark, sf_dir, *kinds), kinds)
    crud = sided(pairs, features.crud_flags(spark, sf_dir))
    same = _mean(*((F.coalesce(f"has_{op}_a", F.lit(False)) == F.coalesce(f"has_{op}_b", F.lit(False))).cast("double") for op in features.CRUD_WORDS))
    both = told.join(crud.select("repo_a", "repo_b", same.alias("crud")), ["repo_a", "repo_b"])
    return both.select("repo_a", "repo_b", *(F.round(c, 6).alias(f"{c}_similarity") for c in (*kinds, "crud")))


def pooled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """``(repo, place, x)``, the mean of a repository's vectors at every place; of one id one vector counts."""
    ids = column.replace("embeddings", "ids")
    rows = read_table(spark, sf_dir, "project_embedding").where("repo is not null").select("repo", F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(column).alias("vec"))).alias("z"))
    rows = rows.select("repo", "z.id", "z.vec").where("id is not null and size(vec) = 64 and not exists(vec, x -> x is null)").dropDuplicates(["repo", "id"])
    return rows.select("repo", F.posexplode("vec").alias("place", "x")).groupBy("repo", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the two sides' vectors, 0 where one is missing or all zeros."""
    norms = vectors.groupBy("repo").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    a = pairs.join(vectors.toDF("repo_a", "place", "xa"), "repo_a")
    dots = a.join(vectors.toDF("repo_b", "place", "xb"), ["repo_b", "place"]).groupBy("repo_a", "repo_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    out = sided(pairs.join(dots, ["repo_a", "repo_b"], "left"), norms)
    return out.select("repo_a", "repo_b", F.coalesce(F.try_divide(F.col("dot"), F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("cosine"))


def pair_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cosines(matched_pairs(spark, sf_dir), pooled(spark, sf_dir, "function_embeddings")), "cosine")


def _weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda x, y: x + y, (F.col(k) * w for k, w in weights.items()))


def pair_combined_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: weighted similarity of the second comparison."""
    vector = pair_vector_cosine(spark, sf_dir).withColumnRenamed("cosine", "vector")
    detail = pair_detail(spark, sf_dir)
    detail = detail.toDF(*(c.removesuffix("_similarity") for c in detail.columns))
    return _rounded(detail.join(vector, ["repo_a", "repo_b"]).withColumn("combined", _weighted(V2_WEIGHTS)), "vector", "combined")


def style_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "function_embedding").where("function_id is not null and repo is not null").groupBy("function_id").agg(F.min("repo").alias("repo"), F.max("line_count").alias("n"), F.min("signature").alias("s"), F.min("name").alias("name"))
    functions = f.groupBy("repo").agg(F.avg("n").alias("function_length"), F.avg(F.regexp_like("s", F.lit(r"->|\w\s*:\s*\w")).cast("double")).alias("hints"))
    names = features.naming_profile(spark, sf_dir).groupBy("repo").pivot("kind", ["functions", "classes"]).agg(F.first("convention"))
    return features.style_profile(spark, sf_dir).join(functions, "repo", "left").join(names, "repo", "left").select("repo", "avg_line_length", "comment_ratio", "function_length", "hints", F.concat_ws("/", F.coalesce("functions", F.lit("unknown")), F.coalesce("classes", F.lit("unknown"))).alias("naming"))


def pair_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, P40."""
    both = sided(matched_pairs(spark, sf_dir), style_facts(spark, sf_dir))
    same = F.when(F.coalesce("naming_a", F.lit("unknown/unknown")) == F.coalesce("naming_b", F.lit("unknown/unknown")), 1.0).otherwise(0.5)
    return _rounded(both.withColumn("style", _mean(_near("avg_line_length", 50), _near("function_length", 30), _near("comment_ratio", 0.3), _near("hints", 1), same)), "style")


def pair_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: share of equal flags."""
    both = sided(matched_pairs(spark, sf_dir), features.architecture_flags(spark, sf_dir).select("repo", *FLAGS))
    same = _mean(*((F.coalesce(f"{x}_a", F.lit(False)) == F.coalesce(f"{x}_b", F.lit(False))).cast("double") for x in FLAGS))
    return _rounded(both.withColumn("architecture", same), "architecture")


def pair_api_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    kinds = ["endpoint", "response", "status"]
    pairs = matched_pairs(spark, sf_dir)
    count = sided(pairs, features.api_profile(spark, sf_dir).select("repo", "endpoints"))
    both = overlaps(pairs, values_of(spark, sf_dir, *kinds), kinds).join(count, ["repo_a", "repo_b"])
    return _rounded(both.withColumn("api_design", _mean(_near("endpoints", 20), *map(F.col, kinds))), "api_design")


def pair_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of functions and classes, use of async."""
    f = read_table(spark, sf_dir, "function_embedding").where("function_id is not null and repo is not null").groupBy("function_id").agg(F.min("repo").alias("repo"), F.bool_or("is_async").alias("a")).groupBy("repo").agg(F.count("*").alias("functions"), F.bool_or("a").alias("a"))
    c = features.listed(spark, sf_dir, "classes", "v").groupBy("repo").agg(F.count("*").alias("classes"))
    both = sided(sided(matched_pairs(spark, sf_dir), f), c)
    same = (F.coalesce("a_a", F.lit(False)) == F.coalesce("a_b", F.lit(False))).cast("double")
    return _rounded(both.withColumn("complexity", _mean(_near("functions", 50), _near("classes", 20), same)), "complexity")


def pair_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9."""
    kinds = ["signature", "class", "variable", "message"]
    return _rounded(overlaps(matched_pairs(spark, sf_dir), values_of(spark, sf_dir, *kinds), kinds).withColumn("semantic", _mean(*map(F.col, kinds))), "semantic")


def pair_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what there is of equal bodies among functions of one name, and of shared seven-word grams."""
    pairs = matched_pairs(spark, sf_dir)
    h = features.last_function_hashes(spark, sf_dir)
    same = pairs.join(h.toDF("repo_a", "name", "ha"), "repo_a").join(h.toDF("repo_b", "name", "hb"), ["repo_b", "name"]).groupBy("repo_a", "repo_b").agg(F.avg((F.col("ha") == F.col("hb")).cast("double")).alias("same"))
    both = overlaps(pairs, values_of(spark, sf_dir, "gram7"), ["gram7"]).join(same, ["repo_a", "repo_b"], "left")
    return _rounded(both.withColumn("fingerprint", F.when(F.col("same").isNull(), F.col("gram7")).otherwise((F.col("same") + F.col("gram7")) / 2)), "fingerprint")


def pair_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight dimensions, their weighted sum, and the sum blended with the vectors' cosine."""
    parts = [pair_style, pair_architecture, pair_api_design, pair_complexity, pair_semantic, pair_fingerprint]
    both = reduce(lambda x, y: x.join(y, ["repo_a", "repo_b"]), (p(spark, sf_dir) for p in parts))
    detail = pair_detail(spark, sf_dir).select("repo_a", "repo_b", F.col("dependency_similarity").alias("dependencies"), F.col("framework_similarity").alias("frameworks"))
    both = both.join(detail, ["repo_a", "repo_b"]).join(pair_vector_cosine(spark, sf_dir), ["repo_a", "repo_b"])
    both = both.withColumn("weighted", _weighted(DEEP_WEIGHTS)).withColumn("combined", 0.7 * F.col("weighted") + 0.3 * F.col("cosine"))
    return both.select("repo_a", "repo_b", *DEEP_WEIGHTS, *(F.round(c, 6).alias(c) for c in ("weighted", "combined")))


def pair_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk class of a pair."""
    fp, sem, api, arch = (F.col(c) for c in ("fingerprint", "semantic", "api_design", "architecture"))
    risk = F.when(fp >= 0.15, "HIGH").when((fp >= 0.08) | ((sem >= 0.5) & (api >= 0.6)), "MEDIUM").when((fp >= 0.03) | ((sem >= 0.4) & (api >= 0.5) & (arch >= 0.8)), "LOW").otherwise("OK")
    return pair_deep(spark, sf_dir).select("repo_a", "repo_b", "fingerprint", "semantic", "api_design", "architecture", risk.alias("risk"))


def project_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, place, x)``, the levels' mean vectors blended by weight and scaled to length 1. The table holds two
    levels; the project's vector is their mean, and classes have none."""
    function, file = (pooled(spark, sf_dir, c) for c in ("function_embeddings", "file_embeddings"))
    both = function.withColumnRenamed("x", "f").join(file.withColumnRenamed("x", "g"), ["repo", "place"], "full")
    f, g = F.coalesce("f", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    both = both.withColumn("y", BLEND_WEIGHTS["project"] * (f + g) / 2 + BLEND_WEIGHTS["function"] * f + BLEND_WEIGHTS["file"] * g)
    norms = both.groupBy("repo").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    return both.join(norms, "repo").select("repo", "place", F.round(F.coalesce(F.try_divide("y", "norm"), F.lit(0.0)), 6).alias("x"))


def pair_smart_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the levels and overlap of winnowed fingerprints of the functions' signatures."""
    pairs = cut(matched_pairs(spark, sf_dir))
    function, file = (cut(pooled(spark, sf_dir, c)) for c in ("function_embeddings", "file_embeddings"))
    project = function.withColumnRenamed("x", "f").join(file.withColumnRenamed("x", "g"), ["repo", "place"], "full").select("repo", "place", ((F.coalesce("f", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))) / 2).alias("x"))
    levels = {"project": project, "function": function, "file": file}
    both = pairs
    for name, vectors in levels.items():
        both = both.join(cosines(pairs, vectors).withColumnRenamed("cosine", name), ["repo_a", "repo_b"])
    prints = winnowed(spark, sf_dir).select("repo", F.lit("print").alias("kind"), F.col("m").alias("v")).distinct()
    both = both.join(overlaps(pairs, prints, ["print"]).select("repo_a", "repo_b", F.col("print").alias("fingerprint")), ["repo_a", "repo_b"]).withColumn("class", F.lit(0.0))
    return _rounded(both.withColumn("combined", _weighted(SMART_WEIGHTS)), "project", "function", "file", "fingerprint", "combined")


def winnowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, function_id, m)``, the smallest of every four neighbouring hashes of five characters of a signature,
    whole inside a row."""
    f = read_table(spark, sf_dir, "function_embedding").where("function_id is not null").groupBy("function_id").agg(F.min("repo").alias("repo"), F.min("signature").alias("s"))
    t = f.withColumn("t", F.regexp_replace(F.lower("s"), r"\s", "")).where("length(t) >= 8")
    hashes = F.transform(F.sequence(F.lit(1), F.length("t") - 4), lambda i: F.substring(F.md5(F.substr(F.col("t"), i, F.lit(5))), 1, 8))
    t = t.withColumn("h", hashes)
    return t.select("repo", "function_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("h") - 3), lambda i: F.array_min(F.slice(F.col("h"), i, 4)))).alias("m"))


def pair_file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first 400 paths two repositories share."""
    return overlaps(matched_pairs(spark, sf_dir), values_of(spark, sf_dir, "file400"), ["file400"]).select("repo_a", "repo_b", F.col("file400_shared").alias("files"))


def pair_gram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word grams that more than three tenths of two code bases share."""
    o = overlaps(matched_pairs(spark, sf_dir), values_of(spark, sf_dir, "gram5"), ["gram5"])
    return o.select("repo_a", "repo_b", F.col("gram5_shared").alias("shared"), F.round("gram5", 6).alias("similarity"), (F.col("gram5") > 0.3).alias("matches"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, kind, v)``: remarks, docstrings and literals long enough to tell something."""
    s = features.sources(spark, sf_dir)
    remark = s.select("repo", F.lit("remark").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)#[ \t]*([^\n]+)$"), F.lit(1))).alias("v")).withColumn("v", F.trim("v")).where("length(v) > 10")
    doc = read_table(spark, sf_dir, "function_embedding").select("repo", F.lit("docstring").alias("kind"), F.trim("docstring").alias("v")).where("length(v) > 20 and repo is not null")
    literal = s.select("repo", F.lit("literal").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r"[\"']([^\"'\n]{16,})[\"']"), F.lit(1))).alias("v")).where(~F.regexp_like("v", F.lit("^(?:/|http|sqlite)")))
    return remark.unionByName(doc).unionByName(literal).distinct()


def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared evidence of a pair by class, differing aspects, and the recommendation."""
    pairs = cut(matched_pairs(spark, sf_dir))
    values = cut(evidence(spark, sf_dir))
    shared = pairs.join(values.withColumnRenamed("repo", "repo_a"), "repo_a").join(values.withColumnRenamed("repo", "repo_b"), ["repo_b", "kind", "v"])
    low, kind, n = F.lower("v"), F.col("kind"), F.length("v")
    expected = features._any(low, features.EXPECTED) | F.regexp_like("v", F.lit(features.EXPECTED_SIGNATURES))
    label = F.when((kind == "remark") & expected, "expected").when((kind == "remark") & (n > 30), "investigate").when((kind == "docstring") & (n > 50), "investigate").when((kind == "literal") & ~expected & ~low.contains("not found") & (n > 30), "unusual")
    told = shared.groupBy("repo_a", "repo_b").agg(*(F.count_if(label == c).alias(c) for c in ("expected", "investigate", "unusual")))
    kinds = ["name", "file400", "import"]
    standard = ["fastapi", "pydantic", "sqlmodel", "typing", "uvicorn", "pytest"]
    other = overlaps(pairs, values_of(spark, sf_dir, *kinds).where(~((F.col("kind") == "import") & F.col("v").isin(*standard))), kinds)
    aspects = sum(((F.col(f"{k}_union") > F.col(f"{k}_shared")).cast("int") for k in kinds), F.lit(0))
    both = other.select("repo_a", "repo_b", aspects.alias("differing")).join(told, ["repo_a", "repo_b"], "left").na.fill(0)
    u, i, d = (F.col(c) for c in ("unusual", "investigate", "differing"))
    advice = F.when(u >= 2, "review").when((u == 1) & (i >= 3), "worth reviewing").when((i >= 5) & (d < 3), "minor").otherwise("normal")
    return both.select("repo_a", "repo_b", "expected", "investigate", "unusual", "differing", advice.alias("recommendation"), advice.isin("review", "worth reviewing").alias("flagged"))


def pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five or more shared function names outside the common ones."""
    stop = ["main", "get", "post", "put", "delete", "create", "read", "update", "list", "init", "__init__", "setup", "teardown", "run", "start", "stop"]
    pairs = matched_pairs(spark, sf_dir)
    values = cut(values_of(spark, sf_dir, "name"))
    sizes = values.groupBy("repo").agg(F.count("*").alias("n"))
    rare = values.where(~F.col("v").isin(*stop))
    shared = pairs.join(rare.select(F.col("repo").alias("repo_a"), "v"), "repo_a").join(rare.select(F.col("repo").alias("repo_b"), "v"), ["repo_b", "v"]).groupBy("repo_a", "repo_b").agg(F.count("*").alias("shared")).where("shared >= 5")
    return sided(shared, sizes).select("repo_a", "repo_b", "shared", F.round(F.col("shared") / F.greatest("n_a", "n_b"), 6).alias("similarity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (pair_detail, pair_vector_cosine, pair_combined_v2, pair_style, pair_architecture, pair_api_design, pair_complexity, pair_semantic, pair_fingerprint, pair_deep, pair_risk, project_blends, pair_smart_combined, pair_file_overlap, pair_gram_overlap, pair_evidence, pair_naming)
}
