"""What is reported: matches of every kind and their scores, rankings, groups, cards, and the rows behind files and pages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.json_repair import is_json
from corpusloom.operators.blocks import extract_blocks, file_features
from corpusloom.operators.components import connected_components
from corpusloom.operators.linkage import linkage_leaves
from corpusloom.operators.ranking import global_rank, min_max
from corpusloom.plans import features, pairs, replies
from corpusloom.runtime import cut, read_table

# --- fixed values ---
KIND_WEIGHTS = {"exact": 1.0, "near_exact": 0.9, "structural": 0.85, "naming_pattern": 0.3, "fingerprint_overlap": 0.5}
SKIPPED = {
    "first": [".git", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache"],
    "second": [".git", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", ".tox", "egg-info"],
    "blocks": [".git", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache"],
}
POINTS = {
    "feature": [r"(?i)skip.*limit|offset|page", r"(?i)search|filter|query", r"@field_validator|@model_validator|validator", r"(?i)sort|order_by|ordering", r"(?i)OAuth|JWT|token|Bearer|authenticate", r"(?i)relationship|ForeignKey|joinedload", r"(?i)BackgroundTask|celery|async.*task", r"(?i)websocket", r"(?i)cache|redis", r"(?i)rate.?limit|throttle"],
    "quality": [r"\"{3}", r"logging\.getLogger|logger\s*=", r"class.*Settings.*BaseSettings", r"(?s)try:.+?except", r"HTTPException\(status_code=\d+,\s*detail="],
    "technical": [r"async\s+def|await\s+", r"Depends\(", r"middleware|Middleware", r"(?i)Repository|repository.*pattern", r"(?i)Factory|factory.*pattern", r"@pytest\.fixture|fixture", r"parametrize|@pytest\.mark", r"(?i)migration|alembic"],
    "extra": [r"typer|click|argparse", r"(?i)seed|populate|init.*data", r"(?i)render|heroku|railway"],
}
FLOORS = {"feature": 2, "quality": 1, "technical": 2, "extra": 1}
TEMPLATE = "grade --name '{student_name}' --repo {repo_url} --slug {slug}"


def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal blocks of matched pairs, the last block of a side standing for its copies."""
    b = read_table(spark, sf_dir, "code_block").where("block_id is not null").groupBy("block_id").agg(F.min("repo").alias("repo"), F.min("normalized").alias("n"), F.min("code").alias("code")).where("n is not null")
    own = b.where(~F.regexp_like(F.coalesce("code", F.lit("")), F.lit(features.BOILERPLATE))).groupBy("repo", F.md5("n").alias("fp")).agg(F.max("block_id").alias("block"))
    met = pairs.matched_pairs(spark, sf_dir).join(own.toDF("repo_a", "fp", "block_a"), "repo_a").join(own.toDF("repo_b", "fp", "block_b"), ["repo_b", "fp"])
    return met.select("repo_a", "repo_b", "fp", "block_a", "block_b")


def every_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the kinds that follow from blocks, names and grams, in one table."""
    exact = exact_matches(spark, sf_dir).select("repo_a", "repo_b", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    names = pairs.pair_naming(spark, sf_dir).select("repo_a", "repo_b", F.lit("naming_pattern").alias("kind"), "similarity")
    grams = pairs.pair_gram_overlap(spark, sf_dir).where("matches").select("repo_a", "repo_b", F.lit("fingerprint_overlap").alias("kind"), "similarity")
    return exact.unionByName(names).unionByName(grams)


def _verdict(score: Column, n: Column) -> Column:
    return F.when(n == 0, "clean").when(score >= 0.7, "HIGH_PLAGIARISM").when(score >= 0.4, "SUSPICIOUS").when(score >= 0.2, "NEEDS_REVIEW").otherwise("likely_clean")


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score and verdict of every matched pair; a pair without matches is clean."""
    weight = F.coalesce(F.element_at(F.create_map(*(x for k, w in KIND_WEIGHTS.items() for x in (F.lit(k), F.lit(w)))), F.col("kind")), F.lit(0.5))
    g = every_match(spark, sf_dir).groupBy("repo_a", "repo_b").agg(F.count("*").alias("matches"), F.sum(F.col("similarity") * weight).alias("s"))
    t = pairs.matched_pairs(spark, sf_dir).join(g, ["repo_a", "repo_b"], "left").na.fill(0)
    score = F.least(F.col("s") / 3, F.lit(1.0))
    return t.select("repo_a", "repo_b", "matches", F.round(score, 6).alias("score"), _verdict(score, F.col("matches")).alias("verdict"))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, O1: the scores in order of severity."""
    severity = F.when(F.col("verdict") == "HIGH_PLAGIARISM", 0).when(F.col("verdict") == "SUSPICIOUS", 1).when(F.col("verdict") == "NEEDS_REVIEW", 2).otherwise(3)
    return global_rank(match_scores(spark, sf_dir).withColumn("severity", severity), F.col("severity"), F.desc("score"), F.col("repo_a"), F.col("repo_b")).select("position", "repo_a", "repo_b", F.round("score", 4).alias("score"), "verdict")


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five matches of each pair with previews."""
    m = read_table(spark, sf_dir, "code_match").where("match_id is not null").groupBy("match_id").agg(*(F.min(c).alias(c) for c in ("repo1", "repo2", "similarity", "match_type", "code1_preview", "code2_preview")))
    m = m.select("match_id", F.lower(F.trim("repo1")).alias("x"), F.lower(F.trim("repo2")).alias("y"), "similarity", "match_type", "code1_preview", "code2_preview").where("x <> '' and y <> '' and x <> y")
    m = m.withColumns({"repo_a": F.least("x", "y"), "repo_b": F.greatest("x", "y")})
    nth = F.row_number().over(W.partitionBy("repo_a", "repo_b").orderBy(F.desc_nulls_last("similarity"), "match_id"))
    cut_to = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 300)
    return m.withColumn("nth", nth.cast("bigint")).where("nth <= 5").select("repo_a", "repo_b", "nth", "match_id", "match_type", "similarity", cut_to("code1_preview").alias("preview1"), cut_to("code2_preview").alias("preview2"))


def deep_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, O1: pairs by combined similarity."""
    return global_rank(pairs.pair_deep(spark, sf_dir).select("repo_a", "repo_b", "combined", "fingerprint"), F.desc("combined"), F.col("repo_a"), F.col("repo_b"))


def extreme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the ten most and the five least similar pairs."""
    r = cut(deep_ranking(spark, sf_dir))
    top = r.orderBy("position").limit(10).select(F.lit("head").alias("part"), "position", "repo_a", "repo_b")
    return top.unionByName(r.orderBy(F.desc("position")).limit(5).select(F.lit("tail").alias("part"), "position", "repo_a", "repo_b"))


def nearest_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best partners of every repository."""
    p = cut(pairs.pair_combined_v2(spark, sf_dir))
    both = p.select(F.col("repo_a").alias("repo"), F.col("repo_b").alias("match"), "combined").unionByName(p.select(F.col("repo_b").alias("repo"), F.col("repo_a").alias("match"), "combined"))
    nth = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("combined"), "match")).cast("bigint")
    return both.withColumn("position", nth).where("position <= 3").select("repo", "position", "match", F.round("combined", 4).alias("combined"))


def similarity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the symmetric matrix that are not 0, with its diagonal of ones."""
    p = cut(pairs.pair_combined_v2(spark, sf_dir).select("repo_a", "repo_b", F.round("combined", 3).alias("value")))
    both = p.toDF("name", "other", "value").unionByName(p.select(F.col("repo_b").alias("name"), F.col("repo_a").alias("other"), "value"))
    return both.unionByName(both.select("name", F.col("name").alias("other"), F.lit(1.0).alias("value")).distinct())


def framework_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of each framework, their number and share."""
    t = read_table(spark, sf_dir, "repo_analysis").where("repo is not null").select("repo", F.explode("frameworks").alias("framework")).distinct()
    n = read_table(spark, sf_dir, "repo_analysis").agg(F.count_distinct("repo")).first()[0] or 1
    g = t.groupBy("framework").agg(F.count("*").alias("repos"))
    return t.join(g, "framework").select("framework", "repo", "repos", F.round(F.col("repos") * 100 / n, 4).alias("percent"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at 0.45 with their members and sizes; a repository without such a link is a group of its own."""
    m = read_table(spark, sf_dir, "code_match").select(F.lower(F.trim("repo1")).alias("a"), F.lower(F.trim("repo2")).alias("b"), "similarity").where("a <> '' and b <> '' and a <> b")
    every = m.select("a").unionByName(m.select(F.col("b").alias("a"))).distinct().toDF("repo")
    linked = connected_components(m.where("similarity >= 0.45"), "a", "b", "repo", "c")
    rows = cut(every.join(linked, "repo", "left").select("repo", F.coalesce("c", "repo").alias("cluster")))
    return rows.join(rows.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("cluster", "size", "repo")


def _linkage_leaves(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
    names = sorted({*links["repo_a"], *links["repo_b"]})
    place = {n: i for i, n in enumerate(names)}
    order = linkage_leaves(len(names), zip(links["repo_a"].map(place).tolist(), links["repo_b"].map(place).tolist(), links["combined"].tolist(), strict=True))
    return pd.DataFrame({"component": key[0], "nth": range(len(order)), "repo": [names[i] for i in order]})


def linkage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories in the order of the average-linkage tree. Those that no chain of alike pairs joins are unlike, so
    their trees stand side by side by their first name: each is built by a task of its own."""
    p = cut(pairs.pair_combined_v2(spark, sf_dir).select("repo_a", "repo_b", F.coalesce("combined", F.lit(0.0)).alias("combined")))
    links = p.where("combined > 0")
    own = cut(connected_components(links, "repo_a", "repo_b", "repo", "component"))
    trees = links.join(own.withColumnRenamed("repo", "repo_a"), "repo_a").groupBy("component").applyInPandas(_linkage_leaves, "component string, nth bigint, repo string")
    every = p.select(F.col("repo_a").alias("repo")).union(p.select("repo_b")).distinct()
    alone = every.join(own, "repo", "left_anti").select(F.col("repo").alias("component"), F.lit(0).cast("bigint").alias("nth"), "repo")
    return global_rank(trees.unionByName(alone), F.col("component"), F.col("nth")).select("position", "repo")


def risk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each risk class and verdict."""
    r = pairs.pair_risk(spark, sf_dir).select("repo_a", "repo_b", "risk").join(match_scores(spark, sf_dir).select("repo_a", "repo_b", "verdict"), ["repo_a", "repo_b"], "left")
    return r.groupBy("risk", "verdict").agg(F.count("*").alias("pairs"))


def slug_of(name: Column, url: Column) -> Column:
    """Lower case, runs of other signs to one underscore, the repository's name behind, at most 64 characters."""
    base = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.nullif(url, F.lit("")), F.lit("submission")))), "[^a-z0-9]+", "_"), F.lit("_"))
    tail = F.replace(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "([^/]*)$", 1), F.lit(".git"), F.lit(""))
    slug = F.substring(F.concat_ws("_", F.nullif(base, F.lit("")), F.nullif(tail, F.lit(""))), 1, 64)
    return F.when(slug == "", "submission").otherwise(slug)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest usable row of each address, trimmed."""
    t = read_table(spark, sf_dir, "submission").where("submission_id is not null").dropDuplicates(["submission_id"])
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    t = t.select("submission_id", "submitted_at", F.lower(clean("email")).alias("email"), clean("student_name").alias("student_name"), F.coalesce(clean("repo_url"), clean("repo")).alias("repo_url"), clean("repo").alias("repo")).where("email is not null and repo_url is not null")
    nth = F.row_number().over(W.partitionBy("email").orderBy(F.desc_nulls_last("submitted_at"), F.desc("submission_id")))
    return t.withColumn("nth", nth).where("nth = 1").drop("nth", "submitted_at")


def submission_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug of a submission and the command that its template gives."""
    s = submissions(spark, sf_dir).withColumn("slug", slug_of(F.col("student_name"), F.col("repo_url")))
    command = F.lit(TEMPLATE)
    for c in ("student_name", "repo_url", "slug"):
        command = F.replace(command, F.lit("{" + c + "}"), F.coalesce(c, F.lit("")))
    return s.select("submission_id", "slug", command.alias("command"))


def ranked_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked list: score, percentage and status of the reply, the score between 87 and 99, what is missing."""
    s = submissions(spark, sf_dir).withColumn("slug", slug_of(F.col("student_name"), F.col("repo_url")))
    r = replies.reply_status(spark, sf_dir).withColumnRenamed("event_id", "submission_id")
    c = features.file_checklist(spark, sf_dir).select("repo", F.col("score").alias("files"), "missing")
    t = s.join(r, "submission_id", "left").join(c, "repo", "left")
    t = min_max(cut(t), "score", F.coalesce(F.col("score"), F.lit(0.0)) > 1, 87, 99)
    t = global_rank(t, F.desc("normalized"), F.asc_nulls_first("student_name"), F.col("submission_id"))
    return t.select("position", "submission_id", "student_name", "email", "repo_url", "slug", "score", "percent", "status", "normalized", "files", "missing")


def minmax_normalize_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances above 1 scaled to [87, 99] and all customers ranked."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    t = min_max(c, "c_acctbal", F.col("c_acctbal") > 1, 87, 99)
    return global_rank(t.select("c_custkey", "c_name", "normalized"), F.desc("normalized"), F.col("c_name"), F.col("c_custkey"))


def first_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five submissions, in order of their ids (the limit is the feature)."""
    return submissions(spark, sf_dir).select("submission_id", "email").orderBy("submission_id").limit(5)


def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a report as rows of section, key and value."""
    r = cut(replies.reply_status(spark, sf_dir))
    band = F.when(F.col("score") >= 9.5, "9.5").when(F.col("score") >= 8.5, "8.5").when(F.col("score") >= 7.5, "7.5").when(F.col("score") >= 6.5, "6.5").when(F.col("score") >= 5.5, "5.5").otherwise("below")
    total = r.agg(F.count("*").cast("double").alias("count"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"))
    numbers = total.select(F.explode(F.create_map(*(x for c in ("count", "least", "most", "mean") for x in (F.lit(c), F.col(c))))).alias("key", "value")).select(F.lit("scores").alias("section"), "key", "value")
    count = lambda section, key: r.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "key", "value")
    return numbers.unionByName(count("status", F.col("status"))).unionByName(count("band", band))


def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files of a repository down to the fourth level."""
    parts = F.split("path", "/")
    t = features.files(spark, sf_dir).select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("entry"))
    return t.distinct().withColumn("depth", F.size(F.split("entry", "/")).cast("bigint"))


def walk_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files that each of the five walks visits."""
    parts, low = F.split("path", "/"), F.lower("path")
    base = F.element_at(F.split(low, "/"), -1)
    free = lambda family: ~F.exists(parts, lambda p: p.isin(*SKIPPED[family]))
    dots = F.exists(parts, lambda p: p.startswith("."))
    walks = {"features": free("second"), "blocks": free("blocks") & ~low.contains("test"), "embeddings": free("second") & ~base.contains("test"), "evidence": ~dots, "points": F.lit(True), "first": free("first") & ~dots}
    return features.sources(spark, sf_dir).groupBy("repo").agg(*(F.count_if(rule).alias(name) for name, rule in walks.items()))


def json_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files by state: empty, invalid or valid."""
    t = features.files(spark, sf_dir).where("ext = '.json'")
    state = F.when(F.trim("content") == "", "empty").when(is_json("content"), "valid").otherwise("invalid")
    return t.select("file_id", state.alias("state"))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks hold each expected pattern."""
    low = F.lower(F.coalesce("code", F.lit("")))
    b = read_table(spark, sf_dir, "code_block").where("block_id is not null").groupBy("block_id").agg(F.min("code").alias("code"))
    hits = F.array_compact(F.array(*(F.when(low.contains(p), p) for p in features.EXPECTED)))
    return b.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("blocks"))


def standard_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repositories' imports that are in the standard list."""
    known = spark.createDataFrame([(m,) for m in features.STANDARD_MODULES], "module string")
    i = features.listed(spark, sf_dir, "imports", "i").select("repo", F.split(F.col("i"), r"\.")[0].alias("module")).distinct()
    return i.join(F.broadcast(known), "module", "left_semi").groupBy("module").agg(F.count("*").alias("repos"))


def exclusive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of matched pairs on both sides, on either, and on one only."""
    o = pairs.overlaps(pairs.matched_pairs(spark, sf_dir), pairs.values_of(spark, sf_dir, "file400"), ["file400"])
    return o.select("repo_a", "repo_b", F.col("file400_shared").alias("common"), F.col("file400_union").alias("either"), (F.col("file400_union") - F.col("file400_shared")).alias("one"))


def feature_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points for each feature that a repository's sources show, ten at most, a floor for none."""
    s = features.sources(spark, sf_dir)
    hits = {f"{k}_{n}": F.bool_or(F.regexp_like("content", F.lit(p))) for k, ps in POINTS.items() for n, p in enumerate(ps)}
    g = s.groupBy("repo").agg(*(h.alias(c) for c, h in hits.items()))
    score = lambda k: F.greatest(F.lit(FLOORS[k]), F.least(F.lit(10), 2 * sum((F.col(f"{k}_{n}").cast("int") for n in range(len(POINTS[k]))), F.lit(0))))
    g = g.select("repo", *(score(k).alias(k) for k in POINTS)).withColumn("total", sum((F.col(k) for k in POINTS), F.lit(5)))
    return g.withColumn("grade", F.when(F.col("total") >= 40, "A").when(F.col("total") >= 32, "B").when(F.col("total") >= 24, "C").when(F.col("total") >= 16, "D").otherwise("F"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the tables, in order."""
    tables = ["code_block", "code_match", "documents", "file_embedding", "function_embedding", "project_embedding", "repo_analysis", "repo_code_profile", "submission"]
    return spark.createDataFrame([(t, n, c) for t in tables for n, c in enumerate(read_table(spark, sf_dir, t).columns, 1)], "name string, position int, column_name string")


def ast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All and different features of each kind in a repository."""
    f = file_features(features.files(spark, sf_dir), "file_id", "repo", "path", "content")
    return f.groupBy("repo", "kind", "value").agg(F.count("*").alias("n")).groupBy("repo", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("different"))


def ast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and flags of a repository's syntax trees."""
    f = file_features(features.files(spark, sf_dir), "file_id", "repo", "path", "content")
    n = lambda kind, value=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if value is None else F.col("value") == value))
    return f.groupBy("repo").agg(n("function").alias("functions"), n("class").alias("classes"), n("method").alias("methods"), n("handler").alias("handlers"), n("import").alias("imports"), n("model").alias("models"), n("documented").alias("documented"), n("hinted").alias("hinted"), F.max(F.when(F.col("kind") == "function", F.col("number"))).alias("top_complexity"), F.round(F.avg(F.when(F.col("kind") == "function_length", F.col("number"))), 6).alias("function_length"), *((n("flag", flag) > 0).alias(flag) for flag in ("async", "generators", "contexts", "comprehensions")))


def shape_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes that are equal once names and long literals are replaced."""
    b = extract_blocks(features.files(spark, sf_dir), "file_id", "path", "content").where("shape <> ''")
    return b.groupBy("shape").agg(F.count("*").alias("blocks"), F.count_distinct("file_id").alias("files"), F.min("name").alias("first_name"), F.count_distinct("outline").alias("outlines")).where("blocks > 1")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exact_matches, every_match, match_scores, score_table, match_report, deep_ranking, extreme_pairs, nearest_repositories, similarity_cells, framework_groups, cluster_members, linkage_order, risk_cards, submission_slugs, ranked_submissions,
        minmax_normalize_rank, first_submissions, summary_report, path_tree, walk_families, json_status, pattern_hits, standard_imports, exclusive_paths, feature_points, table_columns, ast_features, ast_profile, shape_groups,
    )
}
