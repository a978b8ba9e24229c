"""The catalogue: queries declared as SQL here, and those of ``features``, ``pairs``, ``replies`` and ``reports``.

``SHARED`` is text that both engines read alike; where dialects differ the Spark plan has a text or a DataFrame of its
own. Weights, bands and thresholds are fixed values of the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.blocks import BOILERPLATE, code_fingerprint, distinct_blocks, extract_blocks, near_copies
from corpusloom.operators.components import connected_components
from corpusloom.operators.setsim import jaccard_classes, linked_entities
from corpusloom.plans import features, features_sql, pairs, pairs_sql, replies, reports, reports_sql
from corpusloom.runtime import read_table

_TABLES = "code_block code_match customer documents embeddings events file_embedding function_embedding lineitem nation orders region repo_analysis submission supplier".split()

_BLOCKS = "b AS (SELECT block_id, min(repo) AS repo, min(file_path) AS file_path, min(name) AS name, min(normalized) AS n, min(line_count) AS line_count FROM code_block GROUP BY block_id)"
_FUNCS = "f AS (SELECT function_id, min(repo) AS repo, min(name) AS name, min(signature) AS signature, min(docstring) AS doc, max(complexity) AS complexity, max(line_count) AS line_count FROM function_embedding GROUP BY function_id)"
_PAIRS = """m AS (SELECT match_id, min(lower(trim(repo1))) AS r1, min(lower(trim(repo2))) AS r2, min(similarity) AS sim, min(match_type) AS kind FROM code_match GROUP BY match_id),
p AS (SELECT match_id, least(r1, r2) AS repo_a, greatest(r1, r2) AS repo_b, sim, kind FROM m WHERE r1 <> '' AND r2 <> '' AND r1 <> r2)"""
_SCORE = """s AS (SELECT repo_a, repo_b, least(coalesce(sum(sim * CASE kind WHEN 'exact' THEN 1.0 WHEN 'near_exact' THEN 0.9 WHEN 'structural' THEN 0.85 WHEN 'naming_pattern' THEN 0.3 ELSE 0.5 END), 0) / 3, 1) AS raw, count(sim) AS matches FROM p GROUP BY repo_a, repo_b),
v AS (SELECT repo_a, repo_b, matches, round(raw, 6) AS score, CASE WHEN matches = 0 THEN 'clean' WHEN raw >= 0.7 THEN 'HIGH_PLAGIARISM' WHEN raw >= 0.4 THEN 'SUSPICIOUS' WHEN raw >= 0.2 THEN 'NEEDS_REVIEW' ELSE 'likely_clean' END AS verdict FROM s)"""
_SCANS = "a AS (SELECT scan_id, min(repo) AS repo, max(file_count) AS file_count, max(python_files) AS python_files, max(test_files) AS test_files, max(has_docker) AS has_docker, max(has_readme) AS has_readme, max(has_tests) AS has_tests FROM repo_analysis GROUP BY scan_id)"
_FILES = "f AS (SELECT file_id, min(repo) AS repo, min(path) AS path, min(ext) AS ext, min(content) AS content, max(line_count) AS line_count, max(code_line_count) AS code_line_count FROM file_embedding GROUP BY file_id)"

SHARED: dict[str, str] = {
    # Groups of equal blocks.
    "duplicate_block_groups": f"WITH {_BLOCKS} SELECT md5(n) AS fingerprint, count(*) AS blocks, count(DISTINCT repo) AS repos, min(block_id) AS first_block FROM b WHERE n IS NOT NULL GROUP BY md5(n) HAVING count(*) > 1",
    # Weighted match score and verdict of every matched pair.
    "plagiarism_verdicts": f"WITH {_PAIRS}, {_SCORE} SELECT repo_a, repo_b, matches, score, verdict FROM v",
    # Conditional counts per verdict.
    "verdict_summary": f"WITH {_PAIRS}, {_SCORE} SELECT verdict, count(*) AS pairs, CAST(sum(matches) AS BIGINT) AS matches, max(score) AS top_score FROM v GROUP BY verdict",
    # O3: an unordered pair keeps its best row.
    "best_unordered_pair": f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_a, repo_b ORDER BY sim DESC NULLS LAST, match_id) AS nth FROM p) SELECT repo_a, repo_b, match_id, sim, kind FROM r WHERE nth = 1",
    # The first five matches of each pair.
    "top_matches_per_pair": f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_a, repo_b ORDER BY sim DESC NULLS LAST, match_id) AS nth FROM p) SELECT repo_a, repo_b, CAST(nth AS BIGINT) AS position, match_id, kind, sim FROM r WHERE nth <= 5",
    # Union of the two sides, best score per name.
    "max_score_per_name": f"WITH {_PAIRS} SELECT repo, max(sim) AS top_score, count(*) AS matches FROM (SELECT repo_a AS repo, sim FROM p UNION ALL SELECT repo_b, sim FROM p) u GROUP BY repo",
    # Matches grouped by pair.
    "matches_by_kind": f"WITH {_PAIRS} SELECT repo_a, repo_b, count(CASE WHEN kind = 'exact' THEN 1 END) AS exact, count(CASE WHEN kind = 'near_exact' THEN 1 END) AS near_exact, count(CASE WHEN kind = 'structural' THEN 1 END) AS structural, count(*) AS matches FROM p GROUP BY repo_a, repo_b",
    # Pair with its verdict, order of the sides irrelevant, missing verdicts kept.
    "pair_verdict_lookup": f"WITH {_PAIRS}, {_SCORE}, q AS (SELECT DISTINCT repo_a, repo_b FROM p) SELECT q.repo_a, q.repo_b, coalesce(v.verdict, 'unknown') AS verdict FROM q LEFT JOIN v ON q.repo_a = v.repo_a AND q.repo_b = v.repo_b",
    # Functions of one name in matched repositories and whether their bodies agree.
    "common_name_agreement": f"WITH {_PAIRS}, h AS (SELECT repo, name, max(body_hash) AS body FROM function_embedding WHERE name IS NOT NULL GROUP BY repo, name), q AS (SELECT DISTINCT repo_a, repo_b FROM p) SELECT q.repo_a, q.repo_b, count(*) AS common, count(CASE WHEN x.body = y.body THEN 1 END) AS equal_bodies FROM q JOIN h x ON x.repo = q.repo_a JOIN h y ON y.repo = q.repo_b AND y.name = x.name GROUP BY q.repo_a, q.repo_b",
    # Names that only one side of a matched pair has.
    "anti_symmetric_difference": f"WITH {_PAIRS}, n AS (SELECT DISTINCT repo, name FROM function_embedding WHERE name IS NOT NULL), q AS (SELECT DISTINCT repo_a, repo_b FROM p), d AS (SELECT q.repo_a, q.repo_b, 'a' AS side, x.name FROM q JOIN n x ON x.repo = q.repo_a LEFT JOIN n y ON y.repo = q.repo_b AND y.name = x.name WHERE y.name IS NULL UNION ALL SELECT q.repo_a, q.repo_b, 'b', y.name FROM q JOIN n y ON y.repo = q.repo_b LEFT JOIN n x ON x.repo = q.repo_a AND x.name = y.name WHERE x.name IS NULL) SELECT repo_a, repo_b, side, count(*) AS names FROM d GROUP BY repo_a, repo_b, side",
    # Style of each repository.
    "style_metrics": f"WITH {_FILES} SELECT repo, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(code_line_count) AS BIGINT) AS code_lines, round(avg(line_count), 6) AS mean_lines, max(line_count) AS longest, round(CAST(sum(code_line_count) AS DOUBLE) / nullif(sum(line_count), 0), 6) AS code_share FROM f GROUP BY repo",
    # G1: five most frequent extensions of each repository.
    "language_mix_top5": f"WITH {_FILES}, c AS (SELECT repo, ext, count(*) AS files FROM f GROUP BY repo, ext), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, ext) AS nth FROM c) SELECT repo, ext, files, CAST(nth AS BIGINT) AS position FROM r WHERE nth <= 5",
    # Snippets of a repository within a budget of characters, tests last, stop at the first overflow.
    "budgeted_snippets": f"WITH {_FILES}, t AS (SELECT repo, path, file_id, CASE WHEN path LIKE '%test%' THEN 1 ELSE 0 END AS is_test, least(length(content), 800) AS size FROM f WHERE ext = '.py'), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY is_test, path, file_id) AS nth, sum(size) OVER (PARTITION BY repo ORDER BY is_test, path, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM t) SELECT repo, CAST(nth AS BIGINT) AS position, file_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS total FROM r WHERE nth <= 20 AND total <= 12000",
    # Docstrings that several repositories share.
    "shared_docstring_evidence": f"WITH {_FUNCS}, d AS (SELECT trim(doc) AS doc, count(DISTINCT repo) AS repos, count(*) AS uses FROM f WHERE length(trim(doc)) > 20 GROUP BY trim(doc)) SELECT md5(doc) AS evidence, repos, uses, CAST(length(doc) AS BIGINT) AS size, CASE WHEN length(doc) > 50 THEN 'investigate' ELSE 'none' END AS category FROM d WHERE repos > 1",
    # Complexity bands.
    "complexity_by_repo": f"WITH {_FUNCS} SELECT repo, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total, max(complexity) AS most, count(CASE WHEN complexity >= 10 THEN 1 END) AS complex, round(avg(complexity), 6) AS mean FROM f GROUP BY repo",
    # Fixed bands.
    "score_band_histogram": "SELECT CASE WHEN s >= 9.5 THEN '9.5' WHEN s >= 8.5 THEN '8.5' WHEN s >= 7.5 THEN '7.5' WHEN s >= 6.5 THEN '6.5' WHEN s >= 5.5 THEN '5.5' ELSE 'below' END AS band, count(*) AS orders FROM (SELECT least(10, o_totalprice / 20000) AS s FROM orders) q GROUP BY 1",
    # Twenty equal bins, the last one closed.
    "equal_width_histogram": "WITH b AS (SELECT least(19, CAST(floor(20 * (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders))) AS INT)) AS bin FROM orders) SELECT bin, count(*) AS orders FROM b GROUP BY bin",
    # Letters and pass.
    "letter_bands_passfail": "WITH s AS (SELECT c_custkey, greatest(0, least(10, (c_acctbal + 1000) / 1100)) AS score FROM customer) SELECT CASE WHEN score >= 9.5 THEN 'A+' WHEN score >= 9 THEN 'A' WHEN score >= 8.5 THEN 'A-' WHEN score >= 8 THEN 'B+' WHEN score >= 7.5 THEN 'B' WHEN score >= 7 THEN 'B-' WHEN score >= 6.5 THEN 'C+' WHEN score >= 6 THEN 'C' WHEN score >= 5.5 THEN 'C-' WHEN score >= 5 THEN 'D' ELSE 'F' END AS letter, score >= 6 AS passed, count(*) AS entries FROM s GROUP BY 1, 2",
    # Averages of a category, missing values ignored.
    "category_averages": "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus",
    # Weighted mean, weights of missing scores renormalised.
    "weighted_mean_renormalised": "SELECT l_orderkey AS entity, round(sum(CASE WHEN l_discount > 0 THEN l_quantity * l_discount END) / sum(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS score FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_discount > 0 THEN l_discount END) > 0",
    # Cleaned submissions, the latest of each address wins.
    "latest_submissions": "WITH s AS (SELECT DISTINCT submission_id, submitted_at, nullif(lower(trim(email)), '') AS email, nullif(trim(student_name), '') AS name, coalesce(nullif(trim(repo_url), ''), nullif(trim(repo), '')) AS url FROM submission), r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY submitted_at DESC NULLS LAST, submission_id DESC) AS nth FROM s WHERE email IS NOT NULL AND url IS NOT NULL) SELECT submission_id, email, name, url FROM r WHERE nth = 1",
    # Suppliers by nation with severity order.
    "nation_score_ranking": "SELECT n_name AS nation, r_name AS region, count(*) AS suppliers, round(avg(s_acctbal), 6) AS mean_score, CAST(row_number() OVER (PARTITION BY r_name ORDER BY avg(s_acctbal) DESC, n_name) AS BIGINT) AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
}

#: (Spark text, DuckDB text) where the dialects differ.
DIALECTS: dict[str, tuple[str, str]] = {
    # P5: distinct five-token shingles of a block, the whole text's hash where it is shorter.
    "ngram5_sets": (
        f"WITH {_BLOCKS}, t AS (SELECT block_id, n, filter(split(n, '\\\\s+'), x -> x <> '') AS w FROM b WHERE n IS NOT NULL), g AS (SELECT block_id, substr(md5(array_join(slice(w, i, 5), ' ')), 1, 8) AS h FROM (SELECT block_id, w, explode(sequence(1, size(w) - 4)) AS i FROM t WHERE size(w) >= 5) UNION ALL SELECT block_id, md5(array_join(w, ' ')) FROM t WHERE size(w) < 5) SELECT block_id, count(DISTINCT h) AS shingles, min(h) AS least FROM g GROUP BY block_id",
        f"WITH {_BLOCKS}, t AS (SELECT block_id, n, list_filter(regexp_split_to_array(n, '\\s+'), lambda x: x <> '') AS w FROM b WHERE n IS NOT NULL), g AS (SELECT block_id, substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8) AS h FROM (SELECT block_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5) UNION ALL SELECT block_id, md5(array_to_string(w, ' ')) FROM t WHERE len(w) < 5) SELECT block_id, count(DISTINCT h) AS shingles, min(h) AS least FROM g GROUP BY block_id",
    ),
    # Winnowed fingerprints (5 characters, 4 hashes) of signatures.
    "winnow_fingerprints": (
        f"WITH {_FUNCS}, s AS (SELECT function_id, regexp_replace(lower(signature), '\\\\s', '') AS t FROM f WHERE signature IS NOT NULL), k AS (SELECT function_id, i, substr(md5(substr(t, i, 5)), 1, 8) AS h FROM (SELECT function_id, t, explode(sequence(1, length(t) - 4)) AS i FROM s WHERE length(t) >= 8)), w AS (SELECT function_id, min(h) OVER (PARTITION BY function_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m, count(*) OVER (PARTITION BY function_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c FROM k) SELECT function_id, count(DISTINCT m) AS fingerprints, min(m) AS least FROM w WHERE c = 4 GROUP BY function_id",
        f"WITH {_FUNCS}, s AS (SELECT function_id, regexp_replace(lower(signature), '\\s', '', 'g') AS t FROM f WHERE signature IS NOT NULL), k AS (SELECT function_id, i, substr(md5(substr(t, i, 5)), 1, 8) AS h FROM (SELECT function_id, t, unnest(range(1, length(t) - 3)) AS i FROM s WHERE length(t) >= 8)), w AS (SELECT function_id, min(h) OVER (PARTITION BY function_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m, count(*) OVER (PARTITION BY function_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c FROM k) SELECT function_id, count(DISTINCT m) AS fingerprints, min(m) AS least FROM w WHERE c = 4 GROUP BY function_id",
    ),
    # Mean vector of every label.
    "mean_pool_by_label": (
        "SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, posexplode(embedding) AS (pos, x) FROM embeddings) GROUP BY label, pos",
        "SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos",
    ),
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs a text whose tables are handed over as frames, so no view of the session is touched."""
    named = re.compile(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b")
    wanted = sorted({m.group(2) for m in named.finditer(text)})
    asked = named.sub(r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(asked, **{t: read_table(spark, sf_dir, t) for t in wanted})

    return query


def dependency_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every repository its class of equal dependency sets and how many others are alike by half or more."""
    table = read_table(spark, sf_dir, "repo_analysis").select("repo", F.explode("dependencies").alias("d"))
    return linked_entities(*jaccard_classes(table, "repo", "d", 0.5)).select(F.col("e").alias("repo"), F.col("c").alias("cls"), "links")


def pooled_label_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine between the mean vectors of two labels."""
    long = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = long.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    a, b = long.toDF("a", "pos", "ma"), long.toDF("b", "pos", "mb")
    dots = a.join(b, "pos").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("dot"))
    out = dots.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b")
    return out.select(F.col("a").alias("label_a"), F.col("b").alias("label_b"), F.round(F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.col("dot") / (F.col("na") * F.col("nb"))), 6).alias("cosine"))


def match_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of repositories matched with a similarity of 0.45 or more, largest first by size."""
    table = read_table(spark, sf_dir, "code_match").where("similarity >= 0.45").select(F.lower(F.trim("repo1")).alias("a"), F.lower(F.trim("repo2")).alias("b")).where("a <> '' and b <> '' and a <> b")
    groups = connected_components(table, "a", "b", "repo", "cluster")
    return groups.groupBy("cluster").agg(F.count("*").alias("members"), F.max("repo").alias("last_member"))


def intra_cluster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of the matches inside each group."""
    table = read_table(spark, sf_dir, "code_match").where("match_id is not null").dropDuplicates(["match_id"]).where("similarity >= 0.45").select(F.lower(F.trim("repo1")).alias("a"), F.lower(F.trim("repo2")).alias("b"), "similarity").where("a <> '' and b <> '' and a <> b")
    groups = connected_components(table, "a", "b", "repo", "cluster")
    return table.join(groups, table["a"] == groups["repo"]).groupBy("cluster").agg(F.count("*").alias("matches"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def block_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text and fingerprint computed anew from every block's code."""
    table = read_table(spark, sf_dir, "code_block").where("block_id is not null").dropDuplicates(["block_id"])
    return table.select("block_id", code_fingerprint("code").alias("fingerprint"))


def ast_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every Python file with complexity, calls and shape."""
    files = read_table(spark, sf_dir, "file_embedding")
    return extract_blocks(files, "file_id", "path", "content").dropDuplicates(["file_id", "name", "start_line"])


def near_copy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of blocks in two repositories that are nearly equal, or equal but for names."""
    return near_copies(read_table(spark, sf_dir, "code_block"), "block_id", "repo", "code")


def near_copy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that stands for each block's text in ``near_copy_blocks``, and the blocks it stands for."""
    rows = distinct_blocks(read_table(spark, sf_dir, "code_block"), "block_id", "repo", "code")
    return rows.select(F.col("id").alias("block_id"), F.col("t").alias("text_id"))


_CLUSTER_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT lower(trim(repo1)) a, lower(trim(repo2)) b FROM code_match WHERE similarity >= 0.45 AND lower(trim(repo1)) <> '' AND lower(trim(repo2)) <> '' AND lower(trim(repo1)) <> lower(trim(repo2))),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), c AS (SELECT x AS repo, min(y) AS cluster FROM r GROUP BY x)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _sql(text) for name, text in SHARED.items()},
    **{name: _sql(spark_text) for name, (spark_text, _) in DIALECTS.items()},
    "dependency_jaccard": dependency_jaccard,
    "pooled_label_cosine": pooled_label_cosine,
    "match_clusters": match_clusters,
    "intra_cluster_mean": intra_cluster_mean,
    "block_fingerprints": block_fingerprints,
    "ast_blocks": ast_blocks,
    "near_copy_blocks": near_copy_blocks,
    "near_copy_members": near_copy_members,
    **features.QUERIES,
    **pairs.QUERIES,
    **replies.QUERIES,
    **reports.QUERIES,
}
ORACLE: dict[str, str] = {
    **SHARED,
    **{name: duck for name, (_, duck) in DIALECTS.items()},
    "dependency_jaccard": "WITH x AS (SELECT DISTINCT repo, d FROM (SELECT repo, unnest(dependencies) AS d FROM repo_analysis) WHERE d IS NOT NULL AND repo IS NOT NULL), n AS (SELECT repo, count(*) AS n, string_agg(d, '|' ORDER BY d) AS k FROM x GROUP BY repo), c AS (SELECT a.repo AS ra, b.repo AS rb, count(*) AS s FROM x a JOIN x b ON a.d = b.d AND a.repo <> b.repo GROUP BY 1, 2), l AS (SELECT ra, count(*) AS links FROM c JOIN n p ON p.repo = ra JOIN n q ON q.repo = rb WHERE s / (p.n + q.n - s) >= 0.5 GROUP BY ra) SELECT n.repo, min(n.repo) OVER (PARTITION BY k) AS cls, coalesce(links, 0) AS links FROM n LEFT JOIN l ON l.ra = n.repo",
    "pooled_label_cosine": "WITH l AS (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM l GROUP BY label) SELECT a.label AS label_a, b.label AS label_b, round(sum(a.m * b.m) / (max(x.n) * max(y.n)), 6) AS cosine FROM l a JOIN l b ON a.pos = b.pos AND a.label < b.label JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2",
    "match_clusters": _CLUSTER_SQL + "SELECT cluster, count(*) AS members, max(repo) AS last_member FROM c GROUP BY cluster",
    "intra_cluster_mean": _CLUSTER_SQL + ", t AS (SELECT match_id, min(lower(trim(repo1))) AS a, min(lower(trim(repo2))) AS b, min(similarity) AS s FROM code_match GROUP BY match_id) SELECT cluster, count(*) AS matches, round(avg(s), 6) AS mean_similarity FROM t JOIN c ON t.a = c.repo WHERE s >= 0.45 AND a <> '' AND b <> '' AND a <> b GROUP BY cluster",
    # The normalisation once more, with patterns for RE2.
    "block_fingerprints": "SELECT block_id, md5(" + features_sql._NORMAL.replace("content", "c") + ") AS fingerprint FROM (SELECT block_id, min(code) AS c FROM code_block WHERE block_id IS NOT NULL GROUP BY block_id)",
    "near_copy_members": "WITH b AS (SELECT block_id, " + features_sql._NORMAL.replace("content", "c") + " AS n, c FROM (SELECT block_id, min(code) AS c FROM code_block WHERE block_id IS NOT NULL GROUP BY block_id) WHERE c IS NOT NULL) SELECT block_id, min(block_id) OVER (PARTITION BY n) AS text_id FROM b WHERE n <> '' AND NOT regexp_matches(c, '" + BOILERPLATE.replace("'", "''") + "')",
    **features_sql.ORACLE,
    **pairs_sql.ORACLE,
    **replies.ORACLE,
    **reports_sql.ORACLE,
}
