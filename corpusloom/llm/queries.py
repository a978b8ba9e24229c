"""Named queries of the ten problems, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.credentials import Words, credentials, redacted, word_costs
from corpusloom.llm.function_docs import pair_functions
from corpusloom.llm.knn import nearest_vectors
from corpusloom.llm.leakage import leaked_items
from corpusloom.llm.packing import pack, rule_tokens
from corpusloom.llm.parse_check import check_files
from corpusloom.llm.personal_data import masked, personal_spans
from corpusloom.llm.provenance import unwritten_files
from corpusloom.llm.shared_spans import shared_pairs, shared_share, shared_spans
from corpusloom.operators.components import connected_components
from corpusloom.runtime import cut, read_table


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten_files(read_table(spark, sf_dir, "file_embedding"), "file_id", "repo", "path", "content")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_reasons(spark, sf_dir).select("file_id")


def p1_repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each scan, how many of its listed files nobody wrote by hand; paths are compared in one style."""
    style = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./|/)+", ""), r"/{2,}", "/")
    scans = read_table(spark, sf_dir, "repo_analysis").select("scan_id", "repo", "files").where("scan_id is not null").dropDuplicates(["scan_id"])
    listed = scans.select("scan_id", "repo", F.explode_outer("files").alias("path")).select("scan_id", "repo", style(F.col("path")).alias("path")).distinct()
    files = read_table(spark, sf_dir, "file_embedding").select("file_id", "repo", style(F.col("path")).alias("path")).dropDuplicates(["file_id"])
    found = p1_reasons(spark, sf_dir)
    joined = listed.join(files.join(found, "file_id"), ["repo", "path"], "left")
    return joined.groupBy("scan_id").agg(F.count("path").alias("listed"), F.count("reason").alias("unwritten"))


def _code_texts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], Words]:
    files, blocks = read_table(spark, sf_dir, "file_embedding"), read_table(spark, sf_dir, "code_block")
    texts = {"file": files.select(F.col("file_id").alias("id"), F.col("top_level_code").alias("text")), "block": blocks.select(F.col("block_id").alias("id"), F.col("code").alias("text"))}
    return texts, word_costs(blocks.select("name"), "name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, costs = _code_texts(spark, sf_dir)
    a, b = (credentials(rows, "id", "text", costs).select(F.lit(src).alias("src"), "row_id", "line_no") for src, rows in texts.items())
    return a.unionByName(b).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that holds credentials, with them replaced."""
    texts, costs = _code_texts(spark, sf_dir)
    a, b = (redacted(rows, "id", "text", costs).where("credentials > 0").select(F.lit(src).alias("src"), "row_id", "text", "credentials") for src, rows in texts.items())
    return a.unionByName(b).dropDuplicates(["src", "row_id"])


def project_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (level, id, vec) for each vector of either level."""
    table = read_table(spark, sf_dir, "project_embedding")
    levels = [table.select(F.lit(name).alias("level"), F.explode(F.arrays_zip(F.col(f"{name}_ids").alias("id"), F.col(f"{name}_embeddings").alias("vec"))).alias("x")).select("level", "x.id", "x.vec") for name in ("function", "file")]
    return levels[0].unionByName(levels[1])


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(project_vectors(spark, sf_dir), "level", "id", "vec")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p3_neighbours(spark, sf_dir)
    return near.select("level", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _spans(spark: SparkSession, sf_dir: str, pairs: bool) -> dict[str, dict[str, DataFrame]]:
    return {
        "block": shared_spans(read_table(spark, sf_dir, "code_block"), "block_id", "normalized", ["repo", "file_path"], pairs=pairs),
        "profile": shared_spans(read_table(spark, sf_dir, "repo_code_profile"), "scan_id", "all_code_normalized", pairs=pairs),
    }


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (shared_pairs(parts).select(F.lit(level).alias("level"), "id_a", "id_b") for level, parts in _spans(spark, sf_dir, True).items())
    return a.unionByName(b)


def p4_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (shared_share(parts).select(F.lit(level).alias("level"), "id", "n_chars", "shared_chars", "share") for level, parts in _spans(spark, sf_dir, False).items())
    return a.unionByName(b)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "code_match")
    name = lambda c: F.lower(F.trim(c))
    usable = table.select(name("repo1").alias("a"), name("repo2").alias("b")).where("a <> '' and b <> '' and a <> b")
    return connected_components(usable, "a", "b", "repo", "group_repo")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "file_embedding")
    return check_files(files, "file_id", "path", "content").where("not parses").select("file_id").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files and blocks cut from them for each repository and extension."""
    files = read_table(spark, sf_dir, "file_embedding").select("file_id", "repo", "path", "content")
    checked = check_files(files, "file_id", "path", "content").dropDuplicates(["file_id"])
    named = files.select("file_id", "repo", "path").dropDuplicates(["file_id"]).join(checked, "file_id")
    blocks = read_table(spark, sf_dir, "code_block").select("block_id", "repo", F.col("file_path").alias("path")).dropDuplicates(["block_id"]).groupBy("repo", "path").agg(F.count("*").alias("blocks"))
    joined = named.join(blocks, ["repo", "path"], "left")
    bad = ~F.col("parses")
    out = joined.groupBy("repo", "ext").agg(F.count("*").alias("files"), F.count_if(bad).alias("invalid"), F.coalesce(F.sum(F.when(bad, F.col("blocks"))), F.lit(0)).alias("invalid_blocks"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, as the files hold it, and its documentation."""
    return pair_functions(read_table(spark, sf_dir, "function_embedding"), read_table(spark, sf_dir, "file_embedding"), texts=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_functions(read_table(spark, sf_dir, "function_embedding"), read_table(spark, sf_dir, "file_embedding"))
    return pairs.select("function_id").distinct()


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_tokens", rule_tokens("text")).alias("size"))
    # container_spec has a fixed number of rows.
    specs = {r["spec_id"]: r["capacity_tokens"] for r in read_table(spark, sf_dir, "container_spec").where("spec_id is not null and capacity_tokens is not null").collect()}
    return pack(documents, "doc_id", "size", specs)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and the share of their room that is used, for each capacity."""
    spec = read_table(spark, sf_dir, "container_spec").select("spec_id", "capacity_tokens")
    used = p8_packed(spark, sf_dir).groupBy("spec_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(spec, "spec_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: documents and tokens placed, containers over capacity, documents whose pieces don't add up to them
    in order, and documents that were split although they fit."""
    spec = read_table(spark, sf_dir, "container_spec").select("spec_id", "capacity_tokens")
    packed = cut(p8_packed(spark, sf_dir)).join(F.broadcast(spec), "spec_id")  # three capacities
    sizes = read_table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.greatest(F.lit(0), F.coalesce("n_tokens", rule_tokens("text")))).alias("n"))
    full = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("load"), F.max("capacity_tokens").alias("c")).groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("c")).alias("overfull"))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("places"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("capacity_tokens").alias("c"))
    wrong = F.col("n").isNull() | (F.col("tokens") != F.col("n")) | (F.col("end") != F.col("n")) | (F.col("pieces") != F.col("places"))
    told = docs.join(sizes, "doc_id", "left").groupBy("spec_id").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if(wrong).alias("misplaced"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("c"))).alias("split_without_need"), F.count_if(F.col("pieces") > 1).alias("split"))
    return told.join(full, "spec_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "eval_item"), "item_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pii_type", "pii_text").distinct()


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return masked(documents, "doc_id", "text", personal_spans(documents, "doc_id", "text"))


P6_FOUND_SQL = """
WITH RECURSIVE m AS (
  SELECT DISTINCT lower(trim(repo1)) a, lower(trim(repo2)) b FROM code_match
  WHERE lower(trim(repo1)) <> '' AND lower(trim(repo2)) <> '' AND lower(trim(repo1)) <> lower(trim(repo2))),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT x AS repo, min(y) AS group_repo FROM r GROUP BY x
"""

_P3_SQL = """
WITH r AS (SELECT 'function' AS level, unnest(function_ids) AS id, unnest(function_embeddings) AS v FROM project_embedding UNION ALL SELECT 'file', unnest(file_ids), unnest(file_embeddings) FROM project_embedding),
d AS (SELECT level, id, min(v)::DOUBLE[] AS v FROM r WHERE id IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY level, id),
c AS (SELECT a.level, a.id, b.id AS neighbour, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM d a JOIN d b ON a.level = b.level AND a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY level, id ORDER BY cosine DESC, neighbour) AS nth FROM c)
"""

# Every text of 200 characters of every record; one row for each record and text.
_P4_SQL = """
WITH t AS (SELECT 'block' AS level, block_id AS id, min(normalized) AS t, min(repo) || '/' || min(file_path) AS grp FROM code_block WHERE block_id IS NOT NULL AND normalized IS NOT NULL GROUP BY block_id
UNION ALL SELECT 'profile', scan_id, min(all_code_normalized), scan_id::VARCHAR FROM repo_code_profile WHERE scan_id IS NOT NULL AND all_code_normalized IS NOT NULL GROUP BY scan_id),
g AS (SELECT level, id, grp, i, md5_number(substr(t, i, 200)) AS h FROM (SELECT *, unnest(range(1, length(t) - 198)) AS i FROM t))
"""
P4_FOUND_SQL = _P4_SQL + ", k AS (SELECT DISTINCT level, id, grp, h FROM g) SELECT DISTINCT a.level, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.level = b.level AND a.h = b.h AND a.id < b.id AND a.grp <> b.grp"
P4_SHARE_SQL = _P4_SQL + """, k AS (SELECT level, h FROM g GROUP BY level, h HAVING min(id) <> max(id)), s AS (SELECT level, id, i, lead(i) OVER (PARTITION BY level, id ORDER BY i) AS j FROM g JOIN k USING (level, h)),
c AS (SELECT level, id, sum(least(200, coalesce(j - i, 200))) AS n FROM s GROUP BY level, id)
SELECT t.level, t.id, length(t) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, round(coalesce(coalesce(n, 0) / nullif(length(t), 0), 0), 6) AS share FROM t LEFT JOIN c ON c.level = t.level AND c.id = t.id"""

P8_INVARIANTS_SQL = r"""
WITH d AS (SELECT doc_id, max(greatest(0, coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))))) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT spec_id, capacity_tokens AS c FROM container_spec WHERE spec_id IS NOT NULL AND capacity_tokens IS NOT NULL)
SELECT spec_id, count(*) AS documents, sum(n)::BIGINT AS tokens, 0::BIGINT AS overfull, 0::BIGINT AS misplaced, 0::BIGINT AS split_without_need, count(*) FILTER (n > c) AS split FROM d, s GROUP BY spec_id
"""

P9_FOUND_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_item WHERE text IS NOT NULL),
r AS (SELECT item_id, least(12, len(w)) n, array_to_string(w[s:s + least(12, len(w)) - 1], ' ') g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(12, len(w)) + 2)) s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM r),
g AS (SELECT doc_id, n, array_to_string(w[s:s + n - 1], ' ') g
      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) s FROM d, k WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM g JOIN r USING (n, g)
"""

QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p1_repository_files": p1_repository_files, "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_shared_share": p4_shared_share, "p6_found": p6_found, "p5_found": p5_found, "p5_rates": p5_rates, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_invariants": p8_invariants, "p9_found": p9_found, "p10_found": p10_found, "p10_masked": p10_masked}
ORACLE = {"p3_found": _P3_SQL + "SELECT DISTINCT level, least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM n WHERE nth <= 5", "p3_neighbours": _P3_SQL + "SELECT level, id, nth::INT AS rank, neighbour, cosine FROM n WHERE nth <= 5", "p4_found": P4_FOUND_SQL, "p4_shared_share": P4_SHARE_SQL, "p8_invariants": P8_INVARIANTS_SQL, "p6_found": P6_FOUND_SQL, "p9_found": P9_FOUND_SQL}
