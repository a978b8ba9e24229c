"""The report queries in DuckDB's SQL, written apart from the Spark plans; only lists of fixed values are shared."""

from __future__ import annotations

from corpusloom.plans import features as f
from corpusloom.plans import reports
from corpusloom.plans.features_sql import FILES, ORACLE as FEATURES, _in, _re, listed
from corpusloom.plans.pairs_sql import ORACLE as PAIRS_ORACLE, PAIRS, overlap
from corpusloom.plans.replies import ORACLE as REPLIES

_EXACT = f"""bl AS (SELECT block_id, min(repo) AS repo, min(normalized) AS n, coalesce(min(code), '') AS code FROM code_block WHERE block_id IS NOT NULL GROUP BY block_id),
fp AS (SELECT repo, md5(n) AS fp, max(block_id) AS block FROM bl WHERE n IS NOT NULL AND NOT regexp_matches(code, '{_re(f.BOILERPLATE)}') GROUP BY repo, md5(n)),
ex AS (SELECT p.repo_a, p.repo_b, x.fp, x.block AS block_a, y.block AS block_b FROM p JOIN fp x ON x.repo = p.repo_a JOIN fp y ON y.repo = p.repo_b AND y.fp = x.fp)"""
_NAMING = PAIRS_ORACLE["pair_naming"]
_MATCHES = f"WITH {FILES}, {PAIRS}, {_EXACT}, {overlap('gram5')}, nm AS ({_NAMING}), em AS (SELECT repo_a, repo_b, 'exact' AS kind, 1.0::DOUBLE AS similarity FROM ex UNION ALL SELECT repo_a, repo_b, 'naming_pattern', similarity FROM nm UNION ALL SELECT repo_a, repo_b, 'fingerprint_overlap', round(j, 6) FROM o_gram5 WHERE j > 0.3)"
_SCORES = _MATCHES + ", sc AS (SELECT p.repo_a, p.repo_b, count(kind) AS matches, least(1, coalesce(sum(similarity * CASE kind WHEN 'exact' THEN 1 WHEN 'naming_pattern' THEN 0.3 WHEN 'fingerprint_overlap' THEN 0.5 END), 0) / 3) AS raw FROM p LEFT JOIN em USING (repo_a, repo_b) GROUP BY ALL), ms AS (SELECT repo_a, repo_b, matches, round(raw, 6) AS score, CASE WHEN matches = 0 THEN 'clean' WHEN raw >= 0.7 THEN 'HIGH_PLAGIARISM' WHEN raw >= 0.4 THEN 'SUSPICIOUS' WHEN raw >= 0.2 THEN 'NEEDS_REVIEW' ELSE 'likely_clean' END AS verdict FROM sc)"
_V2 = f"v2 AS ({PAIRS_ORACLE['pair_combined_v2']})"
_BOTH = "bo AS (SELECT repo_a AS repo, repo_b AS match, combined FROM v2 UNION ALL SELECT repo_b, repo_a, combined FROM v2)"
_SUB = """sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY submitted_at DESC NULLS LAST, submission_id DESC) AS n FROM (SELECT DISTINCT submission_id, submitted_at, lower(nullif(trim(email), '')) AS email, nullif(trim(student_name), '') AS student_name, coalesce(nullif(trim(repo_url), ''), nullif(trim(repo), '')) AS repo_url, nullif(trim(repo), '') AS repo FROM submission WHERE submission_id IS NOT NULL) WHERE email IS NOT NULL AND repo_url IS NOT NULL) WHERE n = 1),
sl AS (SELECT *, coalesce(nullif(left(concat_ws('_', nullif(trim(regexp_replace(lower(trim(coalesce(student_name, repo_url))), '[^a-z0-9]+', '_', 'g'), '_'), ''), nullif(replace(regexp_extract(regexp_replace(repo_url, '/+$', ''), '([^/]*)$', 1), '.git', ''), '')), 64), ''), 'submission') AS slug FROM sb)"""
_MM = "CASE WHEN coalesce({v}, 0) <= 1 THEN 0 WHEN lo = hi THEN 99 ELSE greatest(87, least(99, round(87 + 12 * ({v} - lo) / (hi - lo), 2))) END"
_WALK = {
    "features": f"len(list_filter(string_split(path, '/'), lambda x: x IN {_in(reports.SKIPPED['second'])})) = 0",
    "blocks": f"len(list_filter(string_split(path, '/'), lambda x: x IN {_in(reports.SKIPPED['blocks'])})) = 0 AND NOT contains(lower(path), 'test')",
    "embeddings": f"len(list_filter(string_split(path, '/'), lambda x: x IN {_in(reports.SKIPPED['second'])})) = 0 AND NOT contains(lower(regexp_extract(path, '[^/]*$')), 'test')",
    "evidence": "NOT regexp_matches(path, '(^|/)\\.')", "points": "TRUE",
    "first": f"len(list_filter(string_split(path, '/'), lambda x: x IN {_in(reports.SKIPPED['first'])})) = 0 AND NOT regexp_matches(path, '(^|/)\\.')",
}
_POINT = ", ".join(f"greatest({reports.FLOORS[k]}, least(10, 2 * (" + " + ".join(f"bool_or(regexp_matches(content, '{_re(p)}'))::INT" for p in ps) + f"))) AS {k}" for k, ps in reports.POINTS.items())
_CLUSTER = """cm AS (SELECT lower(trim(repo1)) AS a, lower(trim(repo2)) AS b, similarity FROM code_match), cu AS (SELECT * FROM cm WHERE a <> '' AND b <> '' AND a <> b), ce AS (SELECT a, b FROM cu WHERE similarity >= 0.45 UNION SELECT b, a FROM cu WHERE similarity >= 0.45),
cr(x, y) AS (SELECT a, a FROM (SELECT a FROM cu UNION SELECT b FROM cu) UNION SELECT cr.x, ce.b FROM cr JOIN ce ON ce.a = cr.y), cc AS (SELECT x AS repo, min(y) AS cluster FROM cr GROUP BY x)"""
_STATUS = f"st AS ({REPLIES['reply_status']})"
_DEEP = f"dp AS ({PAIRS_ORACLE['pair_deep']})"

ORACLE: dict[str, str] = {
    "exact_matches": f"WITH {PAIRS}, {_EXACT} SELECT * FROM ex",
    "every_match": f"{_MATCHES} SELECT * FROM em",
    "match_scores": f"{_SCORES} SELECT * FROM ms",
    "score_table": f"{_SCORES} SELECT row_number() OVER (ORDER BY CASE verdict WHEN 'HIGH_PLAGIARISM' THEN 0 WHEN 'SUSPICIOUS' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 3 END, score DESC, repo_a, repo_b) AS position, repo_a, repo_b, round(score, 4) AS score, verdict FROM ms",
    "match_report": "WITH m AS (SELECT match_id, lower(trim(min(repo1))) AS x, lower(trim(min(repo2))) AS y, min(similarity) AS similarity, min(match_type) AS match_type, left(coalesce(min(code1_preview), ''), 300) AS preview1, left(coalesce(min(code2_preview), ''), 300) AS preview2 FROM code_match WHERE match_id IS NOT NULL GROUP BY match_id), n AS (SELECT least(x, y) AS repo_a, greatest(x, y) AS repo_b, row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY similarity DESC NULLS LAST, match_id) AS nth, match_id, match_type, similarity, preview1, preview2 FROM m WHERE x <> '' AND y <> '' AND x <> y) SELECT * FROM n WHERE nth <= 5",
    "deep_ranking": f"WITH {_DEEP} SELECT row_number() OVER (ORDER BY combined DESC, repo_a, repo_b) AS position, repo_a, repo_b, combined, fingerprint FROM dp",
    "extreme_pairs": f"WITH {_DEEP}, r AS (SELECT row_number() OVER (ORDER BY combined DESC, repo_a, repo_b) AS position, count(*) OVER () AS n, repo_a, repo_b FROM dp) SELECT 'head' AS part, position, repo_a, repo_b FROM r WHERE position <= 10 UNION ALL SELECT 'tail', position, repo_a, repo_b FROM r WHERE position > n - 5",
    "nearest_repositories": f"WITH {_V2}, {_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY combined DESC, match) AS position FROM bo) SELECT repo, position, match, round(combined, 4) AS combined FROM r WHERE position <= 3",
    "similarity_cells": f"WITH {_V2}, {_BOTH} SELECT repo AS name, match AS other, round(combined, 3) AS value FROM bo UNION ALL SELECT DISTINCT repo, repo, 1.0 FROM bo",
    "framework_groups": "WITH t AS (SELECT DISTINCT repo, unnest(frameworks) AS framework FROM repo_analysis WHERE repo IS NOT NULL) SELECT framework, repo, count(*) OVER (PARTITION BY framework) AS repos, round(count(*) OVER (PARTITION BY framework) * 100 / (SELECT count(DISTINCT repo) FROM repo_analysis), 4) AS percent FROM t WHERE framework IS NOT NULL",
    "cluster_members": f"WITH RECURSIVE {_CLUSTER} SELECT cluster, count(*) OVER (PARTITION BY cluster) AS size, repo FROM cc",
    "risk_cards": _SCORES.replace("WITH ", f"WITH ri AS ({PAIRS_ORACLE['pair_risk']}), ", 1) + " SELECT risk, verdict, count(*) AS pairs FROM ri LEFT JOIN ms USING (repo_a, repo_b) GROUP BY risk, verdict",
    "submission_slugs": f"WITH {_SUB} SELECT submission_id, slug, 'grade --name ''' || coalesce(student_name, '') || ''' --repo ' || repo_url || ' --slug ' || slug AS command FROM sl",
    "ranked_submissions": f"WITH {_SUB}, {_STATUS}, ch AS ({FEATURES['file_checklist']}), j AS (SELECT sl.submission_id, student_name, email, repo_url, slug, st.score, percent, status, ch.score AS files, missing FROM sl LEFT JOIN st ON st.event_id = sl.submission_id LEFT JOIN ch ON ch.repo = sl.repo), b AS (SELECT min(score) AS lo, max(score) AS hi FROM j WHERE score > 1), n AS (SELECT j.*, ({_MM.format(v='score')})::DOUBLE AS normalized FROM j, b) SELECT row_number() OVER (ORDER BY normalized DESC, student_name NULLS FIRST, submission_id) AS position, * FROM n",
    "minmax_normalize_rank": f"WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_acctbal > 1), n AS (SELECT c_custkey, c_name, ({_MM.format(v='c_acctbal')})::DOUBLE AS normalized FROM customer, b) SELECT *, row_number() OVER (ORDER BY normalized DESC, c_name, c_custkey) AS position FROM n",
    "first_submissions": f"WITH {_SUB} SELECT submission_id, email FROM sb ORDER BY submission_id LIMIT 5",
    "summary_report": f"WITH {_STATUS} SELECT 'scores' AS section, unnest(['count', 'least', 'most', 'mean']) AS key, unnest([count(*)::DOUBLE, min(score), max(score), round(avg(score), 6)]) AS value FROM st UNION ALL SELECT 'status', status, count(*) FROM st GROUP BY status UNION ALL SELECT 'band', CASE WHEN score >= 9.5 THEN '9.5' WHEN score >= 8.5 THEN '8.5' WHEN score >= 7.5 THEN '7.5' WHEN score >= 6.5 THEN '6.5' WHEN score >= 5.5 THEN '5.5' ELSE 'below' END, count(*) FROM st GROUP BY 2",
    "path_tree": f"WITH {FILES}, d AS (SELECT repo, string_split(path, '/') AS w FROM f) SELECT DISTINCT repo, array_to_string(w[1:i], '/') AS entry, i AS depth FROM (SELECT repo, w, unnest(range(1, least(4, len(w)) + 1)) AS i FROM d)",
    "walk_families": f"WITH {FILES} SELECT repo, " + ", ".join(f'count(*) FILTER ({rule}) AS "{n}"' for n, rule in _WALK.items()) + " FROM s GROUP BY repo",
    "pattern_hits": "WITH b AS (SELECT block_id, lower(coalesce(min(code), '')) AS c FROM code_block WHERE block_id IS NOT NULL GROUP BY block_id), p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in f.EXPECTED) + "]) AS pattern) SELECT pattern, count(*) AS blocks FROM b JOIN p ON contains(c, pattern) GROUP BY pattern",
    "standard_imports": f"SELECT module, count(DISTINCT repo) AS repos FROM (SELECT repo, string_split(i, '.')[1] AS module FROM {listed('imports', 'i')}) WHERE module IN {_in(f.STANDARD_MODULES)} GROUP BY module",
    "exclusive_paths": f"WITH {FILES}, {PAIRS}, {overlap('file400')} SELECT repo_a, repo_b, shared AS common, whole AS either, whole - shared AS one FROM o_file400",
    "feature_points": f"WITH {FILES}, g AS (SELECT repo, {_POINT} FROM s GROUP BY repo), t AS (SELECT *, feature + quality + technical + extra + 5 AS total FROM g) SELECT *, CASE WHEN total >= 40 THEN 'A' WHEN total >= 32 THEN 'B' WHEN total >= 24 THEN 'C' WHEN total >= 16 THEN 'D' ELSE 'F' END AS grade FROM t",
    "table_columns": "SELECT table_name AS name, ordinal_position::INT AS position, column_name FROM information_schema.columns WHERE table_name IN ('code_block', 'code_match', 'documents', 'file_embedding', 'function_embedding', 'project_embedding', 'repo_analysis', 'repo_code_profile', 'submission')",
}
