"""The pair metrics in DuckDB's SQL, written apart from the Spark plans; only lists of fixed values are shared."""

from __future__ import annotations

from corpusloom.plans import features as f
from corpusloom.plans.features_sql import CRUD, FILES, FLAGS, GRAMS, ORACLE as FEATURES, _ENDPOINTS, _NORMAL, _in, _one_of, _re, listed

PAIRS = "p AS (SELECT DISTINCT least(x, y) AS repo_a, greatest(x, y) AS repo_b FROM (SELECT lower(trim(repo1)) AS x, lower(trim(repo2)) AS y FROM code_match) WHERE x <> '' AND y <> '' AND x <> y)"
_MESSAGE = "unnest(regexp_extract_all(content, '(?i)(?:detail|message|msg)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1))"
_VALUES = {
    "dependency": "SELECT repo, unnest(dependencies) AS v FROM repo_analysis",
    "framework": "SELECT repo, unnest(frameworks) AS v FROM repo_analysis",
    "class": f"SELECT repo, v FROM {listed('classes', 'v')}",
    "function": f"SELECT repo, v FROM (SELECT repo, v, row_number() OVER (PARTITION BY repo ORDER BY path, file_id, pos) AS n FROM {listed('functions', 'v')}) WHERE n <= 50",
    "import": f"SELECT repo, string_split(v, '.')[1] AS v FROM {listed('imports', 'v')}",
    "file": "SELECT repo, path AS v FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path, file_id) AS n FROM f) WHERE n <= 100",
    "file400": "SELECT repo, path AS v FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path, file_id) AS n FROM f) WHERE n <= 400",
    "endpoint": f"SELECT repo, upper(verb) || ' ' || path AS v FROM {_ENDPOINTS}",
    "response": "SELECT repo, unnest(regexp_extract_all(content, 'response_model\\s*=\\s*(\\w+)', 1)) AS v FROM s",
    "status": "SELECT repo, unnest(regexp_extract_all(content, 'HTTPException\\s*\\(\\s*status_code\\s*=\\s*(\\d+)', 1)) AS v FROM s",
    "signature": "SELECT repo, signature AS v FROM function_embedding",
    "variable": "SELECT repo, v FROM (SELECT repo, v, row_number() OVER (PARTITION BY repo ORDER BY v) AS n FROM (SELECT DISTINCT repo, unnest(regexp_extract_all(content, '(?m)^[ \\t]*([A-Za-z_]\\w*)[ \\t]*=[^=]', 1)) AS v FROM s)) WHERE n <= 50",
    "message": f"SELECT repo, {_MESSAGE} AS v FROM s",
    "gram7": "SELECT repo, h AS v FROM g7",
    "gram5": "SELECT repo, CASE WHEN len(w) < 5 THEN md5(array_to_string(w, ' ')) ELSE substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8) END AS v FROM (SELECT repo, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM (SELECT repo, list_filter(regexp_split_to_array(" + _NORMAL + ", '\\s+'), lambda x: x <> '') AS w FROM s))",
    "name": "SELECT repo, name AS v FROM function_embedding",
    "print": "SELECT repo, m AS v FROM wp",
}
_PRINTS = """wt AS (SELECT function_id, min(repo) AS repo, regexp_replace(lower(min(signature)), '\\s', '', 'g') AS t FROM function_embedding WHERE function_id IS NOT NULL GROUP BY function_id),
wk AS (SELECT repo, function_id, i, substr(md5(substr(t, i, 5)), 1, 8) AS h FROM (SELECT repo, function_id, t, unnest(range(1, length(t) - 3)) AS i FROM wt WHERE length(t) >= 8)),
wp AS (SELECT repo, least(h, h1, h2, h3) AS m FROM (SELECT repo, h, lead(h, 1) OVER o AS h1, lead(h, 2) OVER o AS h2, lead(h, 3) OVER o AS h3 FROM wk WINDOW o AS (PARTITION BY function_id ORDER BY i)) WHERE h3 IS NOT NULL)"""


def overlap(kind: str, where: str = "TRUE") -> str:
    """CTEs ``v_<kind>`` (values), ``n_<kind>`` (sizes) and ``o_<kind>`` (shared values, union, Jaccard) of each pair."""
    return f"""v_{kind} AS (SELECT DISTINCT repo, v FROM ({_VALUES[kind]}) WHERE v IS NOT NULL AND repo IS NOT NULL AND {where}), n_{kind} AS (SELECT repo, count(*) AS n FROM v_{kind} GROUP BY repo),
i_{kind} AS (SELECT p.repo_a, p.repo_b, count(*) AS k FROM p JOIN v_{kind} x ON x.repo = p.repo_a JOIN v_{kind} y ON y.repo = p.repo_b AND y.v = x.v GROUP BY ALL),
o_{kind} AS (SELECT p.repo_a, p.repo_b, coalesce(k, 0) AS shared, coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(k, 0) AS whole, coalesce(coalesce(k, 0) / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(k, 0), 0), 0) AS j FROM p LEFT JOIN i_{kind} i USING (repo_a, repo_b) LEFT JOIN n_{kind} x ON x.repo = p.repo_a LEFT JOIN n_{kind} y ON y.repo = p.repo_b)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((FILES, PAIRS, *parts))


def _joined(*kinds: str) -> str:
    return "o_" + kinds[0] + "".join(f" JOIN o_{k} USING (repo_a, repo_b)" for k in kinds[1:])


def _near(c: str, scale: float) -> str:
    return f"greatest(0, 1 - abs(coalesce(a.{c}, 0) - coalesce(b.{c}, 0)) / {float(scale)})"


_SIDES = "p LEFT JOIN {t} a ON a.repo = p.repo_a LEFT JOIN {t} b ON b.repo = p.repo_b"
_DETAIL_KINDS = ["dependency", "framework", "class", "function", "import", "file"]
_CRUD_SAME = "(" + " + ".join(f"(coalesce(a.has_{op}, FALSE) = coalesce(b.has_{op}, FALSE))::INT" for op in f.CRUD_WORDS) + ") / 4"
_DETAIL_CTE = ", ".join([CRUD, *(overlap(k) for k in _DETAIL_KINDS), f"k AS (SELECT p.repo_a, p.repo_b, {_CRUD_SAME} AS crud FROM {_SIDES.format(t='c')})", f"detail AS (SELECT repo_a, repo_b, {', '.join(f'o_{k}.j AS j_{k}' for k in _DETAIL_KINDS)}, crud FROM k JOIN " + " JOIN ".join(f"o_{k} USING (repo_a, repo_b)" for k in _DETAIL_KINDS) + ")"])


def _pool(level: str) -> str:
    return f"{level}_v AS (SELECT repo, i, avg(vec[i]::DOUBLE) AS x FROM (SELECT repo, id, arg_min(vec, s) AS vec, unnest(range(1, 65)) AS i FROM (SELECT repo, scan_id AS s, unnest({level}_ids) AS id, unnest({level}_embeddings) AS vec FROM project_embedding WHERE repo IS NOT NULL) WHERE id IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL)) = 0 GROUP BY repo, id) GROUP BY repo, i)"


def _cos(name: str, table: str) -> str:
    return f"{name}_d AS (SELECT p.repo_a, p.repo_b, sum(a.x * b.x) AS d FROM p JOIN {table} a ON a.repo = p.repo_a JOIN {table} b ON b.repo = p.repo_b AND b.i = a.i GROUP BY ALL), {name}_n AS (SELECT repo, sqrt(sum(x * x)) AS n FROM {table} GROUP BY repo), {name}_c AS (SELECT p.repo_a, p.repo_b, coalesce(d / nullif(x.n * y.n, 0), 0) AS cos FROM p LEFT JOIN {name}_d USING (repo_a, repo_b) LEFT JOIN {name}_n x ON x.repo = p.repo_a LEFT JOIN {name}_n y ON y.repo = p.repo_b)"


_FUNCTION_COS = _pool("function") + ", " + _cos("fu", "function_v")
_STYLE = "style AS (" + FEATURES["style_profile"].split("SELECT n.repo")[0].split(FILES + ", ")[1].join(["WITH ", "SELECT n.repo" + FEATURES["style_profile"].split("SELECT n.repo")[1]]) + ")"
_NAMES = "names AS (" + FEATURES["naming_profile"] + ")"
_FACTS = f"""fl AS (SELECT repo, avg(n) AS l, avg(CASE WHEN s IS NOT NULL THEN regexp_matches(s, '->|\\w\\s*:\\s*\\w')::INT END) AS h FROM (SELECT function_id, min(repo) AS repo, max(line_count) AS n, min(signature) AS s FROM function_embedding WHERE function_id IS NOT NULL AND repo IS NOT NULL GROUP BY function_id) GROUP BY repo),
facts AS (SELECT st.repo, avg_line_length, comment_ratio, l, h, coalesce(x.convention, 'unknown') || '/' || coalesce(y.convention, 'unknown') AS naming FROM style st LEFT JOIN fl ON fl.repo = st.repo LEFT JOIN names x ON x.repo = st.repo AND x.kind = 'functions' LEFT JOIN names y ON y.repo = st.repo AND y.kind = 'classes')"""
_FLAG_NAMES = ["app_folder", "tests_folder", "models_file", "routes_file", "schemas_file", "crud_file", "config_file", "dockerfile", "compose"]
_SEMANTIC_KINDS = ["signature", "class", "variable", "message"]
_M = {
    "style": f"SELECT p.repo_a, p.repo_b, ({_near('avg_line_length', 50)} + {_near('l', 30)} + {_near('comment_ratio', 0.3)} + {_near('h', 1)} + CASE WHEN coalesce(a.naming, 'unknown/unknown') = coalesce(b.naming, 'unknown/unknown') THEN 1 ELSE 0.5 END) / 5 AS style FROM {_SIDES.format(t='facts')}",
    "architecture": "SELECT p.repo_a, p.repo_b, (" + " + ".join(f"(coalesce(a.{x}, FALSE) = coalesce(b.{x}, FALSE))::INT" for x in _FLAG_NAMES) + f") / 9 AS architecture FROM {_SIDES.format(t='flags')}",
    "api_design": f"SELECT p.repo_a, p.repo_b, ({_near('n', 20)} + o_endpoint.j + o_response.j + o_status.j) / 4 AS api_design FROM {_SIDES.format(t='en')} JOIN o_endpoint USING (repo_a, repo_b) JOIN o_response USING (repo_a, repo_b) JOIN o_status USING (repo_a, repo_b)",
    "complexity": f"SELECT p.repo_a, p.repo_b, ({_near('n', 50)} + {_near('m', 20)} + (coalesce(a.s, FALSE) = coalesce(b.s, FALSE))::INT) / 3 AS complexity FROM {_SIDES.format(t='cx')}",
    "semantic": "SELECT repo_a, repo_b, (" + " + ".join(f"o_{k}.j" for k in _SEMANTIC_KINDS) + f") / 4 AS semantic FROM {_joined(*_SEMANTIC_KINDS)}",
    "fingerprint": "SELECT repo_a, repo_b, CASE WHEN same IS NULL THEN o_gram7.j ELSE (same + o_gram7.j) / 2 END AS fingerprint FROM o_gram7 LEFT JOIN sm USING (repo_a, repo_b)",
}
_NEEDS = {
    "style": [_STYLE, _NAMES, _FACTS],
    "architecture": [f"flags AS ({FLAGS})"],
    "api_design": [overlap("endpoint"), overlap("response"), overlap("status"), f"en AS (SELECT repo, count(*) AS n FROM {_ENDPOINTS} GROUP BY repo)"],
    "complexity": [f"cx AS (SELECT r.repo, coalesce(n, 0) AS n, coalesce(m, 0) AS m, s FROM (SELECT repo FROM p1) r LEFT JOIN (SELECT repo, count(*) AS n, bool_or(a) AS s FROM (SELECT function_id, min(repo) AS repo, bool_or(is_async) AS a FROM function_embedding WHERE function_id IS NOT NULL AND repo IS NOT NULL GROUP BY function_id) GROUP BY repo) x ON x.repo = r.repo LEFT JOIN (SELECT repo, count(*) AS m FROM {listed('classes', 'v')} GROUP BY repo) y ON y.repo = r.repo)"],
    "semantic": [overlap(k) for k in _SEMANTIC_KINDS],
    "fingerprint": [GRAMS, overlap("gram7"), "fh AS (SELECT repo, name, arg_max(body_hash, function_id) AS h FROM function_embedding WHERE function_id IS NOT NULL AND name IS NOT NULL AND body_hash IS NOT NULL GROUP BY repo, name)", "sm AS (SELECT p.repo_a, p.repo_b, avg((a.h = b.h)::INT) AS same FROM p JOIN fh a ON a.repo = p.repo_a JOIN fh b ON b.repo = p.repo_b AND b.name = a.name GROUP BY ALL)"],
}
_NEEDS["complexity"].insert(0, "p1 AS (SELECT repo_a AS repo FROM p UNION SELECT repo_b FROM p)")
_ALL: list[str] = []
for part in [_DETAIL_CTE, _FUNCTION_COS, *(x for needs in _NEEDS.values() for x in needs)]:
    if part not in _ALL and part != overlap("class"):
        _ALL.append(part)
_ROUNDED = ["style", "architecture", "api_design", "complexity", "dependencies", "frameworks", "semantic", "fingerprint"]
_WEIGHTS = [0.05, 0.10, 0.15, 0.05, 0.10, 0.10, 0.20, 0.25]
_DEEP = _with(*_ALL, *(f"m_{k} AS ({q})" for k, q in _M.items())) + ", dims AS (SELECT repo_a, repo_b, " + ", ".join(f"round({c}, 6) AS {c}" for c in _M) + ", round(j_dependency, 6) AS dependencies, round(j_framework, 6) AS frameworks, round(cos, 6) AS cosine FROM detail JOIN fu_c USING (repo_a, repo_b) " + " ".join(f"JOIN m_{k} USING (repo_a, repo_b)" for k in _M) + "), deep AS (SELECT *, " + " + ".join(f"{c} * {w}" for c, w in zip(_ROUNDED, _WEIGHTS, strict=True)) + " AS weighted FROM dims) "
_EVIDENCE = """ev AS (SELECT DISTINCT * FROM (SELECT repo, 'remark' AS kind, trim(x) AS v FROM (SELECT repo, unnest(regexp_extract_all(content, '(?m)#[ \\t]*([^\\n]+)$', 1)) AS x FROM s) WHERE length(trim(x)) > 10
UNION ALL SELECT repo, 'docstring', trim(docstring) FROM function_embedding WHERE length(trim(docstring)) > 20 AND repo IS NOT NULL
UNION ALL SELECT repo, 'literal', x FROM (SELECT repo, unnest(regexp_extract_all(content, '["'']([^"''\\n]{16,})["'']', 1)) AS x FROM s) WHERE NOT regexp_matches(x, '^(?:/|http|sqlite)'))),
sh AS (SELECT p.repo_a, p.repo_b, x.kind, x.v FROM p JOIN ev x ON x.repo = p.repo_a JOIN ev y ON y.repo = p.repo_b AND y.kind = x.kind AND y.v = x.v)"""
_EXPECTED = f"({_one_of('lower(v)', f.EXPECTED)} OR regexp_matches(v, '{f.EXPECTED_SIGNATURES}'))"
_STOP = "('main', 'get', 'post', 'put', 'delete', 'create', 'read', 'update', 'list', 'init', '__init__', 'setup', 'teardown', 'run', 'start', 'stop')"

ORACLE: dict[str, str] = {
    "pair_detail": _with(_DETAIL_CTE) + " SELECT repo_a, repo_b, " + ", ".join(f"round(j_{k}, 6) AS {k}_similarity" for k in _DETAIL_KINDS) + ", round(crud, 6) AS crud_similarity FROM detail",
    "pair_vector_cosine": _with(_FUNCTION_COS) + " SELECT repo_a, repo_b, round(cos, 6) AS cosine FROM fu_c",
    "pair_combined_v2": _with(_DETAIL_CTE, _FUNCTION_COS) + " SELECT repo_a, repo_b, round(cos, 6) AS vector, round(0.3 * round(cos, 6) + 0.15 * round(j_dependency, 6) + 0.15 * round(j_framework, 6) + 0.1 * round(j_class, 6) + 0.1 * round(j_function, 6) + 0.1 * round(j_import, 6) + 0.1 * round(crud, 6), 6) AS combined FROM detail JOIN fu_c USING (repo_a, repo_b)",
    **{f"pair_{k}": _with(*_NEEDS[k]) + f" SELECT repo_a, repo_b, round({k}, 6) AS {k} FROM ({q})" for k, q in _M.items()},
    "pair_deep": _DEEP + "SELECT repo_a, repo_b, " + ", ".join(_ROUNDED) + ", round(weighted, 6) AS weighted, round(0.7 * weighted + 0.3 * cosine, 6) AS combined FROM deep",
    "pair_risk": _DEEP + "SELECT repo_a, repo_b, fingerprint, semantic, api_design, architecture, CASE WHEN fingerprint >= 0.15 THEN 'HIGH' WHEN fingerprint >= 0.08 OR (semantic >= 0.5 AND api_design >= 0.6) THEN 'MEDIUM' WHEN fingerprint >= 0.03 OR (semantic >= 0.4 AND api_design >= 0.5 AND architecture >= 0.8) THEN 'LOW' ELSE 'OK' END AS risk FROM deep",
    "project_blends": "WITH " + _pool("function") + ", " + _pool("file") + ", y AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.i, b.i) AS i, 0.25 * (coalesce(a.x, 0) + coalesce(b.x, 0)) / 2 + 0.35 * coalesce(a.x, 0) + 0.15 * coalesce(b.x, 0) AS y FROM function_v a FULL JOIN file_v b ON a.repo = b.repo AND a.i = b.i) SELECT repo, (i - 1)::INT AS place, round(coalesce(y / nullif(sqrt(sum(y * y) OVER (PARTITION BY repo)), 0), 0), 6) AS x FROM y",
    "pair_smart_combined": "WITH " + PAIRS + ", " + ", ".join([_pool("function"), _pool("file"), "project_v AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.i, b.i) AS i, (coalesce(a.x, 0) + coalesce(b.x, 0)) / 2 AS x FROM function_v a FULL JOIN file_v b ON a.repo = b.repo AND a.i = b.i)", _cos("fu", "function_v"), _cos("fi", "file_v"), _cos("pr", "project_v"), _PRINTS, overlap("print")]) + " SELECT repo_a, repo_b, round(pr_c.cos, 6) AS project, round(fu_c.cos, 6) AS function, round(fi_c.cos, 6) AS file, round(j, 6) AS fingerprint, round(0.15 * pr_c.cos + 0.35 * fu_c.cos + 0.1 * fi_c.cos + 0.2 * j, 6) AS combined FROM pr_c JOIN fu_c USING (repo_a, repo_b) JOIN fi_c USING (repo_a, repo_b) JOIN o_print USING (repo_a, repo_b)",
    "pair_file_overlap": _with(overlap("file400")) + " SELECT repo_a, repo_b, shared AS files FROM o_file400",
    "pair_gram_overlap": _with(overlap("gram5")) + " SELECT repo_a, repo_b, shared, round(j, 6) AS similarity, j > 0.3 AS matches FROM o_gram5",
    "pair_evidence": _with(_EVIDENCE, overlap("name"), overlap("file400"), overlap("import", "v NOT IN ('fastapi', 'pydantic', 'sqlmodel', 'typing', 'uvicorn', 'pytest')"))
    + f""", t AS (SELECT repo_a, repo_b, count(*) FILTER (kind = 'remark' AND {_EXPECTED}) AS expected, count(*) FILTER ((kind = 'remark' AND NOT {_EXPECTED} AND length(v) > 30) OR (kind = 'docstring' AND length(v) > 50)) AS investigate, count(*) FILTER (kind = 'literal' AND NOT {_EXPECTED} AND NOT contains(lower(v), 'not found') AND length(v) > 30) AS unusual FROM sh GROUP BY ALL),
r AS (SELECT repo_a, repo_b, coalesce(expected, 0) AS expected, coalesce(investigate, 0) AS investigate, coalesce(unusual, 0) AS unusual, (o_name.whole > o_name.shared)::INT + (o_file400.whole > o_file400.shared)::INT + (o_import.whole > o_import.shared)::INT AS differing FROM o_name JOIN o_file400 USING (repo_a, repo_b) JOIN o_import USING (repo_a, repo_b) LEFT JOIN t USING (repo_a, repo_b)),
w AS (SELECT *, CASE WHEN unusual >= 2 THEN 'review' WHEN unusual = 1 AND investigate >= 3 THEN 'worth reviewing' WHEN investigate >= 5 AND differing < 3 THEN 'minor' ELSE 'normal' END AS recommendation FROM r)
SELECT *, recommendation IN ('review', 'worth reviewing') AS flagged FROM w""",
    "pair_naming": f"WITH {PAIRS}, n AS (SELECT DISTINCT repo, name FROM function_embedding WHERE name IS NOT NULL AND repo IS NOT NULL), z AS (SELECT repo, count(*) AS n FROM n GROUP BY repo) SELECT p.repo_a, p.repo_b, count(*) AS shared, round(count(*) / greatest(max(za.n), max(zb.n)), 6) AS similarity FROM p JOIN n x ON x.repo = p.repo_a JOIN n y ON y.repo = p.repo_b AND y.name = x.name JOIN z za ON za.repo = p.repo_a JOIN z zb ON zb.repo = p.repo_b WHERE x.name NOT IN {_STOP} GROUP BY p.repo_a, p.repo_b HAVING count(*) >= 5",
}
