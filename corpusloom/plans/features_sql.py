"""The feature queries in DuckDB's SQL, written apart from the Spark plans; only lists of fixed values are shared."""

from __future__ import annotations

from corpusloom.plans import features as f


def _one_of(column: str, words: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


FILES = """f AS (SELECT file_id, repo, path, ext, regexp_replace(coalesce(c, ''), '\\r\\n?', chr(10), 'g') AS content FROM (SELECT file_id, min(repo) repo, min(path) path, min(ext) ext, min(content) c FROM file_embedding WHERE file_id IS NOT NULL GROUP BY file_id) WHERE repo IS NOT NULL AND path IS NOT NULL),
s AS (SELECT * FROM f WHERE ext = '.py')"""
LINES = "CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END"
LISTED = "(SELECT file_id, repo, path, unnest(a) AS {out}, unnest(range(len(a))) AS pos FROM (SELECT file_id, min(repo) repo, min(path) path, min({column}) a FROM file_embedding WHERE file_id IS NOT NULL AND repo IS NOT NULL GROUP BY file_id))"
_NORMAL = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(content, '(?m)#.*$', '', 'g'), '"{3}(?s:.)*?"{3}', '', 'g'), '''{3}(?s:.)*?''{3}', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> ''), chr(10))"""


def listed(column: str, out: str) -> str:
    return f"(SELECT * FROM {LISTED.format(column=column, out=out)} WHERE {out} IS NOT NULL)"


_CONVENTION = "count(*) FILTER (contains(name, '_') AND name = lower(name) AND name <> upper(name)) AS snake, count(*) FILTER (regexp_matches(name, '^[a-z].*[A-Z]')) AS camel, count(*) FILTER (regexp_matches(name, '^[A-Z].*[a-z]')) AS pascal"
_NAMED = "CASE WHEN names = 0 THEN 'unknown' WHEN snake > camel AND snake > pascal THEN 'snake_case' WHEN camel > snake THEN 'camelCase' WHEN pascal > snake THEN 'PascalCase' ELSE 'mixed' END"
_ENDPOINTS = f"(SELECT repo, unnest(regexp_extract_all(content, '{_re(f.ENDPOINT)}', 1)) AS verb, unnest(regexp_extract_all(content, '{_re(f.ENDPOINT)}', 2)) AS path FROM s)"
_CRUD = ", ".join(f"coalesce(bool_or({_one_of('lower(name)', w)}), FALSE) AS has_{op}" for op, w in f.CRUD_WORDS.items())
CRUD = f"c AS (SELECT f.repo, {_CRUD} FROM (SELECT DISTINCT repo FROM f) f LEFT JOIN (SELECT repo, name FROM {listed('functions', 'name')} UNION ALL SELECT repo, upper(verb) || ' ' || path FROM {_ENDPOINTS}) n ON n.repo = f.repo GROUP BY f.repo)"
_PROFILE = "coalesce(nullif(concat_ws('-', " + ", ".join(f"CASE WHEN has_{op} THEN '{op}' END" for op in sorted(f.CRUD_WORDS)) + "), ''), 'none')"
_GRAMS = f"""w AS (SELECT repo, path, file_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT repo, path, file_id, regexp_extract_all({_NORMAL}, '\\w+') AS ws FROM s WHERE NOT contains(lower(path), 'test'))),
q AS (SELECT repo, w, {', '.join(f'lead(w, {k}) OVER o AS w{k}' for k in range(1, 8))} FROM w WINDOW o AS (PARTITION BY repo ORDER BY path, file_id, i)),
g7 AS (SELECT DISTINCT repo, substr(md5(concat_ws(' ', w, w1, w2, w3, w4, w5, w6)), 1, 8) AS h FROM q WHERE w7 IS NOT NULL)"""
GRAMS = _GRAMS
_CUT = "regexp_replace(regexp_extract(t, '^([^{signs}]*)', 1), '\\s+$', '')"
_REST = "CASE WHEN contains(t, '[') AND contains(t, ']') THEN trim(regexp_extract(t, '^([^\\[]*)', 1)) WHEN contains(t, ' = ') AND contains(t, '\"') THEN regexp_replace(regexp_extract(t, '^([^=]*)', 1), '^[\\s\"'']+|[\\s\"'']+$', '', 'g') WHEN regexp_matches(t, '^[A-Za-z0-9_.-]+$') THEN t END"
_PINNED = "regexp_matches(t, '==|>=|~=|<=')"


def _checks(rows: dict[str, str]) -> str:
    return ", ".join(f"bool_or({rule}) AS {name}" for name, rule in rows.items())


_FLAGS = {
    "app_folder": _one_of("path", ["app/", "src/"]), "tests_folder": "contains(regexp_replace(lower(path), '/?[^/]*$', ''), 'test')", "models_file": _one_of("lower(path)", ["models.py", "model.py"]), "routes_file": _one_of("path", ["routes.py", "router.py", "routers/"]),
    "schemas_file": _one_of("lower(path)", ["schemas.py", "schema.py"]), "crud_file": "contains(lower(path), 'crud.py')", "config_file": _one_of("lower(path)", ["config.py", "settings.py"]), "main_file": "contains(lower(path), 'main.py')",
    "dockerfile": "path = 'Dockerfile'", "compose": "path IN ('docker-compose.yml', 'docker-compose.yaml')", "readme": "path = 'README.md'", "requirements": "path = 'requirements.txt'", "pyproject": "path = 'pyproject.toml'", "env_example": "path IN ('.env.example', 'env.example')",
}
FLAGS = f"SELECT repo, count(*) AS files, {_checks(_FLAGS)}, max(len(string_split(path, '/'))) AS depth, {_checks({'domains': _one_of('path', ['domain/', 'modules/'])})} FROM f GROUP BY repo"

ORACLE: dict[str, str] = {
    "style_profile": f"""WITH {FILES}, l AS (SELECT repo, unnest({LINES}) AS x FROM s), n AS (SELECT DISTINCT repo FROM s), g AS (SELECT repo, count(*) AS lines, avg(length(x)) FILTER (NOT regexp_matches(x, '^\\s*$')) AS m, max(length(x)) FILTER (NOT regexp_matches(x, '^\\s*$')) AS h, count(*) FILTER (regexp_matches(x, '^\\s*$')) AS b, count(*) FILTER (regexp_matches(x, '^\\s*#')) AS r FROM l GROUP BY repo)
SELECT n.repo, coalesce(lines, 0) AS lines, round(coalesce(m, 0), 6) AS avg_line_length, coalesce(h, 0) AS max_line_length, round(coalesce(b / lines, 0), 6) AS blank_ratio, round(coalesce(r / lines, 0), 6) AS comment_ratio FROM n LEFT JOIN g ON g.repo = n.repo""",
    "indentation_style": f"WITH {FILES}, l AS (SELECT repo, path, file_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT *, {LINES} AS ls FROM s)), k AS (SELECT repo, path, file_id, i, CASE WHEN starts_with(x, chr(9)) THEN 'tabs' WHEN starts_with(x, '    ') THEN '4' WHEN starts_with(x, '  ') THEN '2' END AS kind FROM l), r AS (SELECT repo, kind, row_number() OVER (PARTITION BY repo ORDER BY path, file_id, i) AS n FROM k WHERE kind IS NOT NULL) SELECT d.repo, coalesce(r.kind, 'unknown') AS indentation FROM (SELECT DISTINCT repo FROM s) d LEFT JOIN r ON r.repo = d.repo AND r.n = 1",
    "naming_profile": f"WITH n AS (SELECT repo, 'functions' AS kind, name FROM {listed('functions', 'name')} UNION ALL SELECT repo, 'classes', name FROM {listed('classes', 'name')}), g AS (SELECT repo, kind, count(*) AS names, {_CONVENTION} FROM n GROUP BY repo, kind) SELECT *, {_NAMED} AS convention FROM g",
    "architecture_flags": f"WITH {FILES}, g AS ({FLAGS}) SELECT * EXCLUDE (domains), CASE WHEN app_folder AND (models_file OR routes_file) AND domains THEN 'domain-driven' WHEN app_folder AND (models_file OR routes_file) THEN 'layered' ELSE 'flat' END AS organisation FROM g",
    "architecture_kinds": f"WITH {FILES} SELECT repo, count(*) AS files, CASE WHEN bool_or(path LIKE '%routes%' OR path LIKE '%routers%') THEN 'router-based' WHEN bool_or(path LIKE '%views%') THEN 'mvc' WHEN count(*) <= 3 THEN 'single-file' ELSE 'modular' END AS kind FROM s GROUP BY repo",
    "endpoint_list": f"WITH {FILES} SELECT repo, endpoint, count(*) AS uses FROM (SELECT repo, upper(verb) || ' ' || path AS endpoint FROM {_ENDPOINTS} UNION ALL SELECT repo, 'ROUTE ' || unnest(regexp_extract_all(content, '{_re(f.ROUTE)}', 1)) FROM s) GROUP BY repo, endpoint",
    "path_parameters": f"WITH {FILES}, e AS (SELECT repo, unnest(regexp_extract_all(content, '{_re(f.ENDPOINT_WIDE)}', 2)) AS path FROM s), p AS (SELECT repo, unnest(regexp_extract_all(path, '\\{{([^}}]+)\\}}', 1)) AS parameter FROM e) SELECT repo, parameter, count(*) AS uses FROM p GROUP BY repo, parameter",
    "api_profile": f"""WITH {FILES}, e AS (SELECT repo, count(*) AS endpoints, {', '.join(f"count(*) FILTER (lower(verb) = '{v}') AS {v}_endpoints" for v in f.VERBS)}, bool_or(regexp_matches(path, '\\{{[^}}]+\\}}')) AS pp FROM {_ENDPOINTS} GROUP BY repo),
g AS (SELECT repo, bool_or(regexp_matches(content, 'Query\\s*\\(')) AS query_params, bool_or(regexp_matches(content, 'Body\\s*\\(')) AS request_body, bool_or(regexp_matches(lower(content), 'skip|limit|page|offset')) AS pagination, bool_or(regexp_matches(lower(content), 'filter|search|query|where')) AS filtering, bool_or(regexp_matches(lower(content), 'sort|order')) AS sorting FROM s GROUP BY repo)
SELECT g.*, coalesce(endpoints, 0) AS endpoints, {', '.join(f'coalesce({v}_endpoints, 0) AS {v}_endpoints' for v in f.VERBS)}, coalesce(pp, FALSE) AS path_params FROM g LEFT JOIN e ON e.repo = g.repo""",
    "database_operations": f"WITH {FILES} SELECT repo, " + ", ".join(f"count(*) FILTER (regexp_matches(content, '{_re(p)}')) AS {o}_files" for o, p in f.DATABASE.items()) + f", sum(len(regexp_extract_all(content, '{_re(f.DATA_MODEL)}')))::BIGINT AS models, bool_or({_one_of('content', ['session.add', 'session.commit'])}) AS session FROM s GROUP BY repo",
    "framework_detection": f"WITH {FILES}, w AS (" + " UNION ALL ".join(f"SELECT repo, 'words' AS source, '{n}' AS framework FROM f WHERE ext IN ('.py', '.toml', '.json') AND ({_one_of('lower(content)', w)} OR lower(path) IN {_in(w)})" for n, w in f.FRAMEWORK_WORDS.items()) + f"), d AS (SELECT repo, 'dependency' AS source, lower(trim(x)) AS framework FROM (SELECT repo, unnest(dependencies) AS x FROM repo_analysis WHERE repo IS NOT NULL)), i AS (SELECT repo, 'import' AS source, string_split(i, '.')[1] AS framework FROM {listed('imports', 'i')}) SELECT * FROM w UNION SELECT * FROM d WHERE framework IN {_in(f.FRAMEWORK_PACKAGES)} UNION SELECT * FROM i WHERE framework IN {_in(f.FRAMEWORK_IMPORTS)}",
    "crud_profile": f"WITH {FILES}, {CRUD} SELECT *, {_PROFILE} AS profile FROM c",
    "crud_profile_groups": f"WITH {FILES}, {CRUD} SELECT {_PROFILE} AS profile, repo, count(*) OVER (PARTITION BY {_PROFILE}) AS repos FROM c",
    "dependency_lines": f"""WITH {FILES}, l AS (SELECT file_id, repo, unnest(ls) AS x, unnest(range(len(ls))) AS line FROM (SELECT *, {LINES} AS ls FROM f WHERE ext = '.toml')), t AS (SELECT file_id, repo, line, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM l),
n AS (SELECT file_id, repo, line, 'wide' AS reader, CASE WHEN {_PINNED} OR contains(t, '>') THEN {_CUT.format(signs='=<>~')} ELSE {_REST} END AS name FROM t WHERE t <> '' AND t NOT LIKE '#%' UNION ALL SELECT file_id, repo, line, 'plain', CASE WHEN {_PINNED} THEN {_CUT.format(signs='=<>~!')} ELSE {_REST} END FROM t WHERE t <> '' AND t NOT LIKE '#%' UNION ALL SELECT file_id, repo, line, 'lower', lower({_CUT.format(signs='=<>~!')}) FROM t WHERE t <> '' AND t NOT LIKE '#%')
SELECT file_id, repo, reader, name, min(line)::INT AS line FROM n WHERE name <> '' GROUP BY ALL""",
    "file_classes": f"WITH {FILES}, b AS (SELECT repo, lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS b, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN {_in(f.CODE_EXTENSIONS)} AS code FROM f) SELECT repo, count(*) AS files, count(*) FILTER (code) AS code_files, count(*) FILTER (code AND contains(regexp_replace(b, '\\.[^.]*$', ''), 'test')) AS tests_by_stem, count(*) FILTER (b LIKE 'test\\_%' ESCAPE '\\' OR b LIKE '%\\_test.py' ESCAPE '\\' OR contains(p, 'tests')) AS tests_by_place FROM b GROUP BY repo",
    "expected_blocks": f"SELECT block_id, {_one_of('lower(c)', f.EXPECTED)} AS pattern, regexp_matches(c, '{f.EXPECTED_SIGNATURES}') AS signature, regexp_matches(c, '{_re(f.BOILERPLATE)}') AS boilerplate FROM (SELECT block_id, coalesce(min(code), '') AS c FROM code_block WHERE block_id IS NOT NULL GROUP BY block_id)",
    "file_checklist": f"""WITH {FILES}, g AS (SELECT repo, bool_or(path IN ('README.md', 'README.rst', 'README.txt', 'README', 'readme.md')) AS readme, bool_or(path = '.gitignore') AS gitignore, bool_or(path IN ('Dockerfile', 'dockerfile', 'docker/Dockerfile') OR regexp_matches(path, '^[^/]*\\.Dockerfile$')) AS dockerfile, bool_or(regexp_matches(path, '^(tests|test|Tests|spec)/') OR regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\\.py$')) AS tests, bool_or(path IN ('requirements.txt', 'pyproject.toml')) AS requirements FROM f GROUP BY repo)
SELECT *, readme::INT + gitignore::INT + dockerfile::INT + tests::INT + requirements::INT AS score, concat_ws(', ', CASE WHEN NOT readme THEN 'README' END, CASE WHEN NOT gitignore THEN '.gitignore' END, CASE WHEN NOT dockerfile THEN 'Dockerfile' END, CASE WHEN NOT tests THEN 'tests' END) AS missing FROM g""",
    "import_counts": f"WITH i AS (SELECT repo, string_split(i, '.')[1] AS m FROM {listed('imports', 'i')}), g AS (SELECT repo, count(*) AS total, count(DISTINCT m) AS different, count(*) FILTER (m IN {_in(f.STANDARD_MODULES)}) AS standard FROM i WHERE m <> '' GROUP BY repo) SELECT *, different - standard AS third_party FROM g",
    "whitespace_forms": f"WITH {FILES}, t AS (SELECT file_id, trim(regexp_replace(regexp_replace(content, '(?m)#.*$', '', 'g'), '\\s+', ' ', 'g')) AS t FROM s) SELECT file_id, md5(t) AS form, len(regexp_extract_all(t, '\\w+')) AS words, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS parts FROM t",
    "gram7_sets": f"WITH {FILES}, {_GRAMS} SELECT repo, count(*) AS grams, min(h) AS least FROM g7 GROUP BY repo",
    "code_hashes": f"WITH {FILES}, n AS (SELECT file_id, {_NORMAL} AS n FROM s) SELECT file_id, md5(n) AS code_hash, md5(array_to_string(regexp_extract_all(n, '\\w+')[1:5000], ' ')) AS words_hash FROM n",
    "last_function_hashes": "SELECT repo, name, arg_max(body_hash, function_id) AS hash FROM function_embedding WHERE function_id IS NOT NULL AND name IS NOT NULL AND body_hash IS NOT NULL GROUP BY repo, name",
    "semantic_counts": f"""WITH {FILES}, v AS (SELECT repo, 'remark' AS kind, trim(x) AS v FROM (SELECT repo, unnest(regexp_extract_all(content, '(?m)#[ \\t]*([^\\n]+)$', 1)) AS x FROM s) WHERE length(trim(x)) > 5
UNION ALL SELECT repo, 'literal', x FROM (SELECT repo, unnest(regexp_extract_all(content, '["'']([^"'']{{10,100}})["'']', 1)) AS x FROM s) WHERE NOT regexp_matches(x, '^(?:/|http|\\{{|<)')
UNION ALL SELECT repo, 'message', unnest(regexp_extract_all(content, '(?i)(?:detail|message|msg)\\s*=\\s*["'']([^"'']+)["'']', 1)) FROM s)
SELECT repo, kind, count(*) AS total, count(DISTINCT v) AS different, max(length(v)) AS longest FROM v GROUP BY repo, kind""",
    "embedding_texts": """WITH t AS (SELECT file_id, min(path) path, min(imports) i, min(functions) f, min(classes) c, min(line_count) n, min(code_line_count) m, min(docstring) d, min(top_level_code) t FROM file_embedding WHERE file_id IS NOT NULL GROUP BY file_id),
e AS (SELECT file_id, concat_ws(chr(10), 'File: ' || coalesce(path, ''), 'Imports: ' || coalesce(array_to_string(i[1:20], ', '), ''), 'Functions: ' || coalesce(array_to_string(f[1:20], ', '), ''), 'Classes: ' || coalesce(array_to_string(c[1:20], ', '), ''), 'Lines: ' || coalesce(n, 0) || ', Code lines: ' || coalesce(m, 0), CASE WHEN coalesce(d, '') <> '' THEN 'Module documentation: ' || substr(d, 1, 500) END, CASE WHEN coalesce(t, '') <> '' THEN 'Top-level code:' || chr(10) || substr(t, 1, 1000) END) AS x FROM t)
SELECT file_id, length(x) AS size, md5(x) AS digest FROM e""",
    "payload_projection": "WITH t AS (SELECT scan_id, min(repo) repo, min(files) f, min(frameworks) w, min(dependencies) d, min(readme_excerpt) r FROM repo_analysis WHERE scan_id IS NOT NULL GROUP BY scan_id) SELECT scan_id, repo, coalesce(array_to_string(f[1:30], '|'), '') AS files, coalesce(array_to_string(w[1:20], '|'), '') AS frameworks, coalesce(array_to_string(d[1:50], '|'), '') AS dependencies, coalesce(substr(r, 1, 500), '') AS readme FROM t",
    "merged_features": "WITH v AS (" + " UNION ALL ".join(f"SELECT repo, '{c}' AS kind, path, v FROM {listed(c, 'v')}" for c in ("imports", "functions", "classes")) + ") SELECT repo, kind, v, count(*) AS uses, min(path) AS first_path FROM v GROUP BY repo, kind, v",
    "hashed_word_vectors": "WITH d AS (SELECT doc_id, min(text) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM d)), p AS (SELECT doc_id, (h % 64)::INT AS place, sum(CASE WHEN h % 128 < 64 THEN 1 ELSE -1 END) AS x FROM w GROUP BY 1, 2 HAVING sum(CASE WHEN h % 128 < 64 THEN 1 ELSE -1 END) <> 0) SELECT doc_id, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM p",
}
