"""Features of files and repositories, detected from paths and contents with built-in expressions.

Every query aggregates per file first (array functions inside a row, no explode of lines) and per repository after, so
that a repository with a tenth of all files is combined on the map side. Word lists, patterns, weights and bands are
fixed values of the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.blocks import BOILERPLATE, normalized_code
from corpusloom.runtime import read_table

# --- fixed values ---
CODE_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".rb", ".php", ".cs", ".swift", ".kt", ".scala"]
VERBS = ["get", "post", "put", "patch", "delete"]
ENDPOINT = r"(?i)@(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*[\"']([^\"']+)[\"']"
ROUTE = r"(?i)@(?:app|router)\.route\s*\(\s*[\"']([^\"']+)[\"']"
ENDPOINT_WIDE = r"@(?:app|router)\.(get|post|put|patch|delete|options|head)\s*\(\s*[\"']([^\"']+)[\"']"
FRAMEWORK_WORDS = {
    "fastapi": ["fastapi", "apirouter", "@app.get", "@app.post", "@router.get", "@router.post"],
    "flask": ["flask", "@app.route"],
    "django": ["django", "models.model", "views.py"],
    "pydantic": ["basemodel", "field", "validator", "model_validator"],
    "sqlalchemy": ["sqlalchemy", "column", "relationship", "declarative_base"],
    "pytest": ["pytest", "@pytest.fixture", "test_"],
    "docker": ["dockerfile", "docker-compose"],
}
FRAMEWORK_PACKAGES = ["fastapi", "flask", "django", "pydantic", "sqlalchemy", "sqlmodel", "pytest", "httpx", "uvicorn", "alembic", "redis", "celery", "mongodb", "motor"]
FRAMEWORK_IMPORTS = ["fastapi", "sqlmodel", "sqlalchemy", "pydantic", "uvicorn"]
CRUD_WORDS = {"create": ["post", "create", "add", "insert"], "read": ["get", "read", "fetch", "list", "retrieve"], "update": ["put", "patch", "update", "modify"], "delete": ["delete", "remove", "destroy"]}
STANDARD_MODULES = ["os", "sys", "json", "typing", "collections", "itertools", "functools", "pathlib", "datetime", "re", "math", "random", "hashlib", "uuid", "dataclasses", "abc", "contextlib", "logging", "unittest", "asyncio"]
EXPECTED = ["session.add(", "session.commit()", "session.refresh(", "session.delete(", "session.get(", "session.exec(", "select(", "@app.get(", "@app.post(", "@app.put(", "@app.delete(", "@app.patch(", "httpexception(", "status_code=404", "status_code=201", "response_model=", "depends(", "field(", "model_dump(", "model_validate(", "basemodel", "sqlmodel", "from fastapi import", "from pydantic import", "from sqlmodel import", "from typing import"]
EXPECTED_SIGNATURES = r"(?i)def (create|add)_\w+\(|def (get|read|retrieve)_\w+\(|def (update|modify|edit)_\w+\(|def (delete|remove)_\w+\(|def list_\w+\("
DATABASE = {"create": r"session\.add\s*\(", "read": r"session\.query\s*\(|select\s*\(", "update": r"session\.commit\s*\(", "delete": r"session\.delete\s*\(", "execute": r"session\.execute\s*\(", "refresh": r"session\.refresh"}
DATA_MODEL = r"class\s+(\w+)\s*\([^)]*(?:SQLModel|Base|Model)[^)]*\)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file id, with line ends in one style."""
    table = read_table(spark, sf_dir, "file_embedding").where("file_id is not null")
    one = table.groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("path").alias("path"), F.min("ext").alias("ext"), F.min("content").alias("content"))
    return one.where("repo is not null and path is not null").withColumn("content", F.regexp_replace(F.coalesce("content", F.lit("")), r"\r\n?", "\n"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("ext = '.py'")


def listed(spark: SparkSession, sf_dir: str, column: str, out: str) -> DataFrame:
    """``(file_id, repo, pos, out)``: the elements of an extracted array of every file."""
    table = read_table(spark, sf_dir, "file_embedding").where("file_id is not null and repo is not null").groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("path").alias("path"), F.min(column).alias("a"))
    return table.select("file_id", "repo", "path", F.posexplode("a").alias("pos", out)).where(F.col(out).isNotNull())


def lines_of(content: str = "content") -> Column:
    """Lines of a text; a line end at the very end begins no further line."""
    return F.when(F.col(content) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\n\z", ""), "\n", -1))


def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of lines, share of blank and comment lines."""
    blank, remark = lambda x: F.regexp_like(x, F.lit(r"^\s*$")), lambda x: F.regexp_like(x, F.lit(r"^\s*#"))
    told = sources(spark, sf_dir).withColumn("l", lines_of()).withColumn("full", F.filter("l", lambda x: ~blank(x)))
    sizes = F.transform("full", lambda x: F.length(x))
    per = told.select("repo", F.size("l").alias("n"), F.size("full").alias("k"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("chars"), F.array_max(sizes).alias("longest"), F.size(F.filter("l", remark)).alias("remarks"))
    g = per.groupBy("repo").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("chars").alias("chars"), F.max("longest").alias("max_line_length"), F.sum("remarks").alias("remarks"))
    share = lambda a: F.round(F.coalesce(F.try_divide(a, F.col("n")), F.lit(0.0)), 6)
    return g.select("repo", F.col("n").alias("lines"), F.round(F.coalesce(F.try_divide("chars", "k"), F.lit(0.0)), 6).alias("avg_line_length"), F.coalesce("max_line_length", F.lit(0)).cast("bigint").alias("max_line_length"), share(F.col("n") - F.col("k")).alias("blank_ratio"), share(F.col("remarks")).alias("comment_ratio"))


def indentation_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first indented line of a repository, in order of paths, decides."""
    kind = lambda x: F.when(x.startswith("\t"), "tabs").when(x.startswith("    "), "4").when(x.startswith("  "), "2")
    found = sources(spark, sf_dir).withColumn("kind", F.get(F.filter(F.transform(lines_of(), kind), lambda x: x.isNotNull()), F.lit(0)))
    g = found.groupBy("repo").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct("path", "file_id"))).alias("kind"))
    return g.select("repo", F.coalesce("kind", F.lit("unknown")).alias("indentation"))


def convention_of(names: str) -> list[Column]:
    n = F.col(names)
    snake = F.count_if(n.contains("_") & (n == F.lower(n)) & (n != F.upper(n)))
    camel = F.count_if(F.regexp_like(n, F.lit(r"^[a-z].*[A-Z]|^[a-z][A-Z]")))
    pascal = F.count_if(F.regexp_like(n, F.lit(r"^[A-Z].*[a-z]")))
    return [snake.alias("snake"), camel.alias("camel"), pascal.alias("pascal")]


def named(kind: Column) -> Column:
    return F.when(kind == 0, "unknown").when((F.col("snake") > F.col("camel")) & (F.col("snake") > F.col("pascal")), "snake_case").when(F.col("camel") > F.col("snake"), "camelCase").when(F.col("pascal") > F.col("snake"), "PascalCase").otherwise("mixed")


def naming_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conventions of function and class names."""
    both = [listed(spark, sf_dir, c, "name").select("repo", F.lit(c).alias("kind"), "name") for c in ("functions", "classes")]
    g = both[0].unionByName(both[1]).groupBy("repo", "kind").agg(F.count("*").alias("names"), *convention_of("name"))
    return g.select("repo", "kind", "names", "snake", "camel", "pascal", named(F.col("names")).alias("convention"))


def architecture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of a repository show, its depth and its organisation."""
    low, p = F.lower("path"), F.col("path")
    folder = F.regexp_replace(low, r"/?[^/]*$", "")
    has = lambda c, *words: F.bool_or(F.lit(False) if not words else _any(c, words))
    top = lambda *names: F.bool_or(p.isin(*names))
    g = files(spark, sf_dir).groupBy("repo").agg(
        F.count("*").alias("files"), has(p, "app/", "src/").alias("app_folder"), has(folder, "test").alias("tests_folder"), has(low, "models.py", "model.py").alias("models_file"),
        has(p, "routes.py", "router.py", "routers/").alias("routes_file"), has(low, "schemas.py", "schema.py").alias("schemas_file"), has(low, "crud.py").alias("crud_file"),
        has(low, "config.py", "settings.py").alias("config_file"), has(low, "main.py").alias("main_file"), top("Dockerfile").alias("dockerfile"),
        top("docker-compose.yml", "docker-compose.yaml").alias("compose"), top("README.md").alias("readme"), top("requirements.txt").alias("requirements"), top("pyproject.toml").alias("pyproject"),
        top(".env.example", "env.example").alias("env_example"), F.max(F.size(F.split(p, "/"))).cast("bigint").alias("depth"), has(p, "domain/", "modules/").alias("domains"),
    )
    layered = F.col("app_folder") & (F.col("models_file") | F.col("routes_file"))
    return g.withColumn("organisation", F.when(layered & F.col("domains"), "domain-driven").when(layered, "layered").otherwise("flat")).drop("domains")


def _any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def architecture_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router-based, mvc, single-file or modular."""
    g = sources(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("files"), F.bool_or(_any(F.col("path"), ["routes", "routers"])).alias("r"), F.bool_or(F.col("path").contains("views")).alias("v"))
    return g.select("repo", "files", F.when(F.col("r"), "router-based").when(F.col("v"), "mvc").when(F.col("files") <= 3, "single-file").otherwise("modular").alias("kind"))


def endpoints(spark: SparkSession, sf_dir: str, pattern: str = ENDPOINT) -> DataFrame:
    """``(repo, verb, path)`` of every declared endpoint."""
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("verb"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("path"))
    return sources(spark, sf_dir).select("repo", F.explode(both).alias("e")).select("repo", F.upper("e.verb").alias("verb"), F.col("e.path").alias("path"))


def endpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with their verbs, and routes without one."""
    route = sources(spark, sf_dir).select("repo", F.explode(F.regexp_extract_all("content", F.lit(ROUTE), F.lit(1))).alias("path")).select("repo", F.concat(F.lit("ROUTE "), "path").alias("endpoint"))
    every = endpoints(spark, sf_dir).select("repo", F.concat_ws(" ", "verb", "path").alias("endpoint")).unionByName(route)
    return every.groupBy("repo", "endpoint").agg(F.count("*").alias("uses"))


def path_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters inside endpoint paths."""
    e = endpoints(spark, sf_dir, ENDPOINT_WIDE).select("repo", F.explode(F.regexp_extract_all("path", F.lit(r"\{([^}]+)\}"), F.lit(1))).alias("parameter"))
    return e.groupBy("repo", "parameter").agg(F.count("*").alias("uses"))


def api_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: endpoints by verb and what the sources of a repository use."""
    c, low = F.col("content"), F.lower("content")
    verbs = F.regexp_extract_all("content", F.lit(ENDPOINT), F.lit(1))
    paths = F.regexp_extract_all("content", F.lit(ENDPOINT), F.lit(2))
    per = sources(spark, sf_dir).select(
        "repo", F.transform(verbs, lambda v: F.lower(v)).alias("v"), F.exists(paths, lambda x: F.regexp_like(x, F.lit(r"\{[^}]+\}"))).alias("pp"), F.regexp_like(c, F.lit(r"Query\s*\(")).alias("q"), F.regexp_like(c, F.lit(r"Body\s*\(")).alias("b"),
        _any(low, ["skip", "limit", "page", "offset"]).alias("pagination"), _any(low, ["filter", "search", "query", "where"]).alias("filtering"), _any(low, ["sort", "order"]).alias("sorting"),
    )
    of = lambda verb: F.size(F.filter("v", lambda x: x == verb))
    counts = [F.sum(of(verb)).alias(f"{verb}_endpoints") for verb in VERBS]
    return per.groupBy("repo").agg(F.sum(F.size("v")).alias("endpoints"), *counts, F.bool_or("pp").alias("path_params"), F.bool_or("q").alias("query_params"), F.bool_or("b").alias("request_body"), F.bool_or("pagination").alias("pagination"), F.bool_or("filtering").alias("filtering"), F.bool_or("sorting").alias("sorting"))


def database_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database operations and model classes."""
    per = sources(spark, sf_dir).select("repo", *(F.regexp_like("content", F.lit(p)).alias(o) for o, p in DATABASE.items()), F.size(F.regexp_extract_all("content", F.lit(DATA_MODEL), F.lit(1))).alias("m"), _any(F.col("content"), ["session.add", "session.commit"]).alias("s"))
    return per.groupBy("repo").agg(*(F.count_if(o).alias(f"{o}_files") for o in DATABASE), F.sum("m").alias("models"), F.bool_or("s").alias("session"))


def framework_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameworks by words in code and file names, by dependency and by import."""
    low = F.lower("content")
    words = F.array_compact(F.array(*(F.when(_any(low, w) | F.lower("path").isin(*w), name) for name, w in FRAMEWORK_WORDS.items())))
    code = files(spark, sf_dir).where("ext in ('.py', '.toml', '.json')").select("repo", F.lit("words").alias("source"), F.explode(words).alias("framework"))
    deps = read_table(spark, sf_dir, "repo_analysis").select("repo", F.lit("dependency").alias("source"), F.explode("dependencies").alias("d")).select("repo", "source", F.lower(F.trim("d")).alias("framework")).where(F.col("framework").isin(*FRAMEWORK_PACKAGES) & F.col("repo").isNotNull())
    imports = listed(spark, sf_dir, "imports", "i").select("repo", F.lit("import").alias("source"), F.split(F.col("i"), r"\.")[0].alias("framework")).where(F.col("framework").isin(*FRAMEWORK_IMPORTS))
    return code.unionByName(deps).unionByName(imports).distinct()


def crud_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of create, read, update and delete a repository's endpoints and functions name."""
    names = listed(spark, sf_dir, "functions", "name").select("repo", "name").unionByName(endpoints(spark, sf_dir).select("repo", F.concat_ws(" ", "verb", "path").alias("name")))
    told = names.groupBy("repo").agg(*(F.bool_or(_any(F.lower("name"), w)).alias(f"has_{op}") for op, w in CRUD_WORDS.items()))
    every = files(spark, sf_dir).select("repo").distinct()
    return every.join(told, "repo", "left").select("repo", *(F.coalesce(f"has_{op}", F.lit(False)).alias(f"has_{op}") for op in CRUD_WORDS))


def crud_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"has_{op}"), op) for op in sorted(CRUD_WORDS)))), "-")
    return crud_flags(spark, sf_dir).withColumn("profile", F.when(profile == "", "none").otherwise(profile))


def crud_profile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of each CRUD profile, listed in rows and numbered."""
    rows = crud_profile(spark, sf_dir).select("profile", "repo")
    sizes = rows.groupBy("profile").agg(F.count("*").alias("repos"))
    return rows.join(F.broadcast(sizes), "profile")  # at most 16 profiles


def dependency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the three readers of dependency lists find in configuration files, with their first line."""
    told = files(spark, sf_dir).where("ext = '.toml'").select("file_id", "repo", F.posexplode(F.transform(lines_of(), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("line", "t")).where("t <> '' and not startswith(t, '#')")
    t = F.col("t")
    pinned, bare = F.regexp_like(t, F.lit("==|>=|~=|<=")), F.regexp_like(t, F.lit("^[A-Za-z0-9_.-]+$"))
    name = lambda c: F.regexp_replace(c, r"^[\s\"']+|[\s\"']+$", "")
    rest = F.when(t.contains("[") & t.contains("]"), F.regexp_replace(F.split(t, r"\[")[0], r"^\s+|\s+$", "")).when(t.contains(" = ") & t.contains('"'), name(F.split(t, "=")[0])).when(bare, t)
    cut_at = lambda signs: F.regexp_replace(F.split(t, signs, 2)[0], r"\s+$", "")
    rows = told.withColumns({"wide": F.when(pinned | t.contains(">"), cut_at("[=<>~]")).otherwise(rest), "plain": F.when(pinned, cut_at("[=<>~!]")).otherwise(rest), "lower": F.lower(cut_at("[=<>~!]"))})
    long = rows.select("file_id", "repo", "line", F.explode(F.create_map(F.lit("wide"), "wide", F.lit("plain"), "plain", F.lit("lower"), "lower")).alias("reader", "name")).where("name <> ''")
    return long.groupBy("file_id", "repo", "reader", "name").agg(F.min("line").alias("line"))


def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: code files and tests, by the two rules for tests."""
    low = F.lower("path")
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    code = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*CODE_EXTENSIONS)
    by_name, by_place = stem.contains("test"), base.startswith("test_") | base.endswith("_test.py") | low.contains("tests")
    return files(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("files"), F.count_if(code).alias("code_files"), F.count_if(code & by_name).alias("tests_by_stem"), F.count_if(by_place).alias("tests_by_place"))


def expected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose similarity is to be expected, and boilerplate."""
    blocks = read_table(spark, sf_dir, "code_block").where("block_id is not null").groupBy("block_id").agg(F.min("repo").alias("repo"), F.min("code").alias("code"))
    c = F.coalesce("code", F.lit(""))
    return blocks.select("block_id", _any(F.lower(c), EXPECTED).alias("pattern"), F.regexp_like(c, F.lit(EXPECTED_SIGNATURES)).alias("signature"), F.regexp_like(c, F.lit(BOILERPLATE)).alias("boilerplate"))


def file_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essential files of a repository, their number and those missing."""
    p = F.col("path")
    depth_one = F.regexp_extract(p, r"^([^/]+)/", 1)
    g = files(spark, sf_dir).groupBy("repo").agg(
        F.bool_or(p.isin("README.md", "README.rst", "README.txt", "README", "readme.md")).alias("readme"), F.bool_or(p == ".gitignore").alias("gitignore"),
        F.bool_or(p.isin("Dockerfile", "dockerfile", "docker/Dockerfile") | F.regexp_like(p, F.lit(r"^[^/]*\.Dockerfile$"))).alias("dockerfile"),
        F.bool_or(depth_one.isin("tests", "test", "Tests", "spec") | F.regexp_like(p, F.lit(r"(^|/)(test_[^/]*|[^/]*_test)\.py$"))).alias("tests"),
        F.bool_or(p.isin("requirements.txt", "pyproject.toml")).alias("requirements"),
    )
    names = {"readme": "README", "gitignore": ".gitignore", "dockerfile": "Dockerfile", "tests": "tests"}
    score = sum((F.col(c).cast("int") for c in (*names, "requirements")), F.lit(0))
    return g.withColumn("score", score).withColumn("missing", F.concat_ws(", ", *(F.when(~F.col(c), n) for c, n in names.items())))


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All, different, standard and foreign imports; as the job counts them, standard ones count with repetitions."""
    i = listed(spark, sf_dir, "imports", "i").select("repo", F.split(F.col("i"), r"\.")[0].alias("m")).where("m <> ''")
    g = i.groupBy("repo", "m").agg(F.count("*").alias("n")).groupBy("repo").agg(F.sum("n").alias("total"), F.count("*").alias("different"), F.coalesce(F.sum(F.when(F.col("m").isin(*STANDARD_MODULES), F.col("n"))), F.lit(0)).alias("standard"))
    return g.withColumn("third_party", F.col("different") - F.col("standard"))


def whitespace_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code without remarks and with single blanks, its hash, and its words."""
    flat = F.trim(F.regexp_replace(F.regexp_replace("content", r"(?m)#.*$", ""), r"\s+", " "))
    return sources(spark, sf_dir).withColumn("t", flat).select("file_id", F.md5("t").alias("form"), F.regexp_count("t", F.lit(r"\w+")).cast("bigint").alias("words"), F.size(F.filter(F.split("t", " "), lambda x: x != "")).cast("bigint").alias("parts"))


def untested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, path, file_id, words)``: the words of every source that is no test, after normalisation."""
    own = sources(spark, sf_dir).where(~F.lower("path").contains("test"))
    return own.select("repo", "path", "file_id", F.regexp_extract_all(normalized_code("content"), F.lit(r"(\w+)"), F.lit(1)).alias("words")).where(F.size("words") > 0)


def gram7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, h)``, the seven-word grams of a repository's sources in order of paths, the very last left out.

    Grams run over the ends of files: a file sees the first seven words of those after it (seven files hold them, since
    each has a word), so no repository's words ever come together in one row.
    """
    order = W.partitionBy("repo").orderBy("path", "file_id")
    told = untested_words(spark, sf_dir).withColumn("head", F.slice("words", 1, 7))
    after = F.slice(F.flatten(F.array(*(F.coalesce(F.lead("head", k).over(order), F.array().cast("array<string>")) for k in range(1, 8)))), 1, 7)
    told = told.withColumn("n", F.size("words")).withColumn("w", F.concat("words", after))
    starts = F.sequence(F.lit(1), F.least(F.col("n"), F.size("w") - 7))
    return told.where(F.size("w") >= 8).select("repo", F.explode(F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(F.col("w"), i, 7), " ")), 1, 8))).alias("h")).distinct()


def gram7_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram7(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("grams"), F.min("h").alias("least"))


def code_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a file's normalised code and of its first 5,000 words."""
    return sources(spark, sf_dir).withColumn("n", normalized_code("content")).select("file_id", F.md5("n").alias("code_hash"), F.md5(F.array_join(F.slice(F.regexp_extract_all("n", F.lit(r"(\w+)"), F.lit(1)), 1, 5000), " ")).alias("words_hash"))


def last_function_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every function name in a repository; of several the last one stays."""
    f = read_table(spark, sf_dir, "function_embedding").where("function_id is not null and name is not null and body_hash is not null")
    return f.groupBy("repo", "name").agg(F.max_by("body_hash", "function_id").alias("hash"))


def semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks, literals and error messages of a repository, all and different."""
    remarks = F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)#[ \t]*([^\n]+)$"), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    literals = F.filter(F.regexp_extract_all("content", F.lit(r"[\"']([^\"']{10,100})[\"']"), F.lit(1)), lambda x: ~F.regexp_like(x, F.lit(r"^(?:/|http|\{|<)")))
    messages = F.regexp_extract_all("content", F.lit(r"(?i)(?:detail|message|msg)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    long = sources(spark, sf_dir).select("repo", F.explode(F.create_map(F.lit("remark"), remarks, F.lit("literal"), literals, F.lit("message"), messages)).alias("kind", "vs")).select("repo", "kind", F.explode("vs").alias("v"))
    return long.groupBy("repo", "kind", "v").agg(F.count("*").alias("n")).groupBy("repo", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("different"), F.max(F.length("v")).cast("bigint").alias("longest"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled text a file is embedded by, capped by field."""
    t = read_table(spark, sf_dir, "file_embedding").where("file_id is not null").groupBy("file_id").agg(*(F.min(c).alias(c) for c in ("path", "imports", "functions", "classes", "line_count", "code_line_count", "docstring", "top_level_code")))
    label = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.array_join(F.slice(F.col(c), 1, 20), ", "), F.lit("")))
    maybe = lambda name, c, n: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(name), F.substring(c, 1, n)))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    text = F.concat_ws("\n", F.concat(F.lit("File: "), F.coalesce("path", F.lit(""))), label("Imports", "imports"), label("Functions", "functions"), label("Classes", "classes"), F.concat(F.lit("Lines: "), number("line_count"), F.lit(", Code lines: "), number("code_line_count")), maybe("Module documentation: ", "docstring", 500), maybe("Top-level code:\n", "top_level_code", 1000))
    return t.select("file_id", F.length(text).cast("bigint").alias("size"), F.md5(text).alias("digest"))


def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P50: the capped payload of a scan."""
    t = read_table(spark, sf_dir, "repo_analysis").where("scan_id is not null").groupBy("scan_id").agg(*(F.min(c).alias(c) for c in ("repo", "files", "frameworks", "dependencies", "readme_excerpt")))
    cap = lambda c, n: F.coalesce(F.array_join(F.slice(F.col(c), 1, n), "|"), F.lit(""))
    return t.select("scan_id", "repo", cap("files", 30).alias("files"), cap("frameworks", 20).alias("frameworks"), cap("dependencies", 50).alias("dependencies"), F.coalesce(F.substring("readme_excerpt", 1, 500), F.lit("")).alias("readme"))


def merged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all files of a repository put together, in order, repetitions and first places kept."""
    kinds = [listed(spark, sf_dir, c, "v").select("repo", F.lit(c).alias("kind"), "path", "pos", "v") for c in ("imports", "functions", "classes")]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy("repo", "kind", "v").agg(F.count("*").alias("uses"), F.min("path").alias("first_path"))


def hashed_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for text embeddings: signed counts of words by hash in 64 places, scaled to length 1."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)"), F.lit(1))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    code = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint")
    places = words.groupBy("doc_id", (code % 64).cast("int").alias("place")).agg(F.sum(F.when((code % 128) < 64, F.col("n")).otherwise(-F.col("n"))).alias("x")).where("x <> 0")
    norms = places.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return places.join(norms, "doc_id").select("doc_id", "place", F.round(F.col("x") / F.col("norm"), 6).alias("weight"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        style_profile, indentation_style, naming_profile, architecture_flags, architecture_kinds, endpoint_list, path_parameters, api_profile, database_operations, framework_detection, crud_profile, crud_profile_groups, dependency_lines,
        file_classes, expected_blocks, file_checklist, import_counts, whitespace_forms, gram7_sets, code_hashes, last_function_hashes, semantic_counts, embedding_texts, payload_projection, merged_features, hashed_word_vectors,
    )
}
