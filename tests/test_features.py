import ast

import pytest

from corpusloom.functions.json_repair import extracted, repaired
from corpusloom.functions.python_ast import features_of, neutral_identifiers, renamed, tree_outline
from corpusloom.operators.linkage import average_linkage_order
from corpusloom.operators.ranking import global_rank, min_max
from corpusloom.plans import features, pairs, reports

TEXT = '''import os.path
from a.b import c

class A(Base, x.Mixin):
    """Doc of A."""
    k: int = 3
    def m(self, q: int) -> list[str]:
        """A docstring of m."""
        try:
            return [z * 1.5 for z in q if z and q]
        except ValueError:
            yield

@deco.rator(1)
async def f(p):
    long = "a string that is long enough"
    return 404
'''


def values(kind, text=TEXT):
    return [v for k, v, _ in features_of(text) if k == kind]


def test_features_of_a_tree():
    assert values("import") == ["os", "a"] and values("import_path") == ["os.path", "a.b"]
    assert values("class") == ["A"] and values("base") == ["Base", "Mixin"] and values("class_def") == ["class A(Base, x.Mixin)"]
    assert values("method") == ["A.m"] and values("attribute") == ["A.k"] and sorted(values("function")) == ["f", "m"]
    assert set(values("signature")) == {"def m(self, q) -> list[str]", "def f(p)"} and values("return_hint") == ["list"]
    assert values("decorator") == ["rator"] and values("hinted") == ["m"] and values("docstring") == ["A docstring of m."]
    assert set(values("flag")) == {"async", "generators", "comprehensions"} and sorted(values("handler")) == ["ExceptHandler", "Try"]
    assert values("model") == ["A"] and set(values("variable")) == {"k", "z", "long"} and sorted(values("number")) == ["1.5", "3"]
    assert "a string that is long enough" in values("string") and features_of("def f(:") == features_of(None) == features_of("")
    assert {n for k, v, n in features_of(TEXT) if k == "function" and v == "m"} == {4}
    one, two = values("function_hash", "def f():\n    return 1  # x\n"), values("function_hash", "\ndef f():\n    return  1\n")
    assert one == two


def test_renaming():
    shape = lambda t: ast.dump(renamed(ast.parse(t)))
    assert shape("a = b + a") == shape("x = y + x") != shape("a = b + b")
    assert shape("print(17, 'short')") == shape("print(18, 'short')") != shape("print(200, 'short')")
    assert shape("def f(a): return a") != shape("def f(b): return b")  # arguments stay
    assert shape("def _f(): pass") != shape("def _g(): pass") and shape("def f(): pass") == shape("def g(): pass")
    assert neutral_identifiers("def add(first, b):\n    return first + b") == "def VAR1(VAR0, VAR2):\n    return VAR0 + VAR2"
    assert neutral_identifiers("    def m(self):\n        pass") == "    def m(self):\n        pass" and neutral_identifiers("1") == "1"
    assert tree_outline(ast.parse("a = 1")) == "Module\n Assign\n  Name\n   Store\n  Constant"


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('{"a": [1, 2,], }', '{"a": [1, 2]}'), ('{"a": {"b": [1', '{"a": {"b": [1]}}'), ('{"a": 1]}', '{"a": 1}'), ('{"a": "]}"}', '{"a": "]}"}'), ("", None), (None, None), ("no", None), ('{"a": 1}}', '{"a": 1}'), ("{", "{}")],
)
def test_json_repair(text, want):
    if text == '{"a": {"b": [1':  # brackets are appended before braces, as the job does
        assert repaired(text) == '{"a": {"b": [1]}}'
    else:
        assert repaired(text) == want


def test_json_extraction(spark):
    rows = ["```json\n{\"a\": 1}\n```", "see {x} and {y} end", " plain ", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(extracted("t")).collect()]
    assert got == ['{"a": 1}', "{x} and {y}", "plain", "", ""]


def test_average_linkage_order():
    near = {("a", "c"): 0.9, ("b", "d"): 0.8, ("a", "b"): 0.1}
    assert average_linkage_order(["d", "c", "b", "a"], near) == ["a", "c", "b", "d"]
    assert average_linkage_order([], {}) == [] and average_linkage_order(["x"], {}) == ["x"]
    with pytest.raises(ValueError, match="at most"):
        average_linkage_order([str(i) for i in range(2001)], {})


def test_average_linkage_merges_by_means():
    import numpy as np

    rng = np.random.default_rng(3)
    names = [f"n{i}" for i in range(9)]
    near = {(a, b): float(rng.random()) for i, a in enumerate(names) for b in names[i + 1 :]}
    groups = [[n] for n in names]
    while len(groups) > 1:
        mean = lambda x, y: np.mean([1 - near[min(a, b), max(a, b)] for a in x for b in y])
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda ij: mean(groups[ij[0]], groups[ij[1]]))
        a, b = groups[i], groups.pop(j)
        groups[i] = a + b if a[0] <= b[0] else b + a
    assert average_linkage_order(names, near) == groups[0]


def test_linkage_leaves_with_ties_and_parts():
    import random
    from fractions import Fraction
    from itertools import combinations

    from corpusloom.operators.linkage import linkage_leaves

    rng = random.Random(5)
    for _ in range(200):
        n, most = rng.randrange(12), rng.choice([1, 2, 1000])
        near = {p: rng.randint(0, most) / most for p in combinations(range(n), 2) if rng.random() < 0.4}
        groups = {i: [i] for i in range(n)}
        mean = lambda x, y: Fraction(sum(round(near.get((min(a, b), max(a, b)), 0) * 10**12) for a in x for b in y), len(x) * len(y))
        while len(groups) > 1:
            a, b = min(combinations(sorted(groups), 2), key=lambda p: (-mean(groups[p[0]], groups[p[1]]), p))
            groups[a] += groups.pop(b)
        assert linkage_leaves(n, [(a, b, s) for (a, b), s in near.items()]) == groups.get(0, [])


def test_linkage_order_of_more_than_a_picture_shows(spark, tmp_path):
    from pathlib import Path

    for table in Path("/root/testdata/sf0.001").iterdir():
        if table.name != "code_match.parquet":
            (tmp_path / table.name).symlink_to(table)
    match = spark.read.parquet("/root/testdata/sf0.001/code_match.parquet")
    more = match.limit(1).drop("match_id", "repo1", "repo2").crossJoin(spark.range(2100).selectExpr("id + 1000000 as match_id", "concat('r', id) as repo1", "concat('r', id + 1) as repo2"))
    match.unionByName(more).write.parquet(str(tmp_path / "code_match.parquet"))
    got = [(r["position"], r["repo"]) for r in reports.linkage_order(spark, str(tmp_path)).collect()]
    names = {n for r in pairs.matched_pairs(spark, str(tmp_path)).collect() for n in r}
    assert len(names) > 2100 and sorted(p for p, _ in got) == list(range(1, len(names) + 1)) and {n for _, n in got} == names


def test_global_rank_and_bounds(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, rng.randrange(50) / 10) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = [(r["id"], r["position"]) for r in global_rank(df, F.desc_nulls_last("v"), F.col("id")).collect()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted(got) == sorted((i, n) for n, (i, _) in enumerate(want, 1))
    scaled = {r["id"]: r["normalized"] for r in min_max(df, "v", F.col("v") > 1, 87, 99).collect()}
    low, high = min(v for _, v in rows if v and v > 1), max(v for _, v in rows if v)
    assert all(abs(scaled[i] - (0 if v is None or v <= 1 else round(87 + 12 * (v - low) / (high - low), 2))) < 0.0101 for i, v in rows)
    same = min_max(spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 0.5)], "id long, v double"), "v", F.col("v") > 1, 87, 99)
    assert {r["id"]: r["normalized"] for r in same.collect()} == {1: 99.0, 2: 99.0, 3: 0.0}


def test_queries_without_sql(spark):
    sf = "/root/testdata/sf0.001"
    files = {r["file_id"]: r["content"] for r in features.files(spark, sf).collect() if r["ext"] == ".json"}
    import json

    def state(t):
        try:
            return "empty" if not t.strip() else "valid" if json.loads(t) is not None or True else ""
        except ValueError:
            return "invalid"

    assert {r["file_id"]: r["state"] for r in reports.json_status(spark, sf).collect()} == {i: state(t) for i, t in files.items()}
    order = [r["repo"] for r in reports.linkage_order(spark, sf).orderBy("position").collect()]
    assert sorted(order) == sorted({n for r in pairs.matched_pairs(spark, sf).collect() for n in r})
    profile = {r["repo"]: r for r in reports.ast_profile(spark, sf).collect()}
    own: dict = {}
    for r in features.sources(spark, sf).collect():
        for kind, _, _ in features_of(r["content"]):
            own.setdefault(r["repo"], []).append(kind)
    assert {k: (v["functions"], v["classes"], v["handlers"]) for k, v in profile.items()} == {k: tuple(v.count(c) for c in ("function", "class", "handler")) for k, v in own.items()}
    assert reports.ast_features(spark, sf).count() > 0 and reports.shape_groups(spark, sf).where("blocks < 2").count() == 0
