import difflib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from corpusloom.operators.blocks import blocks_of, distinct_blocks, near_copies, normalized_code
from corpusloom.operators.setsim import jaccard_classes, linked_entities
from corpusloom.plans import reference
from corpusloom.sources.files import read_submissions, read_trees, require_columns

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) & set(reference.ORACLE)))
def test_same_rows_as_sql(spark, name):
    got = reference.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in sorted(f.stem for f in Path(SF).glob("*.parquet")):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    text = reference.ORACLE[name]
    columns = sorted(db.sql(text).columns)
    assert sorted(got.columns) == columns
    rnd = lambda v: round(float(v), 5) if isinstance(v, float) else v
    want = sorted(repr(tuple(map(rnd, r))) for r in db.sql(f"select {', '.join(columns)} from ({text})").fetchall())
    assert sorted(repr(tuple(rnd(r[c]) for c in columns)) for r in got.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_set_join_is_exact(spark):
    import random

    rng = random.Random(4)
    rows = [(e, rng.randrange(12)) for e in range(40) for _ in range(rng.randrange(1, 7))] + [(None, 1), (3, None), (90, 1), (91, 1), (92, 1)]
    sets = {}
    for e, v in rows:
        if e is not None and v is not None:
            sets.setdefault(e, set()).add(v)
    for t in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        pairs, owners = jaccard_classes(spark.createDataFrame(rows, "e long, v long"), "e", "v", t)
        cls = {r["e"]: r["c"] for r in owners.collect()}
        assert cls == {e: min(x for x in sets if sets[x] == sets[e]) for e in sets}
        linked = {(r["a"], r["b"]) for r in pairs.collect()}
        assert {(a, b) for a in sets for b in sets if a != b and (cls[a] == cls[b] or (cls[a], cls[b]) in linked or (cls[b], cls[a]) in linked)} == want
        links = {r["e"]: (r["c"], r["links"]) for r in linked_entities(pairs, owners).collect()}
        assert links == {e: (cls[e], sum(a == e for a, _ in want)) for e in sets}


def test_blocks_and_normalisation(spark):
    code = "def f(a):\n    # note\n    x = 1\n    for b in a:\n        if b and x:\n            x += g(b)\n    return x\n"
    kind, name, _, start, end, complexity, calls, signature, _, shape, outline = blocks_of(code)[0]
    assert (kind, name, start, end, complexity, calls, signature) == ("function", "f", 1, 7, 4, "g", "f(a)")
    assert blocks_of(code.replace("x", "y"))[0][-2:] == (shape, outline) and blocks_of(code.replace("b and x", "b or x"))[0][-2] != shape
    assert blocks_of("def f(:\n1\n2\n3\n4\n")[0][0] == "segment" and blocks_of("") == []
    df = spark.createDataFrame([(code + '"""d\n"""',)], "c string").select(normalized_code("c").alias("n"))
    assert df.first()["n"].split("\n") == ["def f(a):", "x = 1", "for b in a:", "if b and x:", "x += g(b)", "return x"]


def test_near_copies(spark):
    a = "\n".join(f"line_{i} = call_{i}(x)" for i in range(9))
    b = a.replace("line_4", "other")
    shape = "def total({0}, {1}):\n    {2} = 0\n    for {3} in {0}:\n        if {3} > {1}:\n            {2} += {3} * 17\n    return {2}"
    c, d = shape.format("items", "limit", "amount", "entry"), shape.format("rows", "bound", "amount", "one")
    boiler = c.replace("return", "raise HTTPException or")
    rows = [(1, "r", a), (2, "s", b), (3, "s", a), (4, "t", None), (5, "t", ""), (1, "r", a), (6, "r", c), (7, "s", d), (8, "q", boiler), (9, "s", c.replace("17", "18"))]
    df = spark.createDataFrame(rows, "id long, repo string, code string")
    got = {(r["id_a"], r["id_b"]): (r["similarity"], r["match_type"]) for r in near_copies(df, "id", "repo", "code").collect()}
    ratio = lambda x, y: round(difflib.SequenceMatcher(None, x, y).ratio(), 6)
    assert got[1, 2] == (ratio(a, b), "near_exact") and got[6, 7][1] == "structural" and got[6, 7][0] >= 0.85 and got[6, 9][1] == "near_exact"
    assert (7, 9) not in got and set(got) == {(1, 2), (6, 7), (6, 9)}  # 7 and 9 are of one repository, 8 is boilerplate
    assert {(r["id"], r["t"]) for r in distinct_blocks(df, "id", "repo", "code").collect()} == {(1, 1), (2, 2), (3, 1), (6, 6), (7, 7), (9, 9)}


def test_bound_of_the_ratio():
    import random

    from corpusloom.operators.blocks import may_match, string_ratio

    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice("abc \n") for _ in range(rng.randrange(90)))
        y = "".join(rng.choice([c, c, c, "d", c + "e", ""]) for c in x)[rng.randrange(5) :]
        row = [0] * (len(y) + 1)
        for c in x:
            old, row = row, [0]
            for j, d in enumerate(y):
                row.append(old[j] + 1 if c == d else max(old[j + 1], row[j]))
        assert may_match(x, y, row[-1]) and not may_match(x, y, row[-1] + 1)
        want = difflib.SequenceMatcher(None, x, y).ratio()
        assert string_ratio(x, y, 0.7) in ((want,) if want >= 0.7 else (want, 0.0)) and string_ratio(x, y) == want


@pytest.mark.parametrize(("threshold", "together", "pairs_from", "singles_from"), [(0.65, 3, 64, 256), (0.4, 1, 64, 256), (0.65, 3, 6, 12), (0.4, 3, 9, 15)])
def test_alike_classes_against_all_pairs(spark, monkeypatch, threshold, together, pairs_from, singles_from):
    import random

    from corpusloom.operators import setsim

    monkeypatch.setattr(setsim, "PAIRS_FROM", pairs_from)
    monkeypatch.setattr(setsim, "SINGLES_FROM", singles_from)
    rng = random.Random(2)
    sets: dict[int, set] = {}
    for i in range(300):  # few distinct elements, some very frequent
        own = {min(int(rng.expovariate(0.08)), 60) for _ in range(rng.randrange(1, 25))}
        if sets and rng.random() < 0.6:
            own = sets[rng.randrange(i)] ^ {min(int(rng.expovariate(0.08)), 60) for _ in range(rng.randrange(4))}
        sets[i] = own
    first: dict[frozenset, int] = {}
    for i, own in sets.items():
        first.setdefault(frozenset(own), i)
    classes = [(c, own) for own, c in first.items() if own]
    want = sorted((a, b) for a, x in classes for b, y in classes if a < b and len(x & y) / len(x | y) >= threshold)
    pairs, owners = setsim.alike_classes(spark.createDataFrame([(i, str(v)) for i, own in sets.items() for v in own], "e long, v string"), "e", "v", threshold, together)
    assert want and sorted(map(tuple, pairs.collect())) == want
    assert {tuple(r) for r in owners.collect()} == {(i, first[frozenset(own)]) for i, own in sets.items() if own}


def test_near_copies_of_nothing(spark):
    assert near_copies(spark.createDataFrame([], "id long, repo string, code string"), "id", "repo", "code").collect() == []


def test_sources(spark, tmp_path):
    (tmp_path / "one/repo/src").mkdir(parents=True)
    (tmp_path / "two/node_modules").mkdir(parents=True)
    (tmp_path / "one/repo/src/a.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "two/b.js").write_text("y")
    (tmp_path / "two/node_modules/c.js").write_text("z")
    got = {(r["repo"], r["path"], r["ext"]) for r in read_trees(spark, str(tmp_path)).collect()}
    assert got == {("one", "src/a.py", ".py"), ("two", "b.js", ".js")}
    table = tmp_path / "s.csv"
    table.write_text('name , Email Address,GitHub Repo\n" Ann ",a@x.y,\n,,\n"B, C",,http://z/q\n')
    assert {tuple(r) for r in read_submissions(spark, str(table)).collect()} == {("Ann", "a@x.y", None), ("B, C", None, "http://z/q")}
    with pytest.raises(ValueError, match="score"):
        require_columns(spark.range(1), "id", "score")
