import numpy as np

from corpusloom.llm.knn import nearest_vectors, walk_cells


def brute(rows, k=5, dim=64):
    usable = {}
    for level, i, v in rows:
        if i is not None and v is not None and len(v) == dim and any(v) and all(x is not None for x in v):
            usable.setdefault(level, {})[i] = np.array(v, float) / np.linalg.norm(v)
    out = set()
    for level, own in usable.items():
        ids = sorted(own)
        for a in ids:
            near = sorted((-round(float(own[a] @ own[b]), 6), b) for b in ids if b != a)[:k]
            out |= {(level, a, b) for _, b in near}
    return out


def test_matches_brute_force_with_copies_and_dirt(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    rows = [("function", i, (centres[i % 12] + 0.2 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [("file", i, (centres[i % 3] + 0.2 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(40)]
    rows += [("function", 1000 + i, rows[0][2]) for i in range(60)]  # a hot group of equal vectors
    rows += [("function", 5000, None), ("function", 5001, [0.0] * 64), ("function", 5002, [1.0] * 32), ("function", None, rows[1][2]), rows[3], rows[3], ("file", 900, [None] * 64)]
    df = spark.createDataFrame(rows, "level string, id long, v array<float>")
    got = {(r["level"], r["id"], r["neighbour"]) for r in nearest_vectors(df, "level", "id", "v").collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert nearest_vectors(spark.createDataFrame([], "level string, id long, v array<float>"), "level", "id", "v").collect() == []


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.random(9), rng.random(9), rng.integers(0, 3, (9, 9))
    got = [a[i] + b[j] for i, j in walk_cells(a, b, sizes, 10**9)]
    assert got == sorted(got) and len(got) == (sizes > 0).sum()


def test_dense_cells_have_an_index_of_their_own(spark):
    """Two thirds of the vectors are in one tight cloud: its queries meet a part of it, and recall stays."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    rows = [("file", i, (centre + 0.05 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(2000)]
    rows += [("file", 5000 + i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "level string, id long, v array<float>")
    got = {(r["level"], r["id"], r["neighbour"]) for r in nearest_vectors(df, "level", "id", "v", codes=2, dense=400, candidates=1500).collect()}
    want = brute(rows)
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
