import random

from corpusloom.operators.components import connected_components


def expected(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "l long, r long, component string")
    return {r["vertex"]: r["component"] for r in connected_components(df, "l", "r").collect()}


def test_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (2, None), (7, 7), (3, 4), (4, 3), (3, 4)]
    assert run(spark, pairs) == expected(pairs)


def test_long_chain_and_hub(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1000, 1001 + i) for i in range(50)]
    assert run(spark, pairs) == expected(pairs)


def test_empty(spark):
    assert run(spark, []) == {}
