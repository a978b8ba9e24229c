import random

import pytest

from corpusloom.llm import shared_spans as module
from corpusloom.llm.shared_spans import SuffixAutomaton, shared_pairs, shared_share, shared_spans


def brute(rows, min_len):
    texts = {i: t for i, g, t in rows if i is not None and t is not None}
    groups = {i: g for i, g, t in rows}
    grams = {i: {t[s : s + min_len] for s in range(len(t) - min_len + 1)} for i, t in texts.items()}
    pairs = {(a, b) for a in texts for b in texts if a < b and groups[a] != groups[b] and grams[a] & grams[b]}
    shares = {}
    for i, t in texts.items():
        others = set().union(*(grams[j] for j in texts if j != i)) if len(texts) > 1 else set()
        end = covered = 0
        for s in range(len(t) - min_len + 1):
            if t[s : s + min_len] in others:
                covered += s + min_len - max(s, end)
                end = s + min_len
        shares[i] = covered
    return pairs, shares


@pytest.mark.parametrize("block", [256, 3])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(5)
    alphabet = "ab cé\n(🙂"
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 140))) for _ in range(12)]
    rows = [(i, f"g{i % 7}", "".join(rng.choice(pool)[rng.randrange(9) :] for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    rows += [(100, "x", pool[0] * 3), (101, "y", pool[0] * 3), (101, "y", pool[0] * 3), (102, "y", pool[0] * 3), (103, "z", None), (None, "z", pool[1]), (104, "z", "")]
    df = spark.createDataFrame([(i, g, t, 1) for i, g, t in rows], "id long, grp string, text string, cls int")
    parts = shared_spans(df, "id", "text", ["grp"], min_len=50)
    pairs, shares = brute(rows, 50)
    assert {(r["id_a"], r["id_b"]) for r in shared_pairs(parts, min_len=50).collect()} == pairs
    assert {r["id"]: r["shared_chars"] for r in shared_share(parts, min_len=50).collect()} == shares
    marked = shared_spans(df, "id", "text", min_len=50, pairs=False)
    assert {r["id"]: r["shared_chars"] for r in shared_share(marked, min_len=50).collect()} == shares


def test_empty(spark):
    parts = shared_spans(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert shared_pairs(parts).collect() == [] and shared_share(parts).collect() == []


def test_automaton_knows_every_substring_and_its_owners():
    rng, words = random.Random(1), ["abcab", "bcabc", "aab", "", "abcab"]
    automaton = SuffixAutomaton()
    for n, w in enumerate(words):
        automaton.add(list(w), 1 << n)
    for _ in range(300):
        s = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        state = 0
        for c in s:
            state = automaton.next[state].get(c)
            if state is None:
                break
        want = sum(1 << n for n, w in enumerate(words) if "".join(s) in w)
        assert (automaton.mask[state] if state is not None else 0) == want
