import random

import numpy as np
import pandas as pd
import pytest

from corpusloom.functions.rolling import window_hashes
from corpusloom.operators.components import connected_components
from corpusloom.llm import provenance
from corpusloom.llm.provenance import BANDS, COUNTS, ROWS, SHINGLE, SIMILAR, _TOKEN, Tokens, _links, brief_of, evidence, least_values, shared_band, shingle_set, signature, tokens_of, unwritten_files, upper

SHAPE = "file_id long, repo string, path string, content string"
FORMS = ["{0} = {1}({2}, {3})", "if {0} > {3}:\n        {1} = {2}", "for {0} in {1}:\n        {2}.append({0})", "{0} = [{1} for {1} in {2} if {1}]", "assert {0}, '{1}'", "with open({0}) as {1}:\n        {2} = {1}.read()", "{0} = {{'{1}': {2}}}", "try:\n        {0} = int({1})\n    except ValueError:\n        {2} = None", "{0}.{1} += {3}", "while {0}:\n        {0} = {1} - {3}", "return {0} or {1}", "del {0}[{3}]"]


def _code(shape, names):
    """A file of hand-like code; files of one shape are equal once masked."""
    word = lambda: names.choice(["alpha", "beta", "gamma", "delta"]) + str(names.randrange(10**6))
    return "\n".join(f"def {word()}({word()}):\n" + "\n".join("    " + shape.choice(FORMS).format(word(), word(), word(), names.randrange(99)) for _ in range(6)) for _ in range(5))


def _reasons(spark, rows):
    return {r["file_id"]: r["reason"] for r in unwritten_files(spark.createDataFrame(rows, SHAPE), "file_id", "repo", "path", "content").collect()}


def test_families_within_a_repository(spark):
    names = random.Random(5)
    form = lambda n: _code(random.Random(n), names)
    rows = [(i, "r1", f"gen/x{i}.py", form(1)) for i in range(4)]  # no banner, nothing repeated inside a file
    rows += [(10, "r2", "api/a.py", "# Generated by tool. DO NOT EDIT!\n" + form(2)), (11, "r2", "api/b.py", form(2))]
    rows += [(20 + i, "r3", f"{d}/x.py", form(3)) for i, d in enumerate(("lib", "tools", "tests"))]  # scattered: coincidence
    rows += [(30, "r4", "lib/a.py", form(4)), (31, "r4", "lib/b.py", form(4))]  # two: coincidence
    rows += [(40 + i, f"q{i}", "t.py", "T = [" + ", ".join(str(names.randrange(9)) for _ in range(20)) + "]\n") for i in range(3)]
    assert _reasons(spark, rows) == {**{i: "tool" for i in range(4)}, 10: "tool", 11: "tool", **{40 + i: "data" for i in range(3)}}


def _sets(rng):
    """Groups of sets around one core: alike within a group, all of them in shared bands."""
    core = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = []
    for g in range(12):
        own = rng.integers(0, 2**64, 150, dtype=np.uint64)
        for k in range(3):
            sets.append(np.unique(np.concatenate((core, own, rng.integers(0, 2**64, 5 + 10 * k, dtype=np.uint64)))))
    order = rng.permutation(len(sets))
    return [sets[i] for i in order], [int(i) // 3 for i in order]


def test_every_pair_of_a_band_is_compared_exactly(spark):
    sets, groups = _sets(np.random.default_rng(4))
    rows = [(i, bytearray(signature(s).tobytes()), bytearray(shingle_set(s))) for i, s in enumerate(sets)]
    marks = spark.createDataFrame([(*r, r[1]) for r in rows] + [(*rows[0], rows[0][1]), (99, *rows[3][1:], rows[3][1])], "file_id long, raw binary, raw_set binary, raw_key binary")
    classes, links = _links(marks, "raw")
    joined = connected_components(links, "a", "b", "cls", "cluster")
    cluster = {r["file_id"]: r["c"] for r in classes.join(joined, "cls", "left").selectExpr("file_id", "coalesce(cluster, cls) c").distinct().collect()}
    got = [cluster[i] for i in range(36)]
    assert cluster[99] == got[3]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert all(jaccard(sets[i], sets[j]) < SIMILAR for i in range(36) for j in range(36) if groups[i] != groups[j])
    assert all((got[i] == got[j]) == (groups[i] == groups[j]) for i in range(36) for j in range(36))


@pytest.mark.parametrize("held", [30, 100])
def test_bands_go_on_over_batches(held):
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(50, 99, 60))
    same = bytes(ROWS * BANDS // 2) + bytes([0x99] * (COUNTS // 2))
    rows = pd.DataFrame({"band": [7] * 30 + [8] * 30, "cls": rng.permutation(60), "size": np.concatenate((sizes[::2], sizes[1::2])), "brief": [same] * 60, "n": held})
    want = {(min(a.cls, b.cls), max(a.cls, b.cls)) for a in rows.itertuples() for b in rows.itertuples() if a.cls != b.cls and a.band == b.band and min(a.size, b.size) >= SIMILAR * max(a.size, b.size)}
    for step in (1, 7, 60):
        got = pd.concat(list(shared_band(rows[i : i + step] for i in range(0, 60, step))))
        assert sorted(map(tuple, got[["a", "b"]].values.tolist())) == sorted(want)


def _shown(path, text):
    tokens = _TOKEN.findall(text)
    masked = Tokens().of(tokens)[1]
    return evidence(path, text, tokens, masked, window_hashes(masked, SHINGLE))


def test_banners_below_the_head():
    licence, code = "# All rights reserved by us.\n" * 30, "import os\n\ndef f(a):\n    return a\n"
    for text in (licence + "# Generated by tool. DO NOT EDIT!\n" + code, '"""A module."""\n# @generated\n' + code, code + "# Generated by tool 1.2. DO NOT EDIT!\n"):
        assert _shown("src/a.py", text) == "tool", text
    assert _shown("src/a.js", "'use strict';\n/*\n * @generated\n */\nfoo(1);\n") == "tool"
    assert _shown("src/a.py", "import os\n# Copyright (c) 2019 the foo authors\n" + code) == "vendored"
    for text in (code + "# generated ids are cached here\n", code + "    # @generated files are skipped\n", code + "# used to be generated by tool, now maintained by hand\n", "x = '\\n# DO NOT EDIT'\n", code + "# do not edit without telling the owners, reviewed by hand\n", code + "# see the licence https://x.example\n"):
        assert _shown("src/a.py", text) is None, text


def test_signatures_estimate_the_exact_similarity():
    """The cheap hash functions behave as independent ones: agreement and shared bands of pairs at 0.8."""
    rng = np.random.default_rng(8)
    agree, shared = [], 0
    for _ in range(400):
        core, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = signature(np.concatenate((core, a))), signature(np.concatenate((core, b)))
        agree.append((x == y).mean())
        shared += (x == y).reshape(BANDS, ROWS).all(1).any()
    assert abs(np.mean(agree) - 0.8) < 0.01 and np.std(agree) < 1.15 * (0.8 * 0.2 / (ROWS * BANDS)) ** 0.5
    assert shared == 400 and min(agree) >= 0.64


def test_few_pairs_below_the_threshold_are_verified(monkeypatch):
    """Pairs of 0.65 to 0.75 have signatures much like those of 0.8; the buckets tell them apart and lose no pair."""
    rng = np.random.default_rng(11)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    sets, want, other = [], set(), set()
    for k in range(300):
        core, own = fresh(150), (k % 3) * 9 + 16  # 0.82, 0.75 and 0.69
        (want if k % 3 == 0 else other).add((2 * k, 2 * k + 1))
        sets += [upper(np.concatenate((core, fresh(own)))) for _ in range(2)]
    briefs = brief_of(np.stack([signature(s.astype(np.uint64) << np.uint64(32)) for s in sets]), sets)
    rows = pd.DataFrame({"band": np.arange(600) // 2, "cls": np.arange(600), "size": [len(s) for s in sets], "brief": briefs, "n": 2})
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert all(jaccard(*p) >= SIMILAR for p in want) and all(0.65 < jaccard(*p) < 0.77 for p in other)
    got = set(map(tuple, pd.concat(list(shared_band(iter([rows]))))[["a", "b"]].values.tolist()))
    assert want <= got and len(got & other) < 0.3 * len(other)
    monkeypatch.setattr(provenance, "ROWS_HELD", 1)  # bands go on over batches
    parts = pd.concat(list(shared_band(rows[i : i + 7] for i in range(0, 600, 7))))
    assert set(map(tuple, parts[["a", "b"]].values.tolist())) == got
    whole = rows.assign(band=1, n=600).sort_values(["size", "cls"])
    assert want <= set(map(tuple, pd.concat(list(shared_band(whole[i : i + 50] for i in range(0, 600, 50))))[["a", "b"]].values.tolist()))


def test_values_of_many_sets_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [upper(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 40, 7, 300, 2, 2, 90)]
    want = [(s[:, None] * provenance._SEEDS[None]).min(0).tolist() for s in sets]
    for together in (1, 50, 1 << 14):
        monkeypatch.setattr(provenance, "TOGETHER", together)
        assert least_values(sets).tolist() == want


def test_tokens_of_blanks_and_ends():
    for text in ("", " \n ", "a", "a # b  ", "x = 'it''s'  \n\n", "`a\\`b` /* c */\t", "'open\n\"\"\"a\"\"\" é_1$ 1.5e3 ²// end "):
        assert tokens_of(text) == _TOKEN.findall(text)
    assert tokens_of("if (a1) { return 'b\\'' } // c ") == ["if", "(", "a1", ")", "{", "return", "'b\\''", "}", "// c "]
