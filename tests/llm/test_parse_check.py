import random
from functools import reduce

import pytest

from corpusloom.llm.js_grammar import check_javascript
from corpusloom.llm.parse_check import CODE, LEXERS, check_files, chunk_map, chunks_of, combine, parses, summarise

GOOD = ["", "a=1", "const {a,b:[c=2,...d]}=x;", "for(const a of b){a.push(1)}", "async()=>{await x}", "class A extends B{static #x=1;get y(){return 1} async *z(){yield* q}}", "a?.b?.[c]?.(d)", "`x${a+`y${b}`}z`", "/a[/]b/g.test(x)", "a/b/c", "if(a)/x/.test(b);else c", "export default function(){}", "import a,{b as c} from 'x'", "[a,b]=[b,a]", "({a,b=1}=c)", "a = b\n++c", "#!/usr/bin/env node\nx", "0x1F+1_000+.5e3+10n", "switch(a){case 1: break; default: x}", "const f = async x => await x;"]
BAD = ["const a;", "a b", "function if(a){}", "x = ", "{", "a)", "'abc", "`abc", "for(const a b){}", "return 1", "f(a,,b)", "<<<<<<< HEAD\na", "def f(x):\n  return 1", "1=2", "if a {}", "const a = ‘x’", "\0", "({a=1})", "break", "a = [1,2", "f() = 1"]


@pytest.mark.parametrize("text", GOOD)
def test_valid_javascript(text):
    assert check_javascript(text) is None


@pytest.mark.parametrize("text", BAD)
def test_invalid_javascript(text):
    assert check_javascript(text) is not None


def test_other_languages():
    assert parses(".py", "") and parses(".py", "@d\ndef f():\n    '''a\n    (b'''\n    return {1: [2]}\nif 1:\n    pass\nelse:\n    pass\n")
    assert not parses(".py", "def f(:\n    pass") and not parses(".py", "return 1\n") and not parses(".py", "x = (1\ny = 2\n") and not parses(".py", "a\0b") and parses(".py", "x = 1\r\ny = '''\r\n'''\r\n")
    assert parses(".json", '{"a": [1, "}"]}') and not parses(".json", "") and not parses(".json", '{"a": NaN}') and not parses(".json", '{"a": 1,}')
    assert parses(".toml", "a = 1\n[b]\nc = '''\n'x'\n'''\n") and not parses(".toml", "a = 1 2") and not parses(".toml", "a = 1\na = 2") and parses(".toml", "")


def test_maps_of_chunks_combine_in_any_grouping():
    rng = random.Random(7)
    for ext, lexer in LEXERS.items():
        for _ in range(150):
            text = "".join(rng.choice(["'", '"', '"""', "'''", "#", "\n", "(", ")", "[", "]", "{", "}", "\\", "/*", "*/", "//", "a ", "`"]) for _ in range(rng.randrange(40)))
            maps = [chunk_map(lexer, t, n == 0) for n, t in enumerate(chunks_of(text, rng.randrange(1, 12)))]
            left = reduce(combine, maps)
            k = rng.randrange(1, len(maps) + 1)
            if k < len(maps):
                assert combine(reduce(combine, maps[:k]), reduce(combine, maps[k:])) == left
            end, closers, openers, fits = summarise(lexer, text)
            if fits and left[CODE][3]:
                assert left[CODE][:3] == (end, closers, openers), (ext, text)


def test_files(spark, monkeypatch):
    import corpusloom.llm.parse_check as module

    monkeypatch.setattr(module, "ACROSS", 2000)
    long_good, long_bad = "x = [1, 2]\n" * 400, "x = [1, 2]\n" * 300 + "y = (\n" + "x = 1\n" * 100
    rows = [(1, "a.py", "x = 1"), (2, "b.PY", "x ="), (3, "c.md", "("), (4, "d.json", None), (5, "e.py", None), (6, "f.js", "a("), (6, "f.js", "a("), (None, "g.py", "("), (7, None, "("), (8, "h.py", long_good), (9, "i.py", long_bad), (10, "noext", "(")]
    got = {(r["file_id"], r["parses"]) for r in check_files(spark.createDataFrame([(*r, "q") for r in rows], "id long, path string, content string, ext string"), "id", "path", "content").collect()}
    assert got == {(1, True), (2, False), (4, False), (5, True), (6, False), (8, True), (9, False)}


SEEDS = {
    ".json": ['{"a": [1, 2, {"b": null}], "c": "x\\"y", "d": -1.5e3}', '[1, "a,b", {}, []]', '"x"', "{}", "[]"],
    ".toml": ['a = 1\n[b]\nc = "x"\n[[d]]\ne = [1,\n 2]\n[b.c]\nf = {x = 1, y = "q"}\n', 'x.y = 1\n"k" = \'v\'\ns = """a\nb"""\n# c\n', "[a]\n[b]\nk=1\n"],
    ".py": ['@d\ndef f(a, b=(1,2)):\n    """doc"""\n    return [a, b]\n\nclass A:\n    x = {1: "a"}\nif 1:\n    pass\nelse:\n    y = f"{x[1]}"\n', 'x = """a\n(b"""\ny = (1,\n 2)\nfor i in y: print(i)\nelse:\n  pass\nz = \'a\' \\\n  "b"\n', "from __future__ import annotations\nimport os\n"],
}


@pytest.mark.parametrize("ext", sorted(SEEDS))
def test_parts_agree_with_readers_of_whole_texts(ext):
    """Texts with a few signs lost, added or doubled."""
    import json
    import tomllib

    import corpusloom.llm.parse_check as module

    whole = {".json": lambda t: module._reads(lambda x: json.loads(x, parse_constant=module._no_constant), t), ".toml": lambda t: module._reads(tomllib.loads, t), ".py": module._compiles}[ext]
    rng = random.Random(5)
    for _ in range(3000):
        t = rng.choice(SEEDS[ext])
        for _ in range(rng.randrange(1, 4)):
            i, kind = rng.randrange(len(t) + 1), rng.random()
            t = t[:i] + t[i + 1 :] if kind < 0.4 else t[:i] + rng.choice("\"'[]{}(),:=\n #\\x1.f-@") + t[i:] if kind < 0.8 else t[:i] + t[i : i + 3] + t[i:]
        assert parses(ext, t) == whole(t), t
