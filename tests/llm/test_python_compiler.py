import pytest

from corpusloom.llm.parse_check import parses

BAD = ["def f():\n break\n", "if x:\n return 1\n", "def f(a, a): pass", "class A:\n yield 1", "def f():\n x = 1\n global x\n", "x = 1\nglobal x\n", "if x:\n y = 1\n global y\n", "x = 1\nfrom __future__ import annotations\n", "def f():\n nonlocal x\n", "def f():\n import_ = 1\n await g()\n", "for a in b:\n pass\nelse:\n continue\n"]
GOOD = ["def f():\n for a in b:\n  break\n", "def f():\n global x\n x = 1\n", "from __future__ import annotations\nx = 1\n", "global x\nx = 1\n", "class A:\n def f(self):\n  yield 1\n", "async def f():\n await g()\n", "@a\ndef f(): return 1\n"]


@pytest.mark.parametrize("text", BAD + GOOD)
def test_agrees_with_the_compiler(text):
    try:
        compile(text, "x", "exec", dont_inherit=True)
    except SyntaxError:
        assert text in BAD and not parses(".py", text)
    else:
        assert text in GOOD and parses(".py", text)
