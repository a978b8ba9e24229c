"""Validity of JavaScript text: a tokenizer and a grammar of its statements and expressions.

The grammar is local: a statement is checked on the kinds of its tokens alone, so the verdict for a sequence of kinds
is remembered and statements of a form seen before are skipped.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\v\f\xa0﻿  \r\n]+)|(?P<com>//[^\n\r]*|/\*(?s:.*?)\*/|<!--[^\n\r]*)
    |(?P<id>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4}|‌|‍)*)
    |(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[oO][0-7]+(?:_[0-7]+)*|0[bB][01]+(?:_[01]+)*|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?)n?)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])
    |(?P<tpl>`)""",
    re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([a-z]*)(?![\w$])")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
SOFT = frozenset("let static async of get set await yield from as".split())
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split()) | frozenset("( [ { } ; , < > <= >= == != === !== + - * % & | ^ ! ~ && || ?? ? : = += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= => << >> >>> ** ... T{".split())
_CLOSER = {"(": ")", "[": "]", "{": "}", "T{": "}"}


class Invalid(Exception):
    """The text is not valid JavaScript."""


def tokens_of(text: str) -> tuple[list[str], list[bool], list[int]]:
    """Kinds of the tokens, whether a line break stands before each, and the index of each bracket's partner.

    Kinds: ``I`` identifier, ``#`` private name, ``N`` number, ``S`` string, ``R`` regular expression, ``T`` template
    without parts, ``T{`` and ``}T`` its parts, else the token itself. Raises ``Invalid`` for what is no token and for
    brackets that don't pair.
    """
    kinds: list[str] = []
    breaks: list[bool] = []
    match: list[int] = []
    stack: list[int] = []
    pos, size, newline = (text.find("\n") if text.startswith("#!") else 0), len(text), False
    if pos < 0:
        return kinds, breaks, match
    scan, push, add, put = _TOKEN.match, kinds.append, breaks.append, match.append

    def template(at: int) -> tuple[int, bool]:
        at = _TEMPLATE.match(text, at).end()
        if at >= size:
            raise Invalid("template not closed")
        return (at + 1, True) if text[at] == "`" else (at + 2, False)

    while pos < size:
        m = scan(text, pos)
        if m is None:
            raise Invalid("no token")
        what, end = m.lastgroup, m.end()
        if what == "ws":
            piece = m.group()
            newline = newline or "\n" in piece or "\r" in piece or " " in piece or " " in piece
            pos = end
            continue
        if what == "com":
            newline = newline or "\n" in m.group()
            pos = end
            continue
        if what == "punct":
            kind = m.group()
            if kind[0] == "/":
                prev = kinds[-1] if kinds else ";"
                if prev in _BEFORE_REGEX or (prev == ")" and _after_head(kinds, match)):
                    r = _REGEX.match(text, pos)
                    if r is None:
                        raise Invalid("regular expression not closed")
                    if len(set(r.group(1))) != len(r.group(1)) or set(r.group(1)) - set("dgimsuvy"):
                        raise Invalid("flags")
                    push("R"), add(newline), put(-1)
                    pos, newline = r.end(), False
                    continue
            if kind in "([{":
                stack.append(len(kinds))
                put(-1)
            elif kind in ")]}":
                if not stack or _CLOSER[kinds[stack[-1]]] != kind:
                    raise Invalid("bracket")
                opener = stack.pop()
                match[opener] = len(kinds)
                put(opener)
                if kinds[opener] == "T{":
                    push("}T"), add(newline)
                    pos, closed = template(end)
                    newline = False
                    if not closed:
                        stack.append(len(kinds))
                        push("T{"), add(False), put(-1)
                    continue
            else:
                put(-1)
            push(kind)
        elif what == "id":
            word = m.group()
            push(word if word in RESERVED or word in SOFT else "#" if word[0] == "#" else "I")
            put(-1)
        elif what == "num":
            digits = m.group()
            if end < size and (text[end].isalnum() or text[end] in "_$"):
                raise Invalid("number")
            if digits[-1] == "n" and ("." in digits or "e" in digits.lower().replace("0x", "") and not digits.lower().startswith("0x")):
                raise Invalid("number")
            push("N"), put(-1)
        elif what == "str":
            push("S"), put(-1)
        else:
            end, closed = template(end)
            if closed:
                push("T"), put(-1)
            else:
                stack.append(len(kinds))
                push("T{"), put(-1)
        add(newline)
        newline, pos = False, end
    if stack:
        raise Invalid("bracket not closed")
    return kinds, breaks, match


def _after_head(kinds: list[str], match: list[int]) -> bool:
    """The last ``)`` closes the head of if, for, while or with."""
    opener = match[-1]
    return opener > 0 and kinds[opener - 1] in ("if", "for", "while", "with")


_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_UNARY = frozenset("! ~ + - typeof void delete".split())
_SIMPLE = frozenset(["I", "N", "S", "R", "T", "this", "null", "true", "false", "super"])
#: What an expression turned out to be: a place to assign to, a literal that may be a pattern, a chain, else a value.
PLACE, PATTERN, VALUE, ARROW = "place", "pattern", "value", "arrow"
_SEEN: dict[tuple, bool] = {}


class _Parser:
    def __init__(self, text: str) -> None:
        self.k, self.nl, self.match = tokens_of(text)
        self.k += ["end"] * 3
        self.nl += [True] * 3
        self.keyed = ["\n" + k if n else k for k, n in zip(self.k, self.nl, strict=True)]
        self.p = 0
        self.fn = self.is_async = self.gen = self.loop = self.switch = False
        self.labels = 0

    def fail(self, why: str = "") -> None:
        raise Invalid(f"{why} at token {self.p}: {self.k[self.p]}")

    def need(self, kind: str) -> None:
        if self.k[self.p] != kind:
            self.fail(f"{kind} expected")
        self.p += 1

    def take(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def is_name(self, kind: str) -> bool:
        return kind == "I" or (kind in SOFT and not (kind == "await" and self.is_async) and not (kind == "yield" and self.gen))

    def name(self) -> None:
        if not self.is_name(self.k[self.p]):
            self.fail("name expected")
        self.p += 1

    def end_statement(self) -> None:
        kind = self.k[self.p]
        if kind == ";":
            self.p += 1
        elif kind not in ("}", "}T", "end") and not self.nl[self.p]:
            self.fail("end of statement expected")

    def program(self) -> None:
        while self.k[self.p] != "end":
            self.statement(top=True)

    def _guess(self) -> int:
        """Where the statement at hand probably ends (index after it), 0 if that is not plain to see."""
        at, k, match = self.p, self.k, self.match
        if k[at] == "function" or (k[at] == "async" and k[at + 1] == "function"):
            while k[at] not in ("{", "end", ";"):
                at = match[at] if k[at] == "(" and match[at] > 0 else at
                at += 1
            return match[at] + 1 if k[at] == "{" else 0
        while True:
            kind = k[at]
            if kind == ";":
                return at + 1
            if kind in ("(", "[", "{", "T{"):
                at = match[at]
            elif kind in ("}", "end"):
                return 0
            at += 1

    def statement(self, top: bool = False) -> None:
        begin, kind = self.p, self.k[self.p]
        end = self._guess() if kind not in ("if", "for", "while", "do", "try", "switch", "{", "class", "with") else 0
        key = (top, self.fn, self.is_async, self.gen, self.loop, self.switch, *self.keyed[begin:end], self.k[end]) if end and not self.labels else None
        if key is not None and key in _SEEN:
            self.p = end
            return
        self._statement(top)
        if key is not None and self.p == end:
            if len(_SEEN) > 200_000:
                _SEEN.clear()
            _SEEN[key] = True

    def _statement(self, top: bool) -> None:
        k, p = self.k, self.p
        kind, nxt = k[p], k[p + 1]
        if kind == "{":
            self.block()
        elif kind == ";":
            self.p += 1
        elif kind in ("var", "const") or (kind == "let" and (self.is_name(nxt) or nxt in ("[", "{"))):
            self.p += 1
            self.declarations(kind)
            self.end_statement()
        elif kind == "function":
            self.p += 1
            self.function(named=True)
        elif kind == "async" and nxt == "function" and not self.nl[p + 1]:
            self.p += 2
            self.function(named=True, is_async=True)
        elif kind == "class":
            self.klass(named=True)
        elif kind == "if":
            self.p += 1
            self.head()
            self.inner()
            if self.take("else"):
                self.inner()
        elif kind == "for":
            self.for_loop()
        elif kind in ("while", "with"):
            self.p += 1
            self.head()
            self.inner(loop=kind == "while")
        elif kind == "do":
            self.p += 1
            self.inner(loop=True)
            self.need("while")
            self.head()
            self.take(";")
        elif kind in ("break", "continue"):
            self.p += 1
            if not self.nl[self.p] and self.is_name(k[self.p]):
                if not self.labels:
                    self.fail("label")
                self.p += 1
            elif not (self.loop or (kind == "break" and self.switch)):
                self.fail("outside a loop")
            self.end_statement()
        elif kind == "return":
            if not self.fn:
                self.fail("outside a function")
            self.p += 1
            if k[self.p] not in (";", "}", "end") and not self.nl[self.p]:
                self.expression()
            self.end_statement()
        elif kind == "throw":
            self.p += 1
            if self.nl[self.p]:
                self.fail("line break")
            self.expression()
            self.end_statement()
        elif kind == "try":
            self.p += 1
            self.block()
            caught = self.take("catch")
            if caught:
                if self.take("("):
                    self.target()
                    self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif not caught:
                self.fail("catch expected")
        elif kind == "switch":
            self.p += 1
            self.head()
            self.need("{")
            kept, self.switch, default = self.switch, True, False
            while not self.take("}"):
                if self.take("default"):
                    if default:
                        self.fail("second default")
                    default = True
                else:
                    self.need("case")
                    self.expression()
                self.need(":")
                while k[self.p] not in ("case", "default", "}"):
                    self.statement()
            self.switch = kept
        elif kind == "debugger":
            self.p += 1
            self.end_statement()
        elif kind == "import" and nxt not in ("(", "."):
            self.module_import(top)
        elif kind == "export":
            self.module_export(top)
        elif self.is_name(kind) and nxt == ":":
            self.p += 2
            self.labels += 1
            self.statement()
            self.labels -= 1
        else:
            self.expression()
            self.end_statement()

    def inner(self, loop: bool | None = None) -> None:
        """The statement under if, else or a loop: no declaration."""
        if self.k[self.p] in ("const", "class") or (self.k[self.p] == "let" and self.k[self.p + 1] == "["):
            self.fail("declaration")
        kept = self.loop
        self.loop = self.loop or bool(loop)
        self.statement()
        self.loop = kept

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.k[self.p] == "end":
                self.fail("} expected")
            self.statement()

    def head(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def declarations(self, kind: str, in_for: bool = False) -> None:
        while True:
            pattern = self.target()
            if self.take("="):
                self.assignment(no_in=in_for)
            elif (pattern or kind == "const") and not (in_for and self.k[self.p] in ("of", "in")):
                self.fail("value expected")
            if not self.take(","):
                return

    def target(self) -> bool:
        """A name or a pattern of a binding; tells whether it was a pattern."""
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.target()
                if not rest and self.take("="):
                    self.assignment()
                if self.k[self.p] != "]":
                    if rest:
                        self.fail("rest must be last")
                    self.need(",")
            return True
        if self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.name()
                elif self.is_name(self.k[self.p]) and self.k[self.p + 1] in (",", "}", "="):
                    self.p += 1
                    if self.take("="):
                        self.assignment()
                else:
                    self.property_name()
                    self.need(":")
                    self.target()
                    if self.take("="):
                        self.assignment()
                if self.k[self.p] != "}":
                    self.need(",")
            return True
        self.name()
        return False

    def for_loop(self) -> None:
        self.p += 1
        waits = self.k[self.p] == "await" and self.is_async
        self.p += waits
        self.need("(")
        kind, nxt = self.k[self.p], self.k[self.p + 1]
        if not self.take(";"):
            if kind in ("var", "const") or (kind == "let" and (self.is_name(nxt) or nxt in ("[", "{"))):
                self.p += 1
                self.declarations(kind, in_for=True)
                place = True
            else:
                place = self.expression(no_in=True) in (PLACE, PATTERN)
            if self.k[self.p] in ("of", "in"):
                if not place:
                    self.fail("place expected")
                of = self.k[self.p] == "of"
                self.p += 1
                self.assignment() if of else self.expression()
                self.need(")")
                self.inner(loop=True)
                return
            if waits:
                self.fail("of expected")
            self.need(";")
        if self.k[self.p] != ";":
            self.expression()
        self.need(";")
        if self.k[self.p] != ")":
            self.expression()
        self.need(")")
        self.inner(loop=True)

    def function(self, named: bool, is_async: bool = False, method: bool = False) -> None:
        gen = False if method else self.take("*")
        if not method:
            if named:
                self.name()
            elif self.is_name(self.k[self.p]):
                self.p += 1
        self.body(is_async, gen)

    def body(self, is_async: bool, gen: bool, arrow: bool = False) -> None:
        kept = self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels
        self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels = True, is_async, gen, False, False, 0
        if not arrow:
            self.need("(")
            while not self.take(")"):
                rest = self.take("...")
                self.target()
                if not rest and self.take("="):
                    self.assignment()
                if self.k[self.p] != ")":
                    if rest:
                        self.fail("rest must be last")
                    self.need(",")
        self.block()
        self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels = kept

    def klass(self, named: bool) -> None:
        self.need("class")
        if self.is_name(self.k[self.p]):
            self.p += 1
        elif named:
            self.fail("name expected")
        if self.take("extends"):
            self.postfix()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.k[self.p] == "static" and self.k[self.p + 1] not in ("(", "=", ";", "}"):
                self.p += 1
                if self.k[self.p] == "{":
                    self.block()
                    continue
            self.member(in_class=True)

    def property_name(self) -> None:
        kind = self.k[self.p]
        if kind == "[":
            self.p += 1
            self.assignment()
            self.need("]")
        elif kind in ("S", "N", "I", "#") or kind in RESERVED or kind in SOFT:
            self.p += 1
        else:
            self.fail("property name expected")

    def member(self, in_class: bool) -> bool:
        """A member of a class or an object literal; tells whether it could stand in a pattern."""
        k, plain = self.k, ("(", "=", ";", "}", ",", ":")
        is_async = gen = False
        if k[self.p] == "async" and k[self.p + 1] not in plain and not self.nl[self.p + 1]:
            is_async = True
            self.p += 1
        if self.take("*"):
            gen = True
        accessor = not is_async and not gen and k[self.p] in ("get", "set") and k[self.p + 1] not in plain and not (in_class and self.nl[self.p + 1])
        self.p += accessor
        first = k[self.p]
        self.property_name()
        if k[self.p] == "(":
            self.body(is_async, gen)
            return False
        if accessor or is_async or gen:
            self.fail("( expected")
        if in_class:
            if self.take("="):
                kept = self.fn
                self.assignment()
                self.fn = kept
            self.end_statement()
            return False
        if self.take(":"):
            return self.assignment() in (PLACE, PATTERN, "default")
        if not self.is_name(first):
            self.fail(": expected")
        if self.take("="):  # only right in a pattern
            self.assignment()
            self.cover = True
        return True

    cover = False

    def module_import(self, top: bool) -> None:
        if not top:
            self.fail("import inside")
        self.p += 1
        if not self.take("S"):
            if self.is_name(self.k[self.p]):
                self.p += 1
                if not self.take(","):
                    self.need("from")
                    self.need("S")
                    self.end_statement()
                    return
            if self.take("*"):
                self.need("as")
                self.name()
            else:
                self.names()
            self.need("from")
            self.need("S")
        self.end_statement()

    def names(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("as"):
                self.property_name()
            if self.k[self.p] != "}":
                self.need(",")

    def module_export(self, top: bool) -> None:
        if not top:
            self.fail("export inside")
        self.p += 1
        if self.take("default"):
            kind = self.k[self.p]
            if kind == "function" or (kind == "async" and self.k[self.p + 1] == "function"):
                self.p += 1 + (kind == "async")
                self.function(named=False, is_async=kind == "async")
            elif kind == "class":
                self.klass(named=False)
            else:
                self.assignment()
                self.end_statement()
        elif self.take("*"):
            if self.take("as"):
                self.property_name()
            self.need("from")
            self.need("S")
            self.end_statement()
        elif self.k[self.p] == "{":
            self.names()
            if self.take("from"):
                self.need("S")
            self.end_statement()
        else:
            self.statement()

    def expression(self, no_in: bool = False) -> str:
        what = self.assignment(no_in)
        while self.take(","):
            self.assignment(no_in)
            what = VALUE
        return what

    def assignment(self, no_in: bool = False) -> str:
        k, p = self.k, self.p
        kind = k[p]
        if kind == "yield" and self.gen:
            self.p += 1
            if not self.nl[self.p] and (self.take("*") or k[self.p] not in (")", "]", "}", "}T", ",", ";", ":", "end", "in", "of")):
                self.assignment(no_in)
            return VALUE
        if kind == "async" and not self.nl[p + 1]:
            if self.is_name(k[p + 1]) and k[p + 2] == "=>":
                self.p += 3
                return self.arrow_body(True)
            if k[p + 1] == "(" and k[self.match[p + 1] + 1] == "=>":
                self.p += 1
                return self.arrow(True)
        if self.is_name(kind) and k[p + 1] == "=>" and not self.nl[p + 1]:
            self.p += 2
            return self.arrow_body(False)
        if kind == "(" and k[self.match[p] + 1] == "=>":
            return self.arrow(False)
        kept, self.cover = self.cover, False
        what = self.binary(0, no_in)
        if k[self.p] == "?":
            self.p += 1
            self.assignment()
            self.need(":")
            self.assignment(no_in)
            what = VALUE
        kind = k[self.p]
        if kind in _ASSIGN:
            if what != PLACE and not (what == PATTERN and kind == "="):
                self.fail("place expected")
            self.p += 1
            self.cover = False
            self.assignment(no_in)
            what = "default" if kind == "=" else VALUE
        if self.cover and what != PATTERN:
            self.fail("shorthand with value")
        self.cover = self.cover or kept
        return what

    def arrow(self, is_async: bool) -> str:
        end = self.match[self.p]
        self.p += 1
        while self.p < end:
            rest = self.take("...")
            self.target()
            if not rest and self.take("="):
                self.assignment()
            if self.p < end:
                if rest:
                    self.fail("rest must be last")
                self.need(",")
        self.need(")")
        if self.nl[self.p]:
            self.fail("line break")
        self.need("=>")
        return self.arrow_body(is_async)

    def arrow_body(self, is_async: bool) -> str:
        if self.k[self.p] == "{":
            self.body(is_async, False, arrow=True)
        else:
            kept, self.is_async = self.is_async, is_async
            self.assignment()
            self.is_async = kept
        return ARROW

    def binary(self, least: int, no_in: bool) -> str:
        kind = self.k[self.p]
        if kind == "#" and self.k[self.p + 1] == "in":
            self.p += 1
            what = VALUE
        else:
            what = self.unary()
        while True:
            op = self.k[self.p]
            rank = _BINARY.get(op, 0)
            if rank <= least or (op == "in" and no_in):
                return what
            if op == "**" and kind in _UNARY:
                self.fail("unary before **")
            if what == ARROW:
                self.fail("arrow")
            self.p += 1
            self.binary(rank - (op == "**"), no_in)
            what = VALUE

    def unary(self) -> str:
        kind = self.k[self.p]
        if kind in _UNARY or (kind == "await" and (self.is_async or (not self.fn and self.k[self.p + 1] in ("I", "import", "new", "fetch")))):
            self.p += 1
            self.unary()
            return VALUE
        if kind in ("++", "--"):
            self.p += 1
            if self.unary() != PLACE:
                self.fail("place expected")
            return VALUE
        what = self.postfix()
        if self.k[self.p] in ("++", "--") and not self.nl[self.p]:
            if what != PLACE:
                self.fail("place expected")
            self.p += 1
            return VALUE
        return what

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if self.k[self.p] != ")":
                self.need(",")

    def postfix(self) -> str:
        if self.k[self.p] == "new":
            self.p += 1
            if self.take("."):
                self.need("I")
                what = VALUE
            else:
                self.callee()
                if self.k[self.p] == "(":
                    self.arguments()
                what = VALUE
        else:
            what = self.primary()
        optional = False
        while True:
            kind = self.k[self.p]
            if kind in (".", "?."):
                self.p += 1
                optional = optional or kind == "?."
                nxt = self.k[self.p]
                if kind == "?." and nxt == "(":
                    self.arguments()
                    what = VALUE
                    continue
                if kind == "?." and nxt == "[":
                    self.p += 1
                    self.expression()
                    self.need("]")
                elif nxt in ("I", "#") or nxt in RESERVED or nxt in SOFT:
                    self.p += 1
                else:
                    self.fail("name expected")
                what = VALUE if optional else PLACE
            elif kind == "[":
                self.p += 1
                self.expression()
                self.need("]")
                what = VALUE if optional else PLACE
            elif kind == "(":
                if what == ARROW:
                    return what
                self.arguments()
                what = VALUE
            elif kind in ("T", "T{"):
                self.template()
                what = VALUE
            else:
                return what

    def callee(self) -> None:
        if self.k[self.p] == "new":
            self.p += 1
            self.callee()
            if self.k[self.p] == "(":
                self.arguments()
        else:
            self.primary()
        while self.k[self.p] in (".", "["):
            if self.take("["):
                self.expression()
                self.need("]")
            else:
                self.p += 1
                self.property_name()

    def template(self) -> None:
        if self.take("T"):
            return
        while self.take("T{"):
            self.expression()
            self.need("}T")

    def primary(self) -> str:
        kind = self.k[self.p]
        if kind in ("T", "T{"):
            self.template()
            return VALUE
        if kind == "async" and self.k[self.p + 1] == "function" and not self.nl[self.p + 1]:
            self.p += 2
            self.function(named=False, is_async=True)
            return VALUE
        if self.is_name(kind):
            self.p += 1
            return PLACE
        if kind in _SIMPLE:
            if kind == "super" and self.k[self.p + 1] not in (".", "[", "("):
                self.fail("super")
            self.p += 1
            return VALUE
        if kind == "(":
            self.p += 1
            what = self.expression()
            self.need(")")
            return what if what == PLACE else VALUE
        if kind == "[":
            self.p += 1
            pattern = True
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                pattern &= self.assignment() in (PLACE, PATTERN, "default")
                if self.k[self.p] != "]":
                    self.need(",")
            return PATTERN if pattern else VALUE
        if kind == "{":
            self.p += 1
            pattern = True
            while not self.take("}"):
                if self.take("..."):
                    pattern &= self.assignment() in (PLACE, PATTERN)
                else:
                    pattern &= self.member(in_class=False)
                if self.k[self.p] != "}":
                    self.need(",")
            return PATTERN if pattern else VALUE
        if kind == "function":
            self.p += 1
            self.function(named=False)
            return VALUE
        if kind == "class":
            self.klass(named=False)
            return VALUE
        if kind == "import":
            self.p += 1
            if self.take("."):
                self.need("I")
            else:
                self.arguments()
            return VALUE
        self.fail("expression expected")
        return VALUE


def check_javascript(text: str) -> str | None:
    """None if the text is valid as a script or a module, else what is wrong."""
    try:
        _Parser(text).program()
    except Invalid as wrong:
        return str(wrong)
    except RecursionError:
        return "nested too deeply"
    return None
