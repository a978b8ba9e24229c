"""Source files that do not parse: lexer-state maps and bracket summaries of chunks, then local grammars.

A file is cut into chunks. A chunk's summary tells, for each lexer state it may begin in, the state it ends in and the
brackets it leaves: closers that need a partner before the chunk and openers that need one after it. Summaries form a
monoid (``combine`` is associative), so the chunks of a file can be reduced in any grouping: within a task for common
files, across partitions for files longer than ``ACROSS`` characters. A file whose reduced summary is unbalanced or
ends inside a string is invalid. Balanced text is cut into its statements, which a local grammar parses one by one:
statements of Python, statements of JavaScript (``js_grammar``), members of a JSON document, lines of TOML; one that is
refused makes the file invalid. Only what the parts can't tell is settled on the whole text: literals that hold quotes
or brackets of their own (f-strings, templates, regular expressions), ``__future__`` and names given twice in TOML.
"""

from __future__ import annotations

import json
import re
import tomllib
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.js_grammar import check_javascript

CHUNK = 65_536
#: Files with more characters have their chunks summarised by different tasks.
ACROSS = 4_000_000

CODE = "code"
_PAIR = {")": "(", "]": "[", "}": "{"}


class Lexer:
    """Token patterns of a language: what opens and closes a string or comment, and what is a bracket."""

    def __init__(self, opens: str, ends: dict[str, str], line: frozenset[str]) -> None:
        self.opens = re.compile(opens)
        self.ends = {state: re.compile(pattern) for state, pattern in ends.items()}
        self.line = line  # states that an unescaped line end closes

    def states(self) -> list[str]:
        return [CODE, *self.ends]


_STR = {'"': r'"|\n|\\[\s\S]', "'": r"'|\n|\\[\s\S]", '"""': r'"""|\\[\s\S]', "'''": r"'''|\\[\s\S]"}
LEXERS = {
    ".py": Lexer(r'"""|\'\'\'|"|\'|#|[()\[\]{}]', {**_STR, "#": r"\n"}, frozenset(["#"])),
    ".toml": Lexer(r'"""|\'\'\'|"|\'|#|[()\[\]{}]', {**_STR, "'": r"'|\n", "'''": "'''", "#": r"\n"}, frozenset(["#"])),
    ".json": Lexer(r'"|[()\[\]{}]', {'"': _STR['"']}, frozenset()),
    ".js": Lexer(r"//|/\*|\"|'|`|[()\[\]{}]", {'"': _STR['"'], "'": _STR["'"], "`": r"`|\\[\s\S]", "//": r"\n", "/*": r"\*/"}, frozenset(["//"])),
}
#: state at the end, closers without an opener, openers without a closer, False once brackets of different kinds met
Summary = tuple[str, str, str, bool]


def summarise(lexer: Lexer, text: str, state: str = CODE) -> Summary:
    """Runs the lexer over a chunk that begins in ``state``."""
    closers: list[str] = []
    openers: list[str] = []
    fits, pos = True, 0
    while pos < len(text):
        if state == CODE:
            m = lexer.opens.search(text, pos)
            if m is None:
                break
            what, pos = m.group(), m.end()
            if what in "([{":
                openers.append(what)
            elif what in ")]}":
                if not openers:
                    closers.append(what)
                elif openers.pop() != _PAIR[what]:
                    fits = False
            else:
                state = what
        else:
            m = lexer.ends[state].search(text, pos)
            if m is None:
                break
            pos = m.end()
            if m.group()[0] != "\\":
                if m.group() == "\n" and state not in lexer.line:
                    fits = False  # a string of one line that isn't closed in it
                state = CODE
    return state, "".join(closers), "".join(openers), fits


def chunk_map(lexer: Lexer, text: str, first: bool) -> dict[str, Summary]:
    """The summary for every state the chunk may begin in; a file's first chunk begins in code."""
    return {s: summarise(lexer, text, s) for s in ([CODE] if first else lexer.states())}


def combine(left: dict[str, Summary], right: dict[str, Summary]) -> dict[str, Summary]:
    """The map of two neighbouring chunks; associative."""
    out = {}
    for begin, (middle, closers, openers, fits) in left.items():
        end, closers2, openers2, fits2 = right[middle]
        n = min(len(openers), len(closers2))
        inner = all(_PAIR[c] == o for o, c in zip(openers[::-1][:n], closers2[:n], strict=True))
        out[begin] = (end, closers + closers2[n:], openers[: len(openers) - n] + openers2, fits and fits2 and inner)
    return out


def chunks_of(text: str, size: int = CHUNK) -> list[str]:
    """Cuts that fall neither inside an escape nor inside a run of quotes or slashes."""
    out, begin = [], 0
    while begin < len(text):
        end = begin + size
        while end < len(text) and (text[end] in "\"'/*\\" or text[end - 1] in "\"'/*\\"):
            end += 1
        out.append(text[begin:end])
        begin = end
    return out or [""]


def balanced(lexer: Lexer, summary: Summary) -> bool:
    state, closers, openers, fits = summary
    return fits and not closers and not openers and (state == CODE or state in lexer.line)


_PY_PARTS = re.compile(r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|#[^\n]*|[()\[\]{}]|\\\n|\n(?=[^\s#)\]}])')
_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b")


def python_statements(text: str) -> Iterator[str]:
    """The top-level statements of balanced Python text."""
    depth, begin, decorated = 0, 0, text.startswith("@")
    for m in _PY_PARTS.finditer(text):
        what = m.group()
        if what in "([{":
            depth += 1
        elif what in ")]}":
            depth -= 1
        elif what == "\n" and depth == 0:
            at = m.end()
            if decorated:
                decorated = text.startswith("@", at)
            elif not _CONTINUES.match(text, at):
                yield text[begin:at]
                begin, decorated = at, text.startswith("@", at)
    yield text[begin:]


def _compiles(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    return True


#: What no statement can tell alone: where a __future__ import stands and what it changes, and names of the module
#: that are used before they are declared global.
_TOGETHER = re.compile(r"\b__future__\b|\bglobal\b")
_SCOPE = re.compile(r"(?:def|async\s+def|class|@)(?!\w)")
#: Literals that may hold quotes and brackets of their own, which a chunk's lexer can't tell from those outside.
_NESTED = {".py": re.compile(r"(?<!\w)(?:[fFtT][rR]?|[rR][fFtT])['\"]"), ".js": re.compile(r"`|/(?![/*])")}


def _python_ok(text: str, fits: bool) -> bool:
    """An unbalanced summary or a statement that its grammar refuses makes the text invalid; where f-strings may have
    misled the lexer, compiling the whole text confirms it."""
    sure = not _NESTED[".py"].search(text)
    if not fits:
        return not sure and _compiles(text)
    for statement in python_statements(text):
        if (m := _TOGETHER.search(statement)) and (m.group() == "__future__" or not _SCOPE.match(statement)):
            return _compiles(text)
        if not _compiles(statement):
            return not sure and _compiles(text)
    return True


_JS_PARTS = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[()\[\]{}]|(?<=[;}])\n(?=(?:function|class|const|let|var|import|export|if|for|while|switch|try|throw|async function)\b)")


def javascript_statements(text: str) -> Iterator[str]:
    """Balanced text without templates and regular expressions, cut before statements that begin at the left margin
    with a keyword, after one that has visibly ended; what lies between is one piece."""
    depth, begin = 0, 0
    for m in _JS_PARTS.finditer(text):
        what = m.group()
        if what in "([{":
            depth += 1
        elif what in ")]}":
            depth -= 1
        elif what == "\n" and depth == 0:
            yield text[begin : m.end()]
            begin = m.end()
    yield text[begin:]


def _javascript_ok(text: str, fits: bool) -> bool:
    """As for Python: the summary and the statements decide, and the grammar over the whole text where templates or
    slashes leave open what is a bracket."""
    if _NESTED[".js"].search(text):
        return check_javascript(text) is None
    return fits and all(check_javascript(piece) is None for piece in javascript_statements(text))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _reads(reader, text: str) -> bool:  # noqa: ANN001
    try:
        reader(text)
    except (ValueError, RecursionError):
        return False
    return True


_JSON_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]', re.S)
_JSON_MEMBER = re.compile(r'[ \t\n\r]*"(?:[^"\\]|\\.)*"[ \t\n\r]*:', re.S)


def _json_ok(text: str) -> bool:
    """The outermost object or array by the grammar of each of its members."""
    read = lambda t: _reads(lambda x: json.loads(x, parse_constant=_no_constant), t)
    whole = text.strip(" \t\n\r")
    if whole[:1] not in ("{", "["):
        return read(text)
    close, depth, begin, members = "}" if whole[0] == "{" else "]", 0, 1, []
    for m in _JSON_PARTS.finditer(whole):
        what = m.group()
        if what in "[{":
            depth += 1
        elif what in "]}":
            depth -= 1
            if depth == 0:
                if what != close or m.end() != len(whole):
                    return False
                members.append(whole[begin : m.start()])
        elif what == "," and depth == 1:
            members.append(whole[begin : m.start()])
            begin = m.end()
    if len(members) == 1 and not members[0].strip(" \t\n\r"):
        return True
    for member in members:
        if close == "}":
            head = _JSON_MEMBER.match(member)
            if not head or not read(head.group().strip(" \t\n\r")[:-1]) or not read(member[head.end() :]):
                return False
        elif not read(member):
            return False
    return bool(members)


_TOML_PARTS = re.compile(r'"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*"{3,5}|\'{3}(?:[^\']|\'(?!\'\'))*\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|#[^\n]*|[\[\]{}\n]')
_TOML_NAME = re.compile(r"[ \t]*(\[\[?[^\]\n]*\]?\]|[^=\n#]*)")


def _toml_ok(text: str) -> bool:
    """Every header and key with its value by the grammar; only where a name may be given twice, which no statement can
    tell alone, the whole document is read."""
    text = text.replace("\r\n", "\n")
    depth, begin, statements = 0, 0, []
    for m in _TOML_PARTS.finditer(text):
        what = m.group()
        if what in "[{":
            depth += 1
        elif what in "]}":
            depth -= 1
        elif what == "\n" and depth == 0:
            statements.append(text[begin : m.end()])
            begin = m.end()
    statements.append(text[begin:])
    names, table, twice = set(), "", False
    for statement in statements:
        if not _reads(tomllib.loads, statement):
            return False
        name = _TOML_NAME.match(statement).group(1).strip()
        if name:
            if name.startswith("["):
                table, key = name, name
            else:
                key = f"{table} {name}"
            twice = twice or key in names or "." in name or '"' in name or "'" in name or name.startswith("[[")
            names.add(key)
    return not twice or _reads(tomllib.loads, text)


def parses(ext: str, text: str, fits: bool | None = None) -> bool:
    """Whether ``text`` is valid in the language of ``ext``. ``fits``: its reduced summary is balanced, if known."""
    lexer = LEXERS[ext]
    if ext == ".py":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            return False
    if fits is None:
        parts = chunks_of(text)
        fits = balanced(lexer, reduce(combine, (chunk_map(lexer, t, n == 0) for n, t in enumerate(parts)))[CODE])
    if ext == ".py":
        return _python_ok(text, fits)
    if ext == ".js":
        return _javascript_ok(text, fits)
    if ext == ".toml":  # a string of several lines may end in quotes of its own
        return (fits or '""""' in text or "''''" in text) and _toml_ok(text)
    return fits and _json_ok(text)


def check_files(files: DataFrame, file_id: str, path: str, content: str) -> DataFrame:
    """``(file_id, ext, parses)`` for every file in a language that is checked.

    The language is that of the path's extension (``.py``, ``.js``, ``.json``, ``.toml``, any case); others, null paths
    and null ids are left out. Null content counts as empty text; an empty Python, JavaScript or TOML file parses, an
    empty JSON file does not. Repeated rows of an id give repeated equal rows.
    """
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[A-Za-z0-9]+)$", 1))
    text = F.coalesce(F.col(content), F.lit(""))
    rows = files.select(F.col(file_id).alias("file_id"), ext.alias("ext"), text.alias("text")).where(F.col("ext").isin(*LEXERS) & F.col("file_id").isNotNull())

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["file_id"], "ext": pdf["ext"], "parses": [parses(e, t) for e, t in zip(pdf["ext"], pdf["text"], strict=True)]})

    common = rows.where(F.length("text") <= ACROSS).mapInPandas(whole, "file_id bigint, ext string, parses boolean")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, e, t in zip(pdf["file_id"], pdf["ext"], pdf["text"], strict=True):
                for n, part in enumerate(chunks_of(t, CHUNK * 8)):
                    yield pd.DataFrame({"file_id": [i], "ext": [e], "n": [n], "part": [part]})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["file_id"], "ext": pdf["ext"], "n": pdf["n"], "map": [json.dumps(chunk_map(LEXERS[e], t, n == 0)) for e, t, n in zip(pdf["ext"], pdf["part"], pdf["n"], strict=True)]})

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e, t, m in zip(pdf["ext"], pdf["text"], pdf["maps"], strict=True):
                fold = reduce(combine, ({k: tuple(v) for k, v in json.loads(x["map"]).items()} for x in m))
                out.append(parses(e, t, balanced(LEXERS[e], fold[CODE])))
            yield pd.DataFrame({"file_id": pdf["file_id"], "ext": pdf["ext"], "parses": out})

    long = rows.where(F.length("text") > ACROSS)
    spread = long.mapInPandas(pieces, "file_id bigint, ext string, n int, part string").repartition("file_id", "n").mapInPandas(maps, "file_id bigint, ext string, n int, map string")
    folded = spread.groupBy("file_id", "ext").agg(F.sort_array(F.collect_list(F.struct("n", "map"))).alias("maps"))
    across = long.join(folded, ["file_id", "ext"]).select("file_id", "ext", "text", "maps").mapInPandas(reduced, "file_id bigint, ext string, parses boolean")
    return common.unionAll(across)
