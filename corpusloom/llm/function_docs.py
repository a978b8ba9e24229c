"""Functions paired with their documentation.

Files are lexed into rows of tokens that matter for structure: function headers, decorators, comments, docstrings and
changes of depth (indentation, braces). The rest is SQL over these rows: a cumulative sum gives each token's depth; the
first token that returns to a function's depth ends it; comments, decorators and a header on adjoining lines at one
indentation form islands, found with lag, and the comments of an island document its function; a docstring belongs to
the header it follows.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PY = re.compile(
    r"""(?P<nl>\n[ \t\f]*)(?:(?P<def>(?:async[ \t]+)?def[ \t]+(?P<name>\w+))|(?P<dec>@)|(?P<note>\#[^\n]*))?
    |(?P<str>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'))
    |(?P<com>\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<cont>\\\n)|(?P<word>[^\s\#"'()\[\]{}\\]+)""",
    re.X,
)
_JS = re.compile(
    r"""(?P<nl>\n)|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)|(?P<com>//[^\n]*)
    |(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)
    |(?P<def>(?<![\w$.])(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+))
    |(?P<arrow>(?<![\w$.])(?:const|let|var)[ \t]+(?P<aname>[\w$]+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^()\n]*\)[ \t]*=>|[\w$]+[ \t]*=>))
    |(?P<method>(?<=\n)[ \t]+(?:static[ \t]+)?(?:async[ \t]+)?\*?(?P<mname>[\w$]+)[ \t]*\([^()\n]*\)[ \t]*(?=\{))
    |(?P<open>[{(\[])|(?P<close>[})\]])""",
    re.X,
)
_NO_METHOD = frozenset("if for while switch catch with function return".split())
Row = tuple[int, int, int, str, int, int, str | None, str | None]


def lex_python(text: str) -> list[Row]:
    """``(pos, line, end_line, kind, indent, delta, name, text)`` rows; kinds: F header, @ decorator, C comment,
    D docstring, and + or - where the indentation changes."""
    rows: list[Row] = []
    text = "\n" + text.replace("\r\n", "\n").replace("\r", "\n")
    line, depth, levels, state = 0, 0, [0], ""  # state: "head" inside a header, "body" before a body's first statement
    fresh, pending = False, None  # fresh: at the start of a logical line
    for m in _PY.finditer(text):
        what = m.lastgroup
        if what in ("nl", "def", "name", "dec", "note"):
            line += 1
            if depth:
                continue
            indent = len(m["nl"].expandtabs(8)) - 1
            if m["note"] is not None:
                rows.append((m.start(), line, line, "C", indent, 0, None, m["note"]))
                continue
            fresh, pending = True, (m.start(), indent)
            if m["def"] is not None or m["dec"] is not None:
                _levels(rows, levels, *pending, line)
                fresh = False
                if m["def"] is not None:
                    rows.append((m.start() + 1, line, line, "F", indent, 0, m["name"], None))
                    state = "head"
                else:
                    rows.append((m.start() + 1, line, line, "@", indent, 0, None, None))
                    state = "dec"
            continue
        if what == "com":
            continue
        if what == "cont":
            line += 1
            continue
        if fresh and depth == 0:
            _levels(rows, levels, *pending, line)
            fresh = False
            if state == "head" and what == "str":
                piece = m.group()
                rows.append((m.start(), line, line + piece.count("\n"), "D", pending[1], 0, None, _literal(piece)))
            state = ""
        if what == "str":
            line += m.group().count("\n")
        elif what == "open":
            depth += 1
        elif what == "close":
            depth = max(0, depth - 1)
        if state == "dec" and rows and rows[-1][3] == "@":
            rows[-1] = (*rows[-1][:2], line, *rows[-1][3:])
    for level in levels[:0:-1]:
        rows.append((len(text) + 1, line + 1, line + 1, "-", level, -1, None, None))
    return rows


def _levels(rows: list[Row], levels: list[int], pos: int, indent: int, line: int) -> None:
    if indent > levels[-1]:
        levels.append(indent)
        rows.append((pos, line, line, "+", indent, 1, None, None))
    while indent < levels[-1]:
        levels.pop()
        rows.append((pos, line, line, "-", indent, -1, None, None))


def _literal(piece: str) -> str:
    body = piece.lstrip("rRbBuUfF")
    return body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]


def lex_javascript(text: str) -> list[Row]:
    rows: list[Row] = []
    text = "\n" + text.replace("\r\n", "\n").replace("\r", "\n")
    line, inner, stack = 0, 0, []
    begin = 0
    for m in _JS.finditer(text):
        what, piece = m.lastgroup, m.group()
        if what == "nl":
            line += 1
            begin = m.end()
            continue
        if what in ("com", "block"):
            indent = m.start() - begin
            last = line + piece.count("\n")
            if not text[begin : m.start()].strip():
                rows.append((m.start(), line, last, "C", indent, 0, None, piece))
            if last > line:
                begin = m.start() + piece.rindex("\n") + 1
            line = last
            continue
        if what in ("def", "name", "arrow", "aname", "method", "mname"):
            name = m["name"] or m["aname"] or m["mname"]
            if name not in _NO_METHOD:
                head = text[begin:].split("\n", 1)[0] if m["mname"] else None
                indent = len(head) - len(head.lstrip()) if head is not None else m.start() - begin
                before = text[begin : m.start()].strip()
                indent = m.start() - begin - len(text[begin : m.start()].lstrip()) if before in ("export", "export default", "module.exports =") else indent
                rows.append((m.start(), line, line, "F", indent, 0, name, None))
            line += piece.count("\n")
            continue
        if what == "open":
            stack.append(piece)
            inner += piece != "{"
            if piece == "{" and not inner:
                rows.append((m.start(), line, line, "+", 0, 1, None, None))
        elif what == "close":
            if stack:
                opener = stack.pop()
                if opener == "{" and not inner:
                    rows.append((m.start(), line, line, "-", 0, -1, None, None))
                inner -= opener != "{"
        else:
            line += piece.count("\n")
            if "\n" in piece:
                begin = m.start() + piece.rindex("\n") + 1
    return rows


_LEX = {".py": lex_python, ".js": lex_javascript}


def function_tokens(files: DataFrame, file_id: str, path: str, content: str) -> DataFrame:
    """Token rows of every file in a language that is lexed; null ids, paths and contents are left out."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[A-Za-z0-9]+)$", 1))
    rows = files.select(F.col(file_id).alias("file_id"), ext.alias("ext"), F.col(content).alias("text")).where(F.col("ext").isin(*_LEX) & F.col("file_id").isNotNull() & F.col("text").isNotNull())

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "pos", "line", "end_line", "kind", "indent", "delta", "name", "text"]
        for pdf in batches:
            out = []
            for i, ext, text in zip(pdf["file_id"].tolist(), pdf["ext"].tolist(), pdf["text"].tolist(), strict=True):
                out.extend((i, *row) for row in _LEX[ext](text))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(lex, "file_id bigint, pos int, line int, end_line int, kind string, indent int, delta int, name string, text string")


def delimit_functions(tokens: DataFrame) -> DataFrame:
    """``(file_id, name, line, end_line, docstring, comment)`` for each function header among the token rows."""
    order = W.partitionBy("file_id").orderBy("pos", "kind")
    t = tokens.withColumn("depth", F.sum("delta").over(order.rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("docstring", F.when(F.lead("kind").over(order) == "D", F.lead("text").over(order)))
    t = t.withColumn("doc2", F.when((F.lead("kind").over(order) == "+") & (F.lead("kind", 2).over(order) == "D"), F.lead("text", 2).over(order)))
    t = t.withColumn("opens", F.coalesce(F.lead("kind").over(order) == "+", F.lit(False)))
    # A function's body ends with the first return to its depth.
    level = W.partitionBy("file_id", "depth").orderBy("pos", "kind")
    t = t.withColumn("until", F.min(F.when(F.col("kind") == "-", F.col("line"))).over(level.rowsBetween(1, W.unboundedFollowing)))
    # Islands of comments, decorators and a header on adjoining lines at one indentation.
    t = t.where(F.col("kind").isin("C", "@", "F"))
    new = F.coalesce((F.col("line") > F.lag("end_line").over(order) + 1) | (F.lag("kind").over(order) == "F") | (F.lag("indent").over(order) != F.col("indent")), F.lit(True))
    t = t.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    notes = F.array_sort(F.collect_list(F.when(F.col("kind") == "C", F.struct("pos", "text"))))
    head = F.max(F.when(F.col("kind") == "F", F.struct("line", "name", F.when(F.col("opens"), F.coalesce("until", F.col("line"))).otherwise(F.col("line")).alias("end_line"), F.coalesce("docstring", "doc2").alias("docstring"))))
    t = t.groupBy("file_id", "island").agg(head.alias("f"), F.array_join(notes["text"], "\n").alias("comment")).where("f is not null")
    return t.select("file_id", "f.name", "f.line", "f.end_line", "f.docstring", F.nullif("comment", F.lit("")).alias("comment"))


# Words that say nothing about a function; fixed values.
_EMPTY = frozenset(
    """a an the this that these it its is are was be been of for to in on at by and or with from as into not so if then than there here we you i
    function functions func method methods helper helpers class description describe docstring doc docs documentation auto autogenerated generated summary
    call called calls use used using uses takes take return returns returned returning value values parameter parameters param params arg args argument
    arguments input inputs output outputs result results object none null true false type types default module implementation implements implement does do
    something stuff given self me cls any int str string list dict float bool number boolean bytes tuple set array void undefined optional raises raise
    yields yield throws note notes example examples name named placeholder todo fixme xxx tbd na n/a see below above
    der die das ein eine funktion methode und gibt zurück wert para la el una un función método devuelve valor le les une fonction méthode renvoie valeur""".split()
)
_TOOL = re.compile(r"^(?:noqa|pylint|type:|mypy|flake8|pyright|nosec|fmt:|isort|pragma|eslint|prettier|istanbul|jshint|jslint|tslint|ts-|@ts-|globals?\b|region\b|endregion\b|noinspection|coding[:=]|-\*-|vim:|c8 ignore|!|cspell|yapf|black:|ruff|sonar|end\b|begin\b)", re.I)
_PLACEHOLDER = re.compile(r"\b(?:doc|docs|docstring|documentation|documented|description|summary|text|comment)\b", re.I)
_LATER = re.compile(r"\b(?:missing|write|written|fill|filled|later|replace|placeholder|add|inserted|real|here|pending|needed|lorem)\b", re.I)
_MARK = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack|wip|n/?a)\b", re.I)
_SKELETON = re.compile(r"<[^<>\n]*>|\[(?:summary|description|type|name)[^\]\n]*\]|\b_(?:summary|description|type|name)_\b|\{\{[^}]*\}\}", re.I)
_PARAM = re.compile(r"^\s*(?::(?:param|type|return|returns|rtype|raises|arg|argument|keyword)\b[^:]*:|@(?:param|returns?|throws|type|arg)\b(?:\s*\{[^}]*\})?)", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|examples?|notes?|see also|keyword args)\s*:?\s*$", re.I)
_CODE = re.compile(r"^(?:(?:const|let|var)\s+[\w$]+\s*=|(?:return|import|from|raise|assert|del|yield|throw|await|print)\b.*[\w)\]};]$|[\w$.\[\]]+\s*(?:[-+*/|&]?=)\s*\S|(?:if|for|while|elif|with|def|class|function|try|except|else)\b.*[:{]$|[\w$.]+\(.*\)[;{]?$|[})\]];?$|.*;$)")
_NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", re.U)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?", re.U)


def _name_words(*names: str | None) -> set[str]:
    out: set[str] = set()
    for name in names:
        for part in re.findall(r"\w+", name or ""):
            out.add(part.lower())
            out.add(part.lower().replace("_", ""))
            out.update(w.lower() for w in _NAMES.findall(part))
    return out


def bare_text(doc: str) -> str:
    """A comment or docstring without its markers."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    doc = re.sub(r"^/\*+!?|\*+/$", "", doc)
    return "\n".join(re.sub(r"^\s*(?:#+|//+|\*+(?!\*))?[!:]?\s?", "", line).rstrip() for line in doc.split("\n"))


def _is_code(line: str) -> bool:
    line = line.strip()
    if not _CODE.match(line):
        return False
    if line.endswith((";", "{", "}")) or re.match(r"(?:const|let|var)\s", line):
        return True
    try:
        ast.parse(textwrap.dedent(line) + (" pass" if line.endswith(":") else ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def informs(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether the text tells something that the function's name, parameters and types don't."""
    if not doc or not doc.strip():
        return False
    known = _name_words(name, signature)
    said: list[str] = []
    prompt = False
    for line in bare_text(doc).split("\n"):
        text = line.strip()
        if text.startswith(">>>") or text.startswith("... "):
            prompt = True
            continue
        if prompt:
            prompt = False
            if re.fullmatch(r"[\d.\-+'\"\[\]{}(), A-Za-z_]{1,40}", text) and " " not in text.strip():
                continue
        if not text or not re.search(r"\w", text) or _TOOL.match(text) or _SECTION.match(text) or _is_code(text):
            continue
        text = _PARAM.sub("", _SKELETON.sub(" ", text))
        text = re.sub(r"^\s*[\w*]+\s*(?:\([^)]*\))?\s*:\s*", lambda m: "" if _name_words(m.group()) & known else m.group(), text)
        said.append(text)
    kept = []
    for sentence in re.split(r"(?<=[.!?。])\s+|\n\n", "\n".join(said)):
        if _MARK.match(sentence) or (_PLACEHOLDER.search(sentence) and _LATER.search(sentence)):
            continue
        kept.append(sentence)
    words = [w.lower() for w in _WORDS.findall(" ".join(kept))]
    left = [w for w in words if w not in _EMPTY and w not in known and len(w) > 1]
    if any(ord(ch) > 0x2E7F for w in left for ch in w):
        return True
    return len(set(left)) >= 2 or (len(words) <= 2 and len(left) == 1 and len(left[0]) > 5)


def delimited(lines: list[str], line: int, end_line: int, python: bool) -> str:
    """The text of a function from its header to the line that ends it; in Python that is the next statement further out,
    which is left off with the blank lines, remarks and decorators before it."""
    kept = lines[line - 1 : end_line]
    if python and kept:
        indent = len(kept[0]) - len(kept[0].lstrip())
        while len(kept) > 1 and (not kept[-1].strip() or len(kept[-1]) - len(kept[-1].lstrip()) <= indent and kept[-1].strip()[0] not in ")]}\"'"):
            kept.pop()
    return "\n".join(kept)


def function_texts(files: DataFrame, found: DataFrame) -> DataFrame:
    """``(s_repo, s_path, s_name, s_line, text)`` of every delimited function; a file's spots are as many as its functions."""
    spots = found.groupBy("file_id").agg(F.collect_list(F.struct("name", "line", "end_line")).alias("spots"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, text, own in zip(pdf["repo"], pdf["path"], pdf["content"], pdf["spots"], strict=True):
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                out.extend((repo, path, x["name"], x["line"], delimited(lines, x["line"], x["end_line"], path.lower().endswith(".py"))) for x in own)
            yield pd.DataFrame(out, columns=["s_repo", "s_path", "s_name", "s_line", "text"])

    return files.join(spots, "file_id").select("repo", "path", "content", "spots").mapInPandas(cut_out, "s_repo string, s_path string, s_name string, s_line int, text string")


def pair_functions(functions: DataFrame, files: DataFrame, *, texts: bool = False) -> DataFrame:
    """``(function_id, repo, file_path, name, signature, code, doc)``: functions with documentation that informs.

    The function's own docstring counts; where it is null or blank, the docstring or the comment directly above the
    function in the file's content does. A function is found in its file by name, nearest to ``start_line``. Repeated
    rows of an id count once, null ids are left out; functions without a file keep their own docstring. With ``texts`` the
    code is what the file holds between the function's delimiters, and the given body only where it is not found there.
    """
    own = functions.select("function_id", "repo", "file_path", "name", "signature", "normalized_body", "docstring", "start_line").where("function_id is not null")
    blank = F.coalesce(F.trim(F.regexp_replace("docstring", r"\s+", " ")), F.lit("")) == ""
    stated = own.where(~blank).withColumn("doc", F.array("docstring"))
    silent = own.where(blank).withColumn("plain", F.element_at(F.split("name", r"\."), -1))
    files = files.select("file_id", "repo", "path", "content").where("file_id is not null").groupBy("file_id").agg(F.min_by(F.struct("repo", "path", "content"), "content").alias("f")).select("file_id", "f.*")
    found = every = delimit_functions(function_tokens(files, "file_id", "path", "content"))
    placed = files.select("file_id", F.col("repo").alias("f_repo"), F.col("path").alias("f_path"))
    found = found.where("docstring is not null or comment is not null").join(placed, "file_id").select("f_repo", "f_path", F.col("name").alias("f_name"), "line", "end_line", F.col("docstring").alias("f_doc"), "comment")
    near = silent.join(found, (silent["repo"] == found["f_repo"]) & (silent["file_path"] == found["f_path"]) & (silent["plain"] == found["f_name"]))
    rank = W.partitionBy("function_id").orderBy(F.abs(F.coalesce(F.col("start_line"), F.lit(0)) - F.col("line")), "line", "f_doc", "comment")
    near = near.withColumn("nth", F.row_number().over(rank)).where("nth = 1").withColumn("doc", F.array("f_doc", "comment"))
    names = ["function_id", "repo", "file_path", "name", "signature", "normalized_body", "start_line", "doc"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs = [next((bare_text(d) for d in texts if informs(d, n, s)), None) for texts, n, s in zip(pdf["doc"], pdf["name"], pdf["signature"], strict=True)]
            out = pdf.drop(columns=["doc"]).assign(doc=docs)
            yield out[out["doc"].notna()].rename(columns={"normalized_body": "code"})

    both = stated.select(*names).unionAll(near.select(*names))
    columns = ["function_id", "repo", "file_path", "name", "signature", "code", "doc"]
    paired = both.mapInPandas(choose, "function_id bigint, repo string, file_path string, name string, signature string, code string, start_line int, doc string")
    if not texts:
        return paired.select(columns)
    spots = function_texts(files, every)
    met = paired.dropDuplicates(["function_id"]).join(spots, (F.col("repo") == F.col("s_repo")) & (F.col("file_path") == F.col("s_path")) & (F.element_at(F.split("name", r"\."), -1) == F.col("s_name")), "left")
    rank = W.partitionBy("function_id").orderBy(F.abs(F.coalesce(F.col("start_line"), F.lit(0)) - F.col("s_line")), "s_line")
    return met.withColumn("nth", F.row_number().over(rank)).where("nth = 1").withColumn("code", F.coalesce("text", "code")).select(columns)
