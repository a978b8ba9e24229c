"""Credentials embedded in source code: literals segmented into dictionary words, unexplained residuals judged in context.

A line that mentions a credential, an address with a login or a private key is looked at more closely. Its literal is
segmented by Viterbi into words of a dictionary learned from the names of the collection's own functions and classes
(word cost = -log of its share); characters that no word explains form the residual. Beside a name that holds a
credential (an assignment, an item, an argument, a header, a fall-back value, a remark) a long residual is a secret;
placeholders, look-ups, prompts, paths and patterns are not, and names of checksums, ids and public data make no such
context, so known hash formats are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut

#: Words that are sent to the workers, the most frequent first; rarer words are joined to the literals that may hold them.
DICTIONARY_WORDS = 20_000
UNKNOWN_COST = 4.0
LONGEST_WORD = 24
REDACTED = "REDACTED"

# Names that hold a credential; fixed values.
_LAST = frozenset("password passwd pwd pw pass passphrase passcode passwort kennwort secret token tok bearer credential credentials cred creds clave contrasena contraseña mdp login auth authorization dsn apikey apitoken authtoken accesskey secretkey sessionkey signingkey privatekey".split())
_GLUED = ("password", "passwd", "passphrase", "secret", "apikey", "accesskey", "secretkey", "sessionkey", "signingkey", "privatekey", "authtoken", "apitoken", "accesstoken", "kennwort", "credential")
_BEFORE_KEY = frozenset("api access secret private signing session encryption auth client master service account shared deploy license storage".split())
_FILLER = frozenset("changeme changeit change password passwort passwd secret token example sample dummy placeholder test testing todo none null undefined your insert replace here redacted hidden masked empty fixme default foo bar baz xxx".split())



def _candidate() -> str:
    """What a line must hold, in lower case, to name a credential: made of the lists that ``names_credential`` uses, with
    words split at any place, since it joins a name's last two."""
    apart = r"[^a-z\n]*"
    names = {apart.join(map(re.escape, w)) for w in (*_LAST, *_GLUED)}
    keys = "|".join(sorted(_BEFORE_KEY))
    return rf"(?:{'|'.join(sorted(names))}|(?:{keys}){apart}(?:key|schluessel|schlüssel))(?![a-z])|://[^\s/'\"]*:[^\s/'\"]*@"


_CANDIDATE = re.compile(_candidate())
_CANDIDATE_ANY = re.compile(_candidate(), re.I)  # for the rare text whose lower case has another length
_Q = "\"'`’‘“”"
_LITERAL = rf"[rbuRBU]{{0,2}}(?P<q>\"\"\"|'''|[{_Q}])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)"
# Names are entered at the begin of their run only and never given back, so that a line of any length takes linear time.
_NAME = r"(?<![\w$\-])(?:(?![A-Za-z_$])[\w$\-])*+(?P<key>[A-Za-z_$][\w$\-]*+)"
_KEYED = re.compile(rf"{_NAME}[{_Q}]?\s*+(?:\]\s*+)?(?::\s*[A-Za-z][\w.\[\], |]*?\s*=(?!=)|=(?![=>])|:(?!:)|=>)\s*+(?:\(\s*+)?{_LITERAL}")
_ENV = re.compile(rf"(?:getenv|environ\.get|env\.get|config|env)\(\s*[{_Q}](?P<key>[\w\-]+)[{_Q}]\s*,\s*(?:default\s*=\s*)?{_LITERAL}")
_JSENV = re.compile(rf"process\.env(?:\.|\[[{_Q}])(?P<key>\w+)(?:[{_Q}]\])?\s*(?:\|\||\?\?)\s*{_LITERAL}")
_ORELSE = re.compile(rf"(?<![\w$])(?:(?![A-Za-z_$])[\w$])*+(?P<key>[A-Za-z_$][\w$]*+)\s*+=\s*+[^=\n{_Q}]*?(?:\bor\b|\|\||\?\?)\s*{_LITERAL}")
_MORE = re.compile(rf"\s*(?:\+\s*)?[rbuRBU]{{0,2}}(?P<q>[{_Q}])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)")
_REMARK = re.compile(r"(?:#|//|/\*|^\s*\*|<!--|--)(?=\s*+(?P<head>[^:=\n]{0,60}?)\s*(?:[:=]|\bis\b)\s*(?P<v>[^\s\"'`,;]{6,}))")
_URL = re.compile(r"(?<![a-z0-9+.\-])(?:(?![a-z])[a-z0-9+.\-])*+[a-z][a-z0-9+.\-]*+://(?P<user>[^\s/@:'\"]*):(?P<v>[^\s/@'\"]+)@(?=[\w\[{$.\-])", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<gap>(?:\\n|\\r|\s|[\"'+,#*(/]|\w+-\w+:[^\n]*)*)(?P<body>[A-Za-z0-9+/=]{16,})")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SCHEME = re.compile(r"^(?:basic|bearer|token|apikey|digest|negotiate|key)\s+", re.I)
_TEMPLATE = re.compile(r"\{\{|\}\}|\$\{|\{[\w.]*\}|<[^<>]+>|%\(\w+\)s|%s|\$[A-Z_]+\b|^\$|\*{3,}|x{5,}|X{5,}|\.{3}|…|#\{")
_PATTERN = re.compile(r"\[[^\]]+\][+*{]|\\[dws][+*{]|^\^|\$$|\(\?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


class Segmenter:
    """Splits runs of letters into dictionary words at least cost; remembers what it has split."""

    def __init__(self, costs: dict[str, float]) -> None:
        self.costs = costs
        self.longest = LONGEST_WORD
        self.seen: dict[str, int] = {}
        self.extra: dict[str, float] = {}

    def with_words(self, extra: dict[str, float]) -> Segmenter:
        """The same dictionary with a literal's rare words."""
        if not extra:
            return self
        other = Segmenter(self.costs)
        other.extra = extra
        return other

    def residual(self, run: str) -> int:
        """How many letters of the run no word explains."""
        got = self.seen.get(run)
        if got is None:
            low = run.lower()
            best: list[tuple[float, int]] = [(0.0, 0)]
            for end in range(1, len(low) + 1):
                cost, left = best[end - 1]
                pick = (cost + UNKNOWN_COST, left + 1)
                for begin in range(max(0, end - self.longest), end - 2):
                    word = self.costs.get(low[begin:end]) or self.extra.get(low[begin:end])
                    if word is not None and best[begin][0] + word < pick[0]:
                        pick = (best[begin][0] + word, best[begin][1])
                best.append(pick)
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[run] = best[-1][1]
        return got

    def unexplained(self, text: str) -> tuple[int, int, int]:
        """(letters and digits that no word explains, digits among them, symbols)"""
        letters = digits = symbols = 0
        for run in re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", text):
            if run.isdigit():
                digits += len(run)
            elif run.isalpha():
                # mixed case inside a run is no spelling of words unless it is camel case
                parts = _PARTS.findall(run)
                letters += sum(self.residual(p) for p in parts) if all(len(p) > 2 for p in parts) else self.residual(run) if run.islower() or run.isupper() or run[1:].islower() else len(run)
            elif run not in "-_.,:/'() ":
                symbols += 1
        return letters + digits, digits, symbols


def names_credential(name: str) -> bool:
    """Whether a name is that of a value which is itself a credential (and not its file, policy, address …)."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if not words:
        return False
    if words[-1] in ("key", "schluessel", "schlüssel"):
        return len(words) > 1 and words[-2] in _BEFORE_KEY
    return words[-1] in _LAST or "".join(words[-2:]) in _LAST or words[-1].endswith(_GLUED)


def _mentions_credential(remark: str) -> bool:
    words = re.findall(r"[\w\-]+", remark)
    return any(names_credential(w) for w in words) or any(names_credential(f"{a}_{b}") for a, b in zip(words, words[1:], strict=False))


def is_secret(value: str, segmenter: Segmenter) -> bool:
    """Judges a literal that stands beside a credential's name."""
    value = _SCHEME.sub("", value.strip()).strip()
    if len(value) < 6 or _TEMPLATE.search(value) or _PATTERN.search(value) or "://" in value or len(set(value)) < 4:
        return False
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", value)]
    if not re.search(r"\d", value) and words and all(w in _FILLER or w in _LAST or w in ("key", "api", "access", "my", "the") for w in words):
        return False
    if words and words[0] in ("your", "changeme", "example", "placeholder", "insert", "replace", "dummy") :
        return False
    odd, digits, symbols = segmenter.unexplained(value)
    if " " in value:
        parts = value.split()
        return len(parts) >= 4 and digits > 0 and value[-1] not in ":?" or (len(parts) == 1 and odd >= 6)
    if value.startswith(("/", "./", "~/")) and odd < 8:
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", value) and digits < 4:
        return False
    return odd >= 6 and (digits > 0 or odd >= 10) or odd >= 2 and digits > 0 and symbols > 0 and len(value) >= 8 or odd >= 5 and symbols > 0


#: (start, end, value, kind); kinds are judged by ``accepted``
Candidate = tuple[int, int, str, str]


def candidates_in(text: str) -> list[Candidate]:
    """Literals, remarks, addresses with a login and private keys that may be credentials, by context alone."""
    found: list[Candidate] = []
    for m in _PEM.finditer(text):
        end = _PEM_END.search(text, m.end())
        nxt = text.find("-----BEGIN", m.end())
        found.append((m.start(), end.end() if end and (nxt < 0 or end.start() < nxt) else m.end(), "", "key"))
    done = -1
    low = text.lower()
    for hit in _CANDIDATE.finditer(low) if len(low) == len(text) else _CANDIDATE_ANY.finditer(text):
        if hit.start() < done:
            continue
        begin = text.rfind("\n", 0, hit.start()) + 1
        done = text.find("\n", hit.start())
        done = len(text) if done < 0 else done
        line = text[begin:done]
        for m in _URL.finditer(line):
            v = m["v"]
            if not _TEMPLATE.search(v) and len(v) >= 3 and v.lower() not in _FILLER and v.lower() not in _LAST and not set(v) <= set("*x.-"):
                found.append((begin + m.start("v"), begin + m.end("v"), v, "login"))
        for pattern in (_KEYED, _ENV, _JSENV, _ORELSE):
            for m in pattern.finditer(line):
                if not names_credential(m["key"]) or (m.start("q") and line[m.start("q") - 1] in "fF" and "{" in m["v"]):
                    continue
                value, end, at = m["v"], m.end(), m.end()
                more = _MORE.match(line, at)
                while more and more["v"] and ("+" in more.group() or line[at : at + 1] in " \t"):
                    value, end, at = value + more["v"], more.end(), more.end()
                    more = _MORE.match(line, at)
                rest = line[at:].lstrip()
                if rest[:1] in ("+", "%") or rest.startswith((".format", "in ", "]")) or (rest[:1] == ":" and pattern is not _ENV):
                    continue
                found.append((begin + m.start("v"), begin + end - 1, value, "literal"))
        for m in _REMARK.finditer(line):
            if _mentions_credential(m["head"]):
                v = m["v"].rstrip(".,;)")
                found.append((begin + m.start("v"), begin + m.start("v") + len(v), v, "remark"))
    return found


def accepted(value: str, kind: str, segmenter: Segmenter) -> bool:
    """Whether a candidate is a credential: keys and logins by their form, literals and remarks by their residual."""
    if kind in ("key", "login"):
        return True
    if kind == "literal":
        return is_secret(value, segmenter)
    odd, digits, _ = segmenter.unexplained(value)
    return odd >= 6 and digits > 0 and "(" not in value and is_secret(value, segmenter)


def apart(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order; of overlapping ones the first."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def find_credentials(text: str, segmenter: Segmenter) -> list[tuple[int, int]]:
    """Spans (start, end) of the credentials in a text, in order, without overlaps."""
    return apart((s, e) for s, e, value, kind in candidates_in(text) if accepted(value, kind, segmenter))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced; quotes, brackets and line structure around it stay."""
    parts, at = [], 0
    for s, e in spans:
        parts += [text[at:s], REDACTED, "\n" * text.count("\n", s, e)]
        at = e
    return "".join([*parts, text[at:]])


@dataclass
class Words:
    """Costs of the words that are sent to the workers, and the rarer words as a table ``(w, cost)``, None where there are
    none."""

    costs: dict[str, float]
    rest: DataFrame | None = None


def word_costs(names: DataFrame, column: str, most: int = DICTIONARY_WORDS) -> Words:
    """Viterbi costs of all words that stand more than once in the names; counted over every row. ``most`` bounds what is
    broadcast, not what is known."""
    spaced = F.regexp_replace(F.regexp_replace(F.col(column), r"([a-z])([A-Z])", "$1 $2"), r"[^A-Za-z]+", " ")
    words = names.select(F.explode(F.split(F.lower(spaced), " ")).alias("w")).where(F.length("w").between(3, LONGEST_WORD))
    counted = cut(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    sums = counted.agg(F.count("*").alias("k"), F.sum("n").alias("total")).first()
    total = sums["total"] or 1
    cost = lambda n: min(11.0, -math.log(n / total)) or 1e-9
    top = {r["w"]: cost(r["n"]) for r in counted.orderBy(F.desc("n"), "w").limit(most).collect()}
    if sums["k"] <= most:
        return Words(top)
    rare = counted.withColumn("r", F.least(F.lit(11.0), -F.log(F.col("n") / F.lit(total))))
    return Words(top, rare.select("w", F.greatest("r", F.lit(1e-9)).alias("cost")))


# Words that occur in the addresses, paths and remarks of any code; fixed values.
_COMMON = "password secret token access client login vault run etc var usr home admin user root local main data file config server service account database example value name prod production staging default".split()


def segmenter_of(costs: dict[str, float]) -> Segmenter:
    return Segmenter({**dict.fromkeys(_COMMON, 7.0), **costs})


def _spans(usable: DataFrame, words: Words) -> DataFrame:
    """``(row_id, line_no, start, length)`` of every credential of ``(row_id, text)``."""
    shared = usable.sparkSession.sparkContext.broadcast(words.costs)  # at most DICTIONARY_WORDS entries
    shape = "row_id bigint, line_no int, start int, length int"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = segmenter_of(shared.value)
        for pdf in batches:
            out = []
            for i, t in zip(pdf["row_id"].tolist(), pdf["text"].tolist(), strict=True):
                out.extend((i, t.count("\n", 0, s) + 1, s, e - s) for s, e in find_credentials(t, segmenter))
            if out:
                yield pd.DataFrame(out, columns=["row_id", "line_no", "start", "length"])

    if words.rest is None:
        return usable.mapInPandas(search, shape)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["row_id"].tolist(), pdf["text"].tolist(), strict=True):
                out.extend((i, t.count("\n", 0, s) + 1, s, e - s, v, kind) for s, e, v, kind in candidates_in(t))
            if out:
                yield pd.DataFrame(out, columns=["row_id", "line_no", "start", "length", "value", "kind"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every part of a literal's runs of letters that could be a word the workers don't have."""
        for pdf in batches:
            out = set()
            for v in pdf["value"].tolist():
                for run in re.findall(r"[^\W\d_]+", v.lower()):
                    out.update((v, run[b : b + n]) for b in range(len(run) - 2) for n in range(3, min(LONGEST_WORD, len(run) - b) + 1) if run[b : b + n] not in shared.value)
            if out:
                yield pd.DataFrame(list(out), columns=["value", "w"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = segmenter_of(shared.value)
        for pdf in batches:
            good = [accepted(v, k, segmenter.with_words({x["w"]: x["cost"] for x in own} if own is not None else {})) for v, k, own in zip(pdf["value"], pdf["kind"], pdf["own"], strict=True)]
            yield pdf[["row_id", "line_no", "start", "length"]][good]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, own in zip(pdf["row_id"].tolist(), pdf["own"].tolist(), strict=True):
                lines = {x["start"]: x["line_no"] for x in own}
                out.extend((i, lines[s], s, e - s) for s, e in apart((x["start"], x["start"] + x["length"]) for x in own))
            yield pd.DataFrame(out, columns=["row_id", "line_no", "start", "length"])

    found = cut(usable.mapInPandas(collect, shape + ", value string, kind string"))
    told = found.select("value").distinct().mapInPandas(pieces, "value string, w string").join(words.rest, "w").groupBy("value").agg(F.collect_list(F.struct("w", "cost")).alias("own"))
    judged = found.join(told, "value", "left").mapInPandas(judge, shape)
    return judged.groupBy("row_id").agg(F.collect_list(F.struct("line_no", "start", "length")).alias("own")).mapInPandas(first, shape)


def _usable(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    return rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("row_id is not null")


def credentials(rows: DataFrame, row_id: str, text: str, words: Words) -> DataFrame:
    """``(row_id, line_no, start, length)`` of every credential; positions count code points, lines from 1.

    Null ids and texts are left out; an empty text has no credentials; repeated rows may give repeated equal rows.
    """
    return _spans(_usable(rows, row_id, text).where("text is not null"), words)


def redacted(rows: DataFrame, row_id: str, text: str, words: Words) -> DataFrame:
    """``(row_id, text, credentials)``: every row's text with its credentials replaced, and their number."""
    usable = _usable(rows, row_id, text)
    if words.rest is not None:
        usable = usable.dropDuplicates(["row_id"])
        spans = _spans(usable.where("text is not null"), words).groupBy("row_id").agg(F.collect_list(F.struct("start", "length")).alias("own"))
        usable = usable.join(spans, "row_id", "left")
    shared = rows.sparkSession.sparkContext.broadcast(words.costs)

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = segmenter_of(shared.value)
        for pdf in batches:
            if "own" in pdf:
                spans = [sorted((x["start"], x["start"] + x["length"]) for x in own) if own is not None else [] for own in pdf["own"]]
            else:
                spans = [find_credentials(t, segmenter) if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"row_id": pdf["row_id"], "text": [redact(t, s) if s else t for t, s in zip(pdf["text"], spans, strict=True)], "credentials": [len(s) for s in spans]})

    return usable.mapInPandas(replace, "row_id bigint, text string, credentials int")
