"""Generated, minified, vendored and data-only source files.

Every file becomes two sets of five-token shingles: one over its tokens, one over the same tokens with identifiers,
numbers and strings masked. MinHash signatures of both are banded; any two files that share a band are linked if their
shingles' exact Jaccard similarity is SIMILAR, and links are joined into clusters. Clusters are read as follows:

* masked alike, tokens not: one tool wrote a family of files, if members bear a tool's or data's mark, or if a family
  stands in one directory of a repository (three differing members, or two beside a mark);
* tokens alike across repositories: copies of a third party's file (vendoring), small patches included;
* nothing but masked literals: data stored as code, shown by a file's size or by three differing members of a family.

A family may also lie within one file, as the same masked unit over and over; the share of distinct masked shingles
tells. Headers (generator banners, foreign licence notices) and the shape of lines (minified text) complete the evidence. Mentions of generators inside code, and banners that say the
file is kept by hand, are no evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.rolling import mix, window_hashes
from corpusloom.operators.components import connected_components
from corpusloom.runtime import cut, release

SHINGLE = 5
SIMILAR = 0.8
#: Values of a signature; BANDS bands of ROWS values: a pair at 0.8 shares a band with probability 0.9999.
ROWS, BANDS = 5, 24
#: Pairs are compared by four bits of each value, which agree by chance in a sixteenth of the others. A pair at 0.8 agrees
#: in fewer than AGREE of all values with probability 2e-5, in fewer than LEAST of the FIRST (large bands) with 8e-6.
AGREE = 79
FIRST, LEAST = 40, 21
#: Half-bytes that tell of 4 * COUNTS buckets of a file's shingles whether each holds an odd number. Buckets that differ
#: between two files bound from below how many shingles only one of them has.
COUNTS = 96
#: Files of one band that meet all others of it by columns of their signatures at once; smaller bands go together.
STRIP = 64
#: Pairs that are looked at together, and rows that come together.
PAIRS, ROWS_HELD = 100_000, 8192
#: Files whose shingle sets are held at a time while the pairs of one band are verified.
BLOCK = 16_384
#: Fewer tokens say too little to tell a family or a copy.
LEAST_TOKENS = 30
#: So many differing members of one directory, or of literals only, are a family by themselves; fewer may be coincidence.
FAMILY = 3
#: Largest share of distinct masked shingles in a file that repeats one unit.
REPEATED = 0.35

# Words that keep their place when identifiers are masked; fixed values.
_KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue debugger def default del delete do elif else except export extends finally for from function global if import in instanceof is lambda let new nonlocal not of or pass raise return super switch this throw true try typeof var void while with yield none false null undefined self".split()
)
# Names and signs come first, since most tokens are such; quotes, slashes and hashes begin longer tokens.
_TOKEN = re.compile(
    r"[A-Za-z_][\w$]*+|[(),.:=\[\]{}+*<>!;&|%?@^~-]|[^\W\d][\w$]*+|\d[\w.]*+|\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"|'''(?:[^']|'(?!''))*'''"
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|`[^`\\]*+(?:\\.[^`\\]*+)*+`|#[^\n]*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[^\s\w]"
)
#: The same with the blanks before it; at the end there may be blanks alone.
_SPACED = re.compile(rf"\s*+({_TOKEN.pattern}|\Z)")
_BANNER = re.compile(r"\bgenerated\b|auto-?generated|@generated|machine[- ]generated|do not (?:edit|modify|touch)|\bproduced (?:from|by)\b.*\bby\b|erzeugt|generiert|généré|generado|autogenerad|nicht (?:bearbeiten|ändern)|code generator|changes will be (?:lost|overwritten)", re.I)
_BY_HAND = re.compile(r"used to be|no longer|by hand|hand-?(?:written|maintained|made)|maintained|without (?:telling|asking)|was (?:once|formerly)|not generated|von hand|formerly", re.I)
_NOTICE = re.compile(r"\(c\)|©|copyright|licen[cs]ed? |licen[cs]e\b|spdx-", re.I)
# Below a file's head a line must say more than that something is generated, or that licences exist.
_BANNER_BELOW = re.compile(r"@generated|auto-?generated|machine[- ]generated|\bgenerated (?:by|from|with|using|automatically|file|code)\b|\bproduced (?:from|by)\b.*\bby\b|(?:datei|fichier|archivo).*(?:erzeugt|generiert|généré|generado|autogenerad)|changes will be (?:lost|overwritten)", re.I)
_SHOUTED = re.compile(r"DO NOT (?:EDIT|MODIFY|TOUCH)")
_NOTICE_BELOW = re.compile(r"(?:\(c\)|©|copyright(?: \(c\)| ©)? \d{4})|spdx-license", re.I)
#: What each of the three patterns holds one of, in lower case.
_ORIGIN = ("generated", "produced", "erzeugt", "generiert", "généré", "generado", "changes will be", "do not ", "(c)", "©", "copyright", "spdx")
_LOCK = re.compile(r"(?:^|/)(?:[\w-]+[.-])?(?:package-lock|lock|shrinkwrap|npm-shrinkwrap)\.(?:json|toml|yaml)$", re.I)
_MIGRATION = re.compile(r"(?:^|/)migrations/\d{3,}_\w+\.py$")


#: Kinds of masked tokens by number. Signs that lists are made of and words that make a file more than data have
#: numbers in ranges of their own; other keywords and signs are numbered by hash.
NAME, NUMBER, STRING, COMMENT = 1, 2, 3, 4
_LIST_SIGNS = {c: 6 + n for n, c in enumerate(",[](){}-")}
_DEFINES = {w: 20 + n for n, w in enumerate("def class function return if for while import lambda async await try raise throw new switch with".split())}
LISTED_END, DEFINES_FROM, DEFINES_END = 20, 20, 40
#: Other keywords and signs stand for themselves.
OTHER = 63
#: Tokens whose hashes a task remembers.
TABLE = 1 << 20
#: Shingles whose values are found together.
TOGETHER = 1 << 14


def _kind(token: str) -> int:
    """The number of what stands in a token's place once identifiers, numbers, strings and comments are masked."""
    c = token[0]
    if c.isalpha() or c == "_":
        return NAME if token.lower() not in _KEYWORDS else _DEFINES.get(token, OTHER)
    if c.isdigit():
        return NUMBER
    if c in "'\"`" and len(token) > 1:
        return STRING
    if c == "#" or (c == "/" and len(token) > 1):
        return COMMENT
    return _LIST_SIGNS.get(token, OTHER)


class Tokens(dict):
    """Token -> its hash, with its kind in the lowest six bits. Begins anew when it holds TABLE tokens."""

    def __missing__(self, token: str) -> int:
        try:
            value = xxhash.xxh64_intdigest(token)
        except UnicodeEncodeError:
            value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        value = self[token] = value & ~63 | _kind(token)
        return value

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' hashes, and what is left of them once masked: the kind, or the hash of OTHER."""
        if len(self) > TABLE:
            self.clear()
        values = np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        kinds = values & np.uint64(63)
        return values, np.where(kinds == OTHER, values, kinds)


_SEEDS = (mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def least_values(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each set of shingles under each function. The hashes are mixed already, so a
    multiplication for each value tells as much as independent functions do (see the tests)."""
    least = np.empty((len(_SEEDS), len(sets)), dtype=np.uint32)
    ends = np.cumsum([len(x) for x in sets])
    at = 0
    while at < len(sets):
        begin = int(ends[at]) - len(sets[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
        joined, starts = np.concatenate(sets[at:to]), np.concatenate(([0], ends[at : to - 1] - begin))
        value = np.empty_like(joined)
        for seed, row in zip(_SEEDS, least, strict=True):
            np.minimum.reduceat(np.multiply(joined, seed, out=value), starts, out=row[at:to])
        at = to
    return least.T


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes; 16 bits of each are kept, enough to compare and to band."""
    return _kept(least_values([upper(shingles)])[0])


def _kept(least: np.ndarray) -> np.ndarray:
    return (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def windows_of(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The hashes of each part's shingles; all parts are hashed at once."""
    if not parts:
        return []
    hashes = window_hashes(np.concatenate(parts), SHINGLE)
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return [hashes[e - len(p) : max(e - len(p), e - SHINGLE + 1)] for p, e in zip(parts, ends, strict=True)]


def upper(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of hashes by their upper 32 bits, in order."""
    high = np.sort((hashes >> np.uint64(32)).astype(np.uint32))
    return high[np.concatenate(([True], high[1:] != high[:-1]))]


def shingle_set(hashes: np.ndarray) -> bytes:
    """The same as bytes."""
    return upper(hashes).tobytes()


def similar(common, sizes):  # noqa: ANN001, ANN201
    """Whether sets that share ``common`` members and have ``sizes`` together reach a Jaccard similarity of SIMILAR."""
    return common * (1 + SIMILAR) >= SIMILAR * sizes - 1e-9


def tokens_of(text: str) -> list[str]:
    """All tokens of a text, as _TOKEN finds them."""
    tokens = _SPACED.findall(text)
    while tokens and not tokens[-1]:
        tokens.pop()
    return tokens


def _comments(text: str) -> str:
    """The comment lines at the head of a file."""
    kept, inside = [], False
    for line in map(re.Match.group, re.finditer(r"[^\n]+", text)):
        s = line.strip()
        if not s and not inside:
            continue
        if inside or s.startswith(("#", "//", "/*", "<!--", "*", ";", "--")):
            kept.append(s)
            inside = (inside or s.startswith("/*")) and "*/" not in s
        else:
            break
    return "\n".join(kept)


def _comments_below(text: str, tokens: list[str], masked: np.ndarray) -> list[str]:
    """The lines of all comments that begin at the left margin, of texts that tell something about their origin at all."""
    low = text.lower()
    if not any(word in low for word in _ORIGIN):
        return []
    margin = [tokens[i] for i in np.flatnonzero(masked == COMMENT).tolist()]
    return [line for c in margin if text.startswith(c) or f"\n{c}" in text for line in c.split("\n")]


def _defines(masked: np.ndarray) -> bool:
    return bool(((masked >= DEFINES_FROM) & (masked < DEFINES_END)).any())


def _literal_only(masked: np.ndarray) -> bool:
    """Whether a file is literals, the signs of lists and hardly a name."""
    literals, names = np.count_nonzero(masked == NUMBER) + np.count_nonzero(masked == STRING), np.count_nonzero(masked == NAME)
    return literals > 0 and names <= 3 + 0.1 * literals and not _defines(masked)


def _repeats_a_unit(masked: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether a file is one masked unit over and over; stretches of a mere list of literals don't count."""
    plain = np.concatenate(([0], np.cumsum((masked < LISTED_END) & (masked != NAME) & (masked != COMMENT))))
    worded = hashes[(plain[SHINGLE:] - plain[:-SHINGLE])[: len(hashes)] < SHINGLE]
    if len(worded) < LEAST_TOKENS:
        return False
    worded = np.sort(worded)
    return 1 + np.count_nonzero(worded[1:] != worded[:-1]) <= REPEATED * len(worded)


def evidence(path: str, text: str, tokens: list[str], masked: np.ndarray, hashes: np.ndarray) -> str | None:
    """What a file alone shows: ``tool``, ``minified``, ``data`` or ``vendored``, else None."""
    ext = path[path.rfind(".") :].lower()
    program = ext not in (".json", ".toml", ".md", ".txt", ".yaml", ".yml", ".cfg", ".ini", ".rst")
    stripped = text.strip()
    if not stripped or stripped[0] == "<" or ext == ".md":
        return None
    if _LOCK.search(path) or (ext in (".json", ".toml") and '"lockfileVersion"' in text):
        return "tool"
    head = _comments(text)
    if head:
        banner = [line for n, line in enumerate(head.split("\n")) if (_BANNER.search(line) if n < 8 else _BANNER_BELOW.search(line) or _SHOUTED.search(line))]
        if banner and not any(_BY_HAND.search(line) for line in banner):
            return "tool"
    below = _comments_below(text, tokens, masked)
    if any((_BANNER_BELOW.search(line) or _SHOUTED.search(line)) and not _BY_HAND.search(line) for line in below):
        return "tool"
    if _MIGRATION.search(path) and ("Migration" in text or "upgrade(" in text):
        return "tool"
    if (program or ext == ".json") and len(stripped) > 400 and max(map(len, stripped.split("\n"))) > 400:
        longest = [len(line) for line in stripped.split("\n") if line.strip()]
        packed = sum(n for n in longest if n > 400)
        if packed > (0.5 if program else 0.9) * sum(longest) and stripped.count(" ") + stripped.count("\n") < 0.2 * len(stripped):
            literal = int(((masked == NUMBER) | (masked == STRING)).sum())
            return "data" if program and literal >= 20 and not _defines(masked) else "minified"
    if not program:
        return None
    if _literal_only(masked):
        literals = int(((masked == NUMBER) | (masked == STRING)).sum())
        kinds = masked.tolist()
        size = sum(len(t) for t, m in zip(tokens, kinds, strict=True) if m in (NUMBER, STRING))
        told = sum(len(t) for t, m in zip(tokens, kinds, strict=True) if m == NAME)
        if size + literals >= 300 and told < 0.15 * size:
            return "data"
    if _repeats_a_unit(masked, hashes):
        return "tool"
    if head and _NOTICE.search(head) and re.search(r"authors|contributors|\(c\)|©|copyright|https?://|spdx", head, re.I):
        return "vendored"
    if any(_NOTICE_BELOW.search(line) for line in below):
        return "vendored"
    return None


_SHAPE = "file_id bigint, repo string, place string, listed boolean, shown string, raw_key binary, masked_key binary, raw binary, masked binary, raw_set binary, masked_set binary"
#: Rows of a table that may be broadcast after its size was counted.
FEW = 500_000


def file_marks(files: DataFrame, file_id: str, repo: str, path: str, content: str) -> DataFrame:
    """Own evidence and both signatures of every file, with a key of 128 bits each that equal signatures have in common."""
    usable = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(content).alias("text")).where("file_id is not null")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Tokens()
        for pdf in batches:
            files = []
            for i, r, p, t in zip(pdf["file_id"].tolist(), pdf["repo"].tolist(), pdf["path"].tolist(), pdf["text"].tolist(), strict=True):
                p, t = (p or "").replace("\\", "/"), t or ""
                low = p.lower()
                if not low.endswith(".md"):
                    tokens = tokens_of(t)
                    values, masked = table.of(tokens)
                    files.append((i, r, p, low, t, tokens, masked, values[masked != COMMENT]))
            every, own = windows_of([f[6] for f in files]), windows_of([f[7] for f in files])
            out, kept, distinct = [], [], []
            for (i, r, p, low, t, tokens, masked, _), hashes, plain in zip(files, every, own, strict=True):
                shown = evidence(p, t, tokens, masked, hashes)
                clustered = len(plain) > 0 and len(tokens) >= LEAST_TOKENS and low.endswith((".py", ".js")) and t.lstrip()[:1] != "<"
                sets = (None, None)
                if clustered:
                    distinct += [upper(plain), upper(hashes)]
                    sets = distinct[-2].tobytes(), distinct[-1].tobytes()
                    kept.append(len(out))
                if shown or clustered:
                    out.append([i, r, low[: low.rfind("/") + 1] + low[low.rfind(".") :], clustered and _literal_only(masked), shown, None, None, None, None, *sets])
            signatures = _kept(least_values(distinct)) if distinct else []
            for n, at in enumerate(kept):
                raw, alike = signatures[2 * n].tobytes(), signatures[2 * n + 1].tobytes()
                out[at][5:9] = xxhash.xxh3_128_digest(raw), xxhash.xxh3_128_digest(alike), raw, alike
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SHAPE.split(", ")])

    return usable.mapInPandas(mark, _SHAPE)


def _earlier(first: np.ndarray, size: np.ndarray, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(x, y)``, y < x: rows of one band from ``begin`` on and the earlier rows that may be similar by their FIRST values."""
    columns = np.ascontiguousarray(first.T)
    for at in range(begin, len(size), STRIP):
        end = min(at + STRIP, len(size))
        low = int(np.searchsorted(size, SIMILAR * size[at] - 1e-9))
        agree = np.zeros((end - at, end - low), dtype=np.uint8)
        for c in columns:
            agree += c[at:end, None] == c[None, low:end]
        x, y = np.nonzero(agree >= LEAST)
        x, y = x + at, y + low
        keep = (y < x) & (size[y] >= SIMILAR * size[x])
        yield x[keep], y[keep]


def shared_band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(a, b, band, n)``: pairs of a band that may be similar. The rows of a band come together, by size; every row
    meets all earlier ones until their size alone forbids SIMILAR, across batches too. Only such rows of one band are held."""
    band, cls, size, n = (np.empty(0, np.int64) for _ in range(4))
    brief, odd = np.empty((0, 8), np.uint64), np.empty((COUNTS // 16, 0), np.uint64)  # four bits of each value; the buckets, by words
    for pdf in _gathered(batches):
        new = [pdf[c].to_numpy(np.int64) for c in ("band", "cls", "size", "n")]
        told = np.frombuffer(b"".join(pdf["brief"]), dtype=np.uint8).reshape(len(pdf), -1)
        values = np.zeros((len(pdf), 64), np.uint8)
        values[:, : ROWS * BANDS // 2] = told[:, : ROWS * BANDS // 2]
        buckets = np.ascontiguousarray(told[:, ROWS * BANDS // 2 :]).view(np.uint64).T
        keep = (band == new[0][0]) & (size >= SIMILAR * new[2][0])
        old = int(keep.sum())
        band, cls, size, n = (np.concatenate((x[keep], y)) for x, y in zip((band, cls, size, n), new, strict=True))
        brief, odd = np.concatenate((brief[keep], values.view(np.uint64))), np.concatenate((odd[:, keep], buckets), axis=1)

        def near_by(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pairs that may be similar by their buckets."""
            both = size[x] + size[y]
            apart = np.bitwise_count(odd.take(x, 1) ^ odd.take(y, 1)).sum(0, dtype=np.int64)
            keep = similar((both - apart) / 2, both)
            return x[keep], y[keep]

        def similar_of(met: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            """The pairs that agree in AGREE values by their four bits."""
            x, y = (np.concatenate(z) for z in zip(*met, strict=True))
            differ = brief.take(x, 0) ^ brief.take(y, 0)
            differ |= differ >> np.uint64(2)
            differ |= differ >> np.uint64(1)
            differ &= np.uint64(0x1111111111111111)
            keep = np.bitwise_count(differ).sum(1, dtype=np.int64) <= ROWS * BANDS - AGREE
            x, y = x[keep], y[keep]
            return pd.DataFrame({"a": np.minimum(cls[x], cls[y]), "b": np.maximum(cls[x], cls[y]), "band": band[x], "n": n[x]})

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            edges = np.concatenate(([0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(band)]))
            large = np.flatnonzero(n[edges[:-1]] > STRIP)
            for s, e in zip(edges[large].tolist(), edges[large + 1].tolist(), strict=True):
                first = brief[s:e].view(np.uint8)[:, : FIRST // 2]
                first = np.concatenate((first & 15, first >> 4), axis=1)
                for x, y in _earlier(first, size[s:e], max(0, old - s)):
                    yield x + s, y + s
            near, d = np.arange(old, len(band)), 0
            near = near[n[near] <= STRIP]
            while True:
                d += 1
                near = near[near >= d]
                near = near[(band[near - d] == band[near]) & (size[near - d] >= SIMILAR * size[near])]
                if not len(near):
                    break
                yield near, near - d

        met, held = [], 0
        for x, y in pairs():
            for at in range(0, len(x), PAIRS):
                met.append(near_by(x[at : at + PAIRS], y[at : at + PAIRS]))
                held += len(met[-1][0])
                if held > PAIRS:
                    yield similar_of(met)
                    met, held = [], 0
        if held:
            yield similar_of(met)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ROWS_HELD rows or more, but for the last."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf):
            held.append(pdf)
        if sum(map(len, held)) >= ROWS_HELD:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose exact Jaccard similarity is SIMILAR. A group's sets come before its pairs and are held."""
    key, sets = None, {}
    for pdf in batches:
        good = []
        for band, p, q, a, b, held in zip(*(pdf[c].tolist() for c in ("band", "p", "q", "a", "b", "set")), strict=True):
            if (band, p, q) != key:
                key, sets = (band, p, q), {}
            if held is not None:
                sets[a] = frozenset(np.frombuffer(held, dtype=np.uint32).tolist())
            else:
                x, y = sets[a], sets[int(b)]
                if similar(len(x & y), len(x) + len(y)):
                    good.append((a, int(b)))
        yield pd.DataFrame(good, columns=["a", "b"])


def brief_of(signatures: np.ndarray, sets: list[np.ndarray]) -> list[bytes]:
    """Four bits of each signature value, two to a byte, and a bit for each bucket of shingles."""
    buckets = 4 * COUNTS
    place = np.concatenate(sets) % np.uint32(buckets) + np.repeat(np.arange(len(sets)) * buckets, [len(x) for x in sets])
    odd = np.packbits((np.bincount(place, minlength=len(sets) * buckets) & 1).astype(np.uint8).reshape(len(sets), buckets), axis=1)
    low = (signatures & np.uint16(15)).astype(np.uint8)
    return [x.tobytes() for x in np.concatenate((low[:, ::2] | low[:, 1::2] << 4, odd), axis=1)]


def _links(marks: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(file_id, cls)`` and ``(a, b)``: files of equal signatures are one class, named by its smallest file; any two
    classes that share a band are linked if the exact Jaccard similarity of their shingle sets is SIMILAR."""
    keys = marks.where(F.col(column).isNotNull()).select("file_id", F.col(f"{column}_key").alias("key"))
    classes = cut(keys.join(keys.groupBy("key").agg(F.min("file_id").alias("cls")), "key").select("file_id", "cls"))
    copies = classes.where("file_id <> cls").select("file_id").distinct()
    few = copies.limit(FEW + 1).count() <= FEW
    heads = marks.where(F.col(column).isNotNull()).select("file_id", F.col(column).alias("sig"), F.col(f"{column}_set").alias("set"))
    sets = heads.select(F.col("file_id").alias("cls"), "set")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), -1)
                m = sig.reshape(len(pdf), BANDS, ROWS).astype(np.uint64)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None], m.shape[:2])
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r] + np.uint64(1))
                shingles = [np.frombuffer(x, dtype=np.uint32) for x in pdf["set"]]
                yield pd.DataFrame({"cls": pdf["file_id"], "bands": list(h.view(np.int64)), "brief": brief_of(sig, shingles), "size": [len(x) for x in shingles]})

    own = heads.join(F.broadcast(copies) if few else copies, "file_id", "left_anti")
    told = cut(own.mapInPandas(tell, "cls bigint, bands array<bigint>, brief binary, size int"))
    banded = told.select("cls", F.explode("bands").alias("band")).withColumn("n", F.count("*").over(Window.partitionBy("band")))
    met = banded.where("n > 1").join(told.select("cls", "brief", "size"), "cls")
    pairs = met.repartition("band").sortWithinPartitions("band", "size", "cls").mapInPandas(shared_band, "a bigint, b bigint, band bigint, n bigint")
    # A pair is verified once, in the largest of its bands, so that a file's shingle set travels with few bands.
    pairs = pairs.where("a <> b").groupBy("a", "b").agg(F.max("n").alias("n"), F.max_by("band", "n").alias("band"))
    block = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("n") / BLOCK))
    pairs = cut(pairs.select("a", "b", "band", F.least(block("a"), block("b")).alias("p"), F.greatest(block("a"), block("b")).alias("q")))
    release(told)  # its disk is needed for the other kind
    members = pairs.select("band", "p", "q", F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls").select("band", "p", "q", F.col("cls").alias("a"), F.lit(None).cast("bigint").alias("b"), "set")
    both = members.unionByName(pairs.withColumn("set", F.lit(None).cast("binary")))
    good = both.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", F.col("b").isNotNull()).mapInPandas(verified, "a bigint, b bigint")
    return classes, good


def unwritten_files(files: DataFrame, file_id: str, repo: str, path: str, content: str) -> DataFrame:
    """``(file_id, reason)`` of every file that nobody in its repository wrote by hand.

    Reasons: ``tool``, ``minified``, ``data``, ``vendored``. Repeated rows of an id count once; null ids are left out;
    null or empty content, markup saved under a program's name and notes (.md) are never cases.
    """
    marks = cut(file_marks(files, file_id, repo, path, content))  # a repeated row repeats its marks, which changes no pair
    shown = marks.where("shown is not null").select("file_id", F.col("shown").alias("reason"))
    named = marks.where("raw is not null").select("file_id", "repo", "place", "listed", "shown").dropDuplicates(["file_id"])

    # The links of both kinds are joined into clusters in one go; a class is numbered 2 * file + kind.
    classes, links = zip(*(_links(marks, column) for column in ("raw", "masked")), strict=True)
    number = lambda c, kind: F.col(c) * 2 + kind
    joined = cut(connected_components(reduce(DataFrame.unionAll, (x.select(number("a", k).alias("a"), number("b", k).alias("b")) for k, x in enumerate(links))), "a", "b", "v", "cluster"))

    def clustered(kind: int, name: str) -> DataFrame:
        told = classes[kind].withColumn("v", number("cls", kind)).join(joined, "v", "left")
        return told.groupBy("file_id").agg(F.min(F.coalesce("cluster", "v")).alias(name))

    alike = cut(named.join(clustered(0, "c"), "file_id").join(clustered(1, "f"), "file_id"))
    # Copies across repositories, equal signatures included.
    spread = alike.groupBy("c").agg(F.min("repo").alias("r1"), F.max("repo").alias("r2"), F.max(F.when(F.col("shown") == "vendored", 1).otherwise(0)).alias("noted"))
    vendored = alike.join(spread.where("r1 <> r2 or noted = 1").select("c"), "c").select("file_id", F.lit("vendored").alias("reason"))

    # Families: masked alike, but several different token clusters. Two members that are at least half show a tool's or
    # data's mark; or the members in one directory differ among themselves; or all are literals only.
    kin = alike
    marked = F.col("shown").isin("tool", "data")
    size = kin.groupBy("f").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n"), F.max(F.when(marked, F.col("shown"))).alias("mark"), F.count_if(marked).alias("marked"))
    families = kin.join(size.where("c1 <> c2 and marked >= 2 and marked * 2 >= n").select("f", "mark"), "f").select("file_id", F.col("mark").alias("reason"))
    apart = kin.where("shown is null or shown in ('tool', 'data')")
    local = apart.groupBy("f", "repo", "place").agg(F.count_distinct("c").alias("differ"), F.max(F.when(marked, F.col("shown"))).alias("mark"), F.every("listed").alias("listed"))
    own = local.where((F.col("differ") >= FAMILY) | (F.col("differ") >= 2) & F.col("mark").isNotNull()).withColumn("reason", F.coalesce("mark", F.when(F.col("listed"), "data").otherwise("tool")))
    within = apart.join(own.select("f", F.col("repo").alias("r"), F.col("place").alias("p"), "reason"), "f").where("repo <=> r and place = p").select("file_id", "reason")
    lists = apart.where("listed").groupBy("f").agg(F.count_distinct("c").alias("differ")).where(F.col("differ") >= FAMILY).select("f")
    listed = apart.where("listed").join(lists, "f").select("file_id", F.lit("data").alias("reason"))
    every = shown.unionAll(vendored).unionAll(families).unionAll(within).unionAll(listed)
    return every.groupBy("file_id").agg(F.min("reason").alias("reason"))
