"""JSON objects inside replies that are not quite JSON: brackets walked once, mended in the order the job tries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_SIGNS = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]', re.S)
_CLOSES = {"]": "[", "}": "{"}
_COMMA = re.compile(r",(\s*[}\]])")


def extracted(text: str | Column) -> Column:
    """Fences dropped, then everything from the first to the last brace; without braces the trimmed text."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^```(?:json)?\s*", ""), r"(?m)```\s*$", "")
    held = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(held != "", held).otherwise(F.regexp_replace(bare, r"^\s+|\s+$", ""))


def _parsed(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), sort_keys=True)
    except (ValueError, RecursionError):
        return None


def _without_stray_closer(text: str) -> Iterator[str]:
    """The text less one closer that nothing opens, for each such closer."""
    opened: list[str] = []
    for sign in _SIGNS.finditer(text):
        what = sign.group()
        if what in ("[", "{"):
            opened.append(what)
        elif what in _CLOSES:
            if opened and opened[-1] == _CLOSES[what]:
                opened.pop()
            else:
                yield text[: sign.start()] + text[sign.end() :]


def repaired(text: str | None) -> str | None:
    """The parsed object in canonical form, mended where needed: a stray closer, trailing commas, missing closers."""
    if not text:
        return None
    if (plain := _parsed(text)) is not None:
        return plain
    for attempt in _without_stray_closer(text):
        if (got := _parsed(attempt)) is not None:
            return got
    if (got := _parsed(_COMMA.sub(r"\1", text))) is not None:
        return got
    missing = {c: text.count(o) - text.count(c) for c, o in _CLOSES.items()}
    if max(missing.values()) > 0:
        return _parsed(text + "".join(c * max(0, n) for c, n in missing.items()))
    return None


def repair_json(text: str | Column) -> Column:
    """``repaired`` over a column, in Arrow batches."""

    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(repaired)

    return F.pandas_udf(mend, StringType())(text)


def is_json(text: str | Column) -> Column:
    """Whether a text is JSON to the letter; built-in readers let trailing text or commas pass."""

    def strict(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and _parsed(t) is not None).astype(bool)

    return F.pandas_udf(strict, BooleanType())(text)
