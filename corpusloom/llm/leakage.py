"""Evaluation texts inside corpus texts: size-partitioned MinHash containment search, verified by exact shingles.

A leak is a run of ``run`` consecutive words of an item (the whole item if it is shorter). Every such run is a query
domain: the set of its ``SHINGLE``-word shingles. Runs are partitioned by their size, and for each partition a document
is cut into the windows of that very size, one at every word; a window is a domain no larger than the runs of its
partition. So containment 1 means a Jaccard similarity of 1, and the one MinHash value that is compared misses no
contained run, however long the document around it. Windows that agree in it are verified shingle by shingle, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rolling import window_hashes
from corpusloom.runtime import cut

SHINGLE = 5
#: Words and characters of a piece of an item; pieces overlap, so that every run lies inside one.
PIECE_WORDS, PIECE_CHARS = 500, 20_000
#: Characters of items that are sent to the workers for one pass over the corpus; more items take several passes.
PASS_CHARS = 8_000_000
#: Characters of documents searched at a time.
SLICE_CHARS = 4_000_000
_SIEVE_BITS = 20

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case; anything else only separates."""
    return " ".join(_WORD.findall(text)).lower().split(" ") if text and _WORD.search(text) else []


class Hashes(dict):
    """Word -> hash, kept for the words met lately."""

    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return got

    def of(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(self) > 1_000_000:
            self.clear()
        return out


def least_of_windows(hashes: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``hashes[i:i+span]``, by doubling."""
    n, size, low = len(hashes) - span + 1, 1, hashes
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[span - size : span - size + n])


class SizeClass:
    """The runs of one length: their words, and where each MinHash value stands."""

    def __init__(self, length: int, pieces: list[tuple[int, list[str]]]) -> None:
        self.length, self.width = length, min(SHINGLE, length)
        self.words = [w for _, words in pieces for w in words]
        low, at, items, base = [], [], [], 0
        table = Hashes()
        for item, words in pieces:
            got = least_of_windows(window_hashes(table.of(words), self.width), length - self.width + 1)
            low.append(got)
            at.append(np.arange(base, base + len(got)))
            items.append(np.full(len(got), item, dtype=np.int64))
            base += len(words)
        low, at, items = (np.concatenate(x) for x in (low, at, items))
        order = low.argsort(kind="stable")
        self.low, self.at, self.items = low[order], at[order], items[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.sieve[(self.low >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True

    def candidates(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(position, first, last)``: windows whose MinHash value is that of the runs ``first`` to ``last``."""
        low = least_of_windows(shingles, self.length - self.width + 1)
        pos = np.flatnonzero(self.sieve[(low >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
        first, last = (np.searchsorted(self.low, low[pos], side=side) for side in ("left", "right"))
        hit = first < last
        yield from zip(pos[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True)


def size_classes(pieces: list[tuple[int, str]], run: int) -> list[SizeClass]:
    by: dict[int, list[tuple[int, list[str]]]] = {}
    for item, text in pieces:
        words = words_of(text)
        if words:
            by.setdefault(min(run, len(words)), []).append((item, words))
    return [SizeClass(length, own) for length, own in sorted(by.items())]


def leaks_in(texts: list[str], classes: list[SizeClass], table: Hashes) -> list[tuple[int, int]]:
    """``(index of the text, item)`` pairs."""
    lists = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in lists], dtype=np.int64)
    ends = np.cumsum(counts)
    words = [w for own in lists for w in own]
    values = table.of(words)
    shingles: dict[int, np.ndarray] = {}
    found = set()
    for c in classes:
        if c.width not in shingles:
            shingles[c.width] = window_hashes(values, c.width)
        doc = 0
        for at, first, last in c.candidates(shingles[c.width]):
            while ends[doc] <= at:
                doc += 1
            if at + c.length > ends[doc]:
                continue  # the window runs over the end of its text
            window = words[at : at + c.length]
            for k in range(first, last):
                q = int(c.at[k])
                if c.words[q : q + c.length] == window:
                    found.add((doc, int(c.items[k])))
    return sorted(found)


def pieces_of(text: str, run: int) -> Iterator[str]:
    """The words of an item in overlapping pieces that hold every run; bounded unless single words are beyond it."""
    words, begin = words_of(text), 0
    while begin < len(words):
        end, size = begin, 0
        while end < len(words) and (end - begin < 2 * run or (end - begin < PIECE_WORDS and size < PIECE_CHARS)):
            size += len(words[end]) + 1
            end += 1
        yield " ".join(words[begin:end])
        if end == len(words):
            return
        begin = end - run + 1


def leaked_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, run: int = 12, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``(doc_id, item_id)``: the document holds ``run`` consecutive words of the item, or the whole shorter item.

    Items come in passes of about ``pass_chars`` characters, each searched for in one scan of the documents without a
    shuffle of their texts, so what is sent to the workers never grows with the data. Null ids or texts and items
    without words take no part; repeated rows count once; empty tables give no rows.
    """
    spark = documents.sparkSession
    usable = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, n, p) for i, t in zip(pdf["i"].tolist(), pdf["t"].tolist(), strict=True) for n, p in enumerate(pieces_of(t, run))]
            yield pd.DataFrame(out, columns=["i", "n", "p"])

    pieces = cut(usable.mapInPandas(split, "i bigint, n int, p string"))
    passes = max(1, -(-(pieces.agg(F.sum(F.length("p"))).first()[0] or 0) // pass_chars))
    out = None
    for one in range(passes):
        part = [(r["i"], r["p"]) for r in pieces.where(F.pmod(F.xxhash64("i", "n"), F.lit(passes)) == one).collect()]
        classes = size_classes(part, run)
        if not classes:
            continue
        shared = spark.sparkContext.broadcast(classes)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            table = Hashes()
            for pdf in batches:
                sizes = pdf["text"].str.len().cumsum().to_numpy()
                for _, some in pdf.groupby(sizes // SLICE_CHARS, sort=False):
                    got = leaks_in(some["text"].tolist(), shared.value, table)
                    if got:
                        ids = some["doc_id"].to_numpy()
                        yield pd.DataFrame({"doc_id": [ids[d] for d, _ in got], "item_id": [i for _, i in got]})

        found = corpus.mapInPandas(search, "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
