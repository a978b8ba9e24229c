"""Long exact spans shared between records, by suffix automata over reference shards.

Any span of ``min_len`` characters holds at least one anchor: the smallest hash among the ``GRAM``-grams of that
span (winnowing). The anchors decide which records can share a span at all, so instead of broadcasting automata of
the whole collection to every document, records are brought together by anchor. All records that hold an anchor
form its reference shard: a generalised suffix automaton over anchor-aligned pieces of their surroundings. The shard's
documents are streamed through it; the matching statistics give, for every pair, how far the match reaches to either
side, and the last piece is settled character by character. So the result is exact and no shard is broadcast.

Equal texts are one class and are compared once. An anchor held more than ``BLOCK`` times is too common to compare
its holders with each other: its shard is split further by the hashes of the ``min_len``-grams around it, so that only
records that do share a span meet. Where even those are more than ``BLOCK``, they are split into blocks, each pair of
blocks being a shard of its own: such groups are pairs of the result and spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.rolling import code_points, window_argmin, window_hashes
from corpusloom.runtime import cut

GRAM = 100
BLOCK = 256
#: Characters of one automaton symbol.
PIECE = 25
#: Characters of text hashed at a time by one task.
SLICE_CHARS = 4_000_000


class SuffixAutomaton:
    """Generalised suffix automaton; ``mask`` of a state has a bit for each reference that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.mask = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.mask.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.mask[clone] = self.mask[q]
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: list[str], bit: int) -> None:
        last = 0
        for symbol in symbols:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
            else:
                now, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = now
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                last = now
            state = last
            while state > 0 and not self.mask[state] & bit:
                self.mask[state] |= bit
                state = self.link[state]

    def statistics(self, symbols: list[str]) -> Iterator[tuple[int, int, int]]:
        """For each symbol: ``(index, state, length)`` of the longest reference string that ends there."""
        state, length = 0, 0
        for i, symbol in enumerate(symbols):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            nxt = self.next[state].get(symbol)
            if nxt is None:
                state, length = 0, 0
            else:
                state, length = nxt, length + 1
            yield i, state, length


def _pieces(context: str, at: int, gram: int) -> tuple[list[str], int]:
    """The surroundings cut into pieces counted from the anchor outwards, and the anchor's index."""
    left = [context[i : i + PIECE] for i in range(at % PIECE, at, PIECE)]
    end = at + gram
    right = [context[i : i + PIECE] for i in range(end, len(context) - PIECE + 1, PIECE)]
    return [*left, context[at:end], *right], len(left)


def shard_matches(contexts: list[tuple[str, int]], gram: int, min_len: int) -> Iterator[tuple[int, int, int, int]]:
    """``(i, j, left, right)`` with i < j: how many characters before and after the anchor two contexts share.

    Each context is streamed through the automaton of those before it. The states on the suffix chain at the anchor
    give what precedes it in common with each reference; at a later piece, the shallowest state that still reaches
    back to the anchor holds every reference that shares all the pieces up to there.
    """
    automaton = SuffixAutomaton()
    link, length_of, mask = automaton.link, automaton.length, automaton.mask
    for n, (text, at) in enumerate(contexts):
        symbols, anchor = _pieces(text, at, gram)
        back: dict[int, int] = {}
        holders: list[int] = []
        for i, state, matched in automaton.statistics(symbols) if n else ():
            ahead, widest = i - anchor, 0
            if ahead < 0:
                continue
            while state > 0 and matched > ahead:
                if ahead == 0:
                    for one in _bits(mask[state] & ~widest):
                        back[one] = matched - 1
                widest |= mask[state]
                state = link[state]
                matched = length_of[state]
            if not widest:
                break
            holders.append(widest)
        seen = 0
        for ahead in range(len(holders) - 1, -1, -1):
            for m in _bits(holders[ahead] & ~seen):
                left, right = back[m] * PIECE, gram + ahead * PIECE
                if left + right + 2 * (PIECE - 1) < min_len:
                    continue
                other, at2 = contexts[m]
                while left < at and left < at2 and text[at - left - 1] == other[at2 - left - 1]:
                    left += 1
                most = min(len(text) - at, len(other) - at2)
                while right < most and text[at + right] == other[at2 + right]:
                    right += 1
                if left + right >= min_len:
                    yield m, n, left, right
            seen |= holders[ahead]
        if n + 1 < len(contexts):
            automaton.add(symbols, 1 << n)


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _batched(pdf: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    sizes = pdf[text].str.len().cumsum().to_numpy()
    for _, part in pdf.groupby(sizes // SLICE_CHARS, sort=False):
        yield part


def shared_spans(records: DataFrame, id_col: str, text_col: str, group_cols: list[str] | None = None, *, min_len: int = 200, pairs: bool = True) -> dict[str, DataFrame]:
    """Exact spans of ``min_len`` or more characters that stand in more than one record.

    Returns ``members`` (id, cls, grp, n_chars): every record and the class of its text; ``spans`` (a, b, a_start, a_end,
    b_start, b_end): matches between two classes, a < b, at least one row for every stretch of ``min_len`` characters
    the two share; matches reach at most ``min_len - GRAM`` beyond their anchor, so longer spans are unions of rows. Without
    ``pairs`` what stands around anchors too common to compare all their holders is not paired but marked: ``marks``
    (cls, s, e) tells stretches that stand in another class too, whichever that is; else it is empty.

    Null ids and null texts are left out; repeated rows of an id count once (of different texts the one with the
    smallest digest stays). Texts shorter than ``min_len`` have no spans. An empty table gives empty results.
    """
    gram = min(GRAM, max(1, min_len // 2))
    window, reach = min_len - gram + 1, min_len - gram
    grp = F.to_json(F.struct(*group_cols)) if group_cols else F.col(id_col).cast("string")
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), grp.alias("grp")).where("id is not null and text is not null").withColumn("digest", F.sha2("text", 256))
    members = rows.groupBy("id").agg(F.min(F.struct("digest", "grp", F.length("text").alias("n_chars"))).alias("m")).select("id", "m.*")
    reps = members.groupBy("digest").agg(F.min("id").alias("cls"), F.count("*").alias("n"))
    members = cut(members.join(reps, "digest").select("id", "cls", "grp", "n_chars"))
    chosen = members.where(f"id = cls and n_chars >= {min_len}").select("id")
    texts = cut(rows.where(F.length("text") >= min_len).join(chosen, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).withColumnRenamed("id", "cls"))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _batched(whole, "text"):
                points, starts = code_points(pdf["text"].tolist())
                if len(points) < min_len:
                    continue
                hashes = window_hashes(points, gram)
                least = window_argmin(hashes, window)
                begin = np.arange(len(least))
                owner = np.searchsorted(starts, begin, side="right") - 1
                picked = np.unique(least[begin + min_len <= starts[owner + 1]])
                owner = np.searchsorted(starts, picked, side="right") - 1
                yield pd.DataFrame({"h": hashes[picked].view(np.int64), "cls": pdf["cls"].to_numpy()[owner], "pos": (picked - starts[owner]).astype(np.int32)})

    found = cut(texts.mapInPandas(anchors, "h bigint, cls bigint, pos int"))

    def held_twice(keys: DataFrame) -> DataFrame:
        """Keys that two classes hold; one class alone repeats only itself."""
        return keys.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")

    def by_class(keys: DataFrame, blocks: Column) -> DataFrame:
        return keys.groupBy("cls").agg(F.collect_list(F.struct("pos", "h", blocks.cast("int").alias("blocks"))).alias("held"))

    shared = found.join(held_twice(found), "h")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ``min_len``-grams around a text's hot anchors."""
        for pdf in batches:
            for cls, text, held_here in zip(pdf["cls"], pdf["text"], pdf["held"], strict=True):
                hashes = window_hashes(code_points([text])[0], min_len)
                at = np.unique(np.concatenate([np.arange(max(0, x["pos"] - reach), min(x["pos"] + 1, len(hashes))) for x in held_here]))
                yield pd.DataFrame({"h": hashes[at].view(np.int64), "cls": cls, "pos": at.astype(np.int32)})

    hot = texts.join(by_class(shared.where(F.col("n") > BLOCK), F.lit(1)), "cls").mapInPandas(grams, "h bigint, cls bigint, pos int")
    hot = cut(hot)
    hot = hot.join(held_twice(hot), "h")

    def contexts_of(exact: bool):  # noqa: ANN202
        before, after = (0, min_len) if exact else (reach, gram + reach)

        def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for cls, text, held_here in zip(pdf["cls"], pdf["text"], pdf["held"], strict=True):
                    for one in held_here:
                        pos, blocks = one["pos"], one["blocks"]
                        start, own = max(0, pos - before), (int(cls) * 2654435761 >> 7) % blocks
                        for other in range(blocks):
                            out.append((one["h"], min(own, other), max(own, other), own, cls, pos, text[start : pos + after], pos - start, exact))
                if out:
                    yield pd.DataFrame(out, columns=["h", "b1", "b2", "own", "cls", "pos", "ctx", "at", "exact"])

        return contexts

    shape = "h bigint, b1 int, b2 int, own int, cls bigint, pos int, ctx string, at int, exact boolean"
    placed = texts.join(by_class(shared.where(F.col("n") <= BLOCK), F.lit(1)), "cls").mapInPandas(contexts_of(False), shape)
    if pairs:
        placed = placed.unionAll(texts.join(by_class(hot, F.ceil(F.col("n") / BLOCK)), "cls").mapInPandas(contexts_of(True), shape))
    marks = hot.where(F.lit(not pairs)).select("cls", F.col("pos").alias("s"), (F.col("pos") + min_len).alias("e"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []

        def settle() -> list[tuple]:
            alike: dict[tuple[str, int], list] = {}
            for own, cls, pos, ctx, at, _ in group:
                alike.setdefault((ctx, at), []).append((own, cls, pos))
            kinds, out = list(alike), []
            pairs = [(n, n, at, len(ctx) - at) for n, (ctx, at) in enumerate(kinds) if len(ctx) >= min_len and len(alike[ctx, at]) > 1]
            if len(kinds) > 1 and not group[0][-1]:
                pairs.extend(shard_matches(kinds, gram, min_len))
            for i, j, left, right in pairs:
                one, two = alike[kinds[i]], alike[kinds[j]]
                for x, (own1, cls1, pos1) in enumerate(one):
                    for own2, cls2, pos2 in one[x + 1 :] if i == j else two:
                        if cls1 != cls2 and (key[1] == key[2] or own1 != own2):
                            row = (cls1, cls2, pos1 - left, pos1 + right, pos2 - left, pos2 + right)
                            out.append(row if cls1 < cls2 else (cls2, cls1, *row[4:], *row[2:4]))
            return out

        names, done = ["a", "b", "a_start", "a_end", "b_start", "b_end"], []
        for pdf in batches:
            for h, b1, b2, *rest in zip(*(pdf[c].tolist() for c in ("h", "b1", "b2", "exact", "own", "cls", "pos", "ctx", "at", "exact")), strict=True):
                if (h, b1, b2, rest[0]) != key:
                    if len(group) > 1:
                        done.extend(settle())
                    key, group = (h, b1, b2, rest[0]), []
                    if len(done) > 20000:
                        yield pd.DataFrame(done, columns=names)
                        done = []
                group.append(rest[1:])
        if len(group) > 1:
            done.extend(settle())
        if done:
            yield pd.DataFrame(done, columns=names)

    spans = placed.repartition("h", "b1", "b2").sortWithinPartitions("h", "b1", "b2", "exact").mapInPandas(match, "a bigint, b bigint, a_start int, a_end int, b_start int, b_end int")
    return {"members": members, "spans": cut(spans), "marks": marks}


def shared_pairs(parts: dict[str, DataFrame], *, min_len: int = 200) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: records of different groups that share a span of ``min_len`` characters."""
    members = parts["members"]
    one, two = (members.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"id_{x}"), F.col("grp").alias(f"grp_{x}"), F.col("n_chars").alias(f"n_{x}")) for x in "ab")
    links = parts["spans"].select("a", "b").distinct()
    across = links.join(one, links["a"] == one["cls_a"]).join(two, links["b"] == two["cls_b"])
    within = one.where(f"n_a >= {min_len}").join(two, (F.col("cls_a") == F.col("cls_b")) & (F.col("id_a") < F.col("id_b")))
    got = across.select("id_a", "id_b", "grp_a", "grp_b").unionByName(within.select("id_a", "id_b", "grp_a", "grp_b")).where("grp_a <> grp_b")
    return got.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def shared_share(parts: dict[str, DataFrame], *, min_len: int = 200) -> DataFrame:
    """``(id, n_chars, shared_chars, share)`` for every record: how much of it also stands in another record.

    Records whose whole text of ``min_len`` or more characters has a copy are shared entirely; other spans are merged
    by gaps and islands. Groups do not matter here.
    """
    spans = parts["spans"]
    sides = spans.select(F.col("a").alias("cls"), F.col("a_start").alias("s"), F.col("a_end").alias("e")).unionAll(spans.select("b", "b_start", "b_end")).unionAll(parts["marks"]).groupBy("cls", "s").agg(F.max("e").alias("e"))
    order = W.partitionBy("cls").orderBy("s", "e")
    before = sides.withColumn("top", F.coalesce(F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    merged = before.groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "top"))).alias("covered"))
    members = parts["members"]
    copies = members.groupBy("cls").agg(F.count("*").alias("n"))
    out = members.join(copies, "cls").join(merged, "cls", "left")
    shared = F.when((F.col("n") > 1) & (F.col("n_chars") >= min_len), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    return out.select("id", F.col("n_chars").cast("bigint").alias("n_chars"), shared.alias("shared_chars")).withColumn("share", F.round(F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)), 6))
