"""Set similarity joins over long tables (entity, element)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.runtime import cut, release

#: Sets from these sizes on meet by two elements, and by one: combinations of three, or two, would be too many.
PAIRS_FROM, SINGLES_FROM = 64, 256


def jaccard_classes(members: DataFrame, entity: str, element: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, shared, jaccard)``, a < b, of classes whose element sets have a Jaccard similarity of ``threshold``
    or more, and the membership ``(e, c, n)``: entities of equal sets are one class, named by the smallest; n elements.

    Exact, by prefix filtering: elements are ordered from rare to frequent, and two sets that reach the threshold share
    an element among their first ``n - ceil(threshold n) + 1``. So frequent elements hardly ever meet in the join.
    Nulls are left out, repeated elements count once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    long = members.select(F.col(entity).alias("e"), F.col(element).alias("v")).where("e is not null and v is not null").distinct()
    sets = long.groupBy("e").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    classes = cut(sets.groupBy("vs").agg(F.min("e").alias("c")))
    owners = sets.join(classes, "vs").select("e", "c", F.size("vs").alias("n"))
    elements = classes.select("c", F.explode("vs").alias("v"), F.size("vs").alias("n"))
    ranked = elements.join(elements.groupBy("v").agg(F.count("*").alias("df")), "v")
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("df", "v")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("c", "v", "n")
    one, two = prefix.toDF("a", "v", "na"), prefix.toDF("b", "v", "nb")
    near = one.join(two, "v").where((F.col("a") < F.col("b")) & (F.col("na") * threshold <= F.col("nb") + 1e-9) & (F.col("nb") * threshold <= F.col("na") + 1e-9)).select("a", "b").distinct()
    full = classes.select("c", "vs")
    both = near.join(full.toDF("a", "va"), "a").join(full.toDF("b", "vb"), "b")
    shared = F.size(F.array_intersect("va", "vb"))
    scored = both.select("a", "b", shared.cast("bigint").alias("shared"), (shared / (F.size("va") + F.size("vb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)
    return scored.withColumn("jaccard", F.round("jaccard", 6)), owners


def _levels(threshold: float, together: int) -> list[tuple[int, int, float]]:
    """``(k, lo, hi)``: a pair whose smaller set has lo to hi - 1 elements has k in common at least, and meets by k."""
    few = lambda k: next(n for n in range(1, 10**6) if math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) >= k)
    low = [few(k) for k in range(1, together + 1)]
    levels = [(k, lo, hi) for k, lo, hi in zip(range(1, together), low, low[1:], strict=False)]
    ends = {1: math.inf, 2: SINGLES_FROM, 3: PAIRS_FROM}
    at = low[-1]
    for k in range(together, 0, -1):
        levels.append((k, at, ends[k]))
        at = ends[k]
    return [(k, lo, hi) for k, lo, hi in levels if lo < hi]


def _keys(sets: DataFrame, threshold: float, k: int, lo: int, hi: float) -> DataFrame:
    """``(key, c, n, lesser)``: the sets' combinations of k elements in order, from those that a set may meet others by;
    lesser: also as the smaller one of a pair."""
    n = F.col("n")
    upto = lambda share: (n - F.ceil(n * F.lit(share) - 1e-9) + k).cast("int")
    within = (n >= lo) & (n * F.lit(threshold) < hi + 1e-9 if hi < math.inf else F.lit(True))
    rows = sets.where(within).select("c", "n", F.slice("s", F.lit(1), upto(threshold)).alias("p"), upto(2 * threshold / (1 + threshold)).alias("own"))
    rows = rows.select("*", F.posexplode("p").alias("at", "x1"))
    for i in range(2, k + 1):
        rest = F.slice("p", F.col("at") + 2, F.greatest(F.size("p") - F.col("at") - 1, F.lit(0)))
        rows = rows.select("c", "n", "p", "own", F.col("at").alias("before"), *(f"x{j}" for j in range(1, i)), F.posexplode(rest).alias("step", f"x{i}")).withColumn("at", F.col("before") + 1 + F.col("step"))
    lesser: Column = F.col("at") < F.col("own")
    return rows.select(F.xxhash64(F.lit(k), *(f"x{j}" for j in range(1, k + 1))).alias("key"), "c", "n", (lesser & (n < hi) if hi < math.inf else lesser).alias("lesser"))


def alike_classes(members: DataFrame, entity: str, element: str, threshold: float, together: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` and the membership ``(e, c)`` as ``jaccard_classes`` has them, for sets over few distinct elements:
    where even the rarest are in many sets, two sets meet by ``together`` elements (3 at most) at once.

    Exact: sets of na <= nb elements that reach the threshold share ``o``, at least ``ceil(2 t / (1 + t) na)`` and
    ``ceil(t nb)``. In an order of all elements, from rare to frequent, their first k common ones are among the first
    ``na - o + k`` of the one and ``nb - o + k`` of the other, so some combination of k meets. Keys are hashes of
    combinations; what meets is verified by its elements.
    """
    long = members.select(F.col(entity).alias("e"), F.col(element).alias("v")).where("e is not null and v is not null").distinct()
    long = cut(long)
    # Numbers stand for elements; they are given once, when the table is written.
    words = cut(long.groupBy("v").agg(F.count("*").alias("df")).withColumn("i", F.monotonically_increasing_id()))
    coded = long.join(words, "v").groupBy("e").agg(F.array_sort(F.collect_list(F.struct("df", "i"))).alias("s")).select("e", F.col("s.i").alias("s"))
    coded = cut(coded)
    release(long)
    release(words)
    classes = cut(coded.groupBy("s").agg(F.min("e").alias("c")).withColumn("n", F.size("s")))
    owners = cut(coded.join(classes, "s").select("e", "c"))
    release(coded)
    met = None
    for k, lo, hi in _levels(threshold, together):
        keys = _keys(classes, threshold, k, lo, hi)
        one, two = keys.where("lesser").select("key", F.col("c").alias("a"), F.col("n").alias("na")), keys.select("key", F.col("c").alias("b"), F.col("n").alias("nb"))
        ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        here = one.join(two, "key").where(ordered & (F.col("nb") * threshold <= F.col("na") + 1e-9)).select("a", "b")
        met = here if met is None else met.unionByName(here)
    full = classes.select("c", "s")
    both = met.distinct().join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = both.where(shared / (F.size("sa") + F.size("sb") - shared) >= threshold - 1e-12)
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), owners


def linked_entities(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """``(e, c, links)``: every entity with its class and the number of other entities it is linked to, copies included;
    counted by class, so no group of copies is spelt out."""
    sizes = cut(owners.groupBy("c").agg(F.count("*").alias("m")))
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(sizes.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("m").alias("far"))
    links = sizes.join(far, "c", "left").select("c", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return owners.join(links, "c").select("e", "c", "links")
