"""Filling containers of fixed capacity with texts: best-two-fit over the histogram of sizes.

Sizes are whole numbers up to the capacity, so the packing of any number of items is decided on their histogram:
at most ``capacity`` counts reach the driver, whatever the size of the data. A container is filled greedily, largest
fitting item first; then its smallest item is replaced by the two unpacked items that fill the gap it would leave
more tightly, as long as that gains room. The pattern found is repeated as often as the counts allow. The items are
then dealt to the patterns' places by their rank among items of equal size, a distributed computation: ranks are
counted within buckets of ids and offset by the sizes' counts in earlier buckets, so that no size, however common,
is sorted by one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.runtime import cut

BUCKETS = 64


def rule_tokens(text: str):  # noqa: ANN201
    """Every longest run of letters, digits and underscores and every other non-blank character is one token."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def tokenizer_sizes(documents: DataFrame, text: str, tokenizer_path: str, out: str = "n_tokens") -> DataFrame:
    """Adds the token count of a public tokenizer file of the ``tokenizers`` library (a path all workers can read)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def count(batches):  # noqa: ANN001, ANN202
        import pandas as pd
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    from collections.abc import Iterator

    import pandas as pd

    count.func.__annotations__.update({"batches": Iterator[pd.Series], "return": Iterator[pd.Series]})
    return documents.withColumn(out, count(text))


def _best_two(sizes: np.ndarray, counts: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum in (above, room]."""
    best, pick = above, None
    live = np.flatnonzero(counts)
    values = sizes[live]
    partner = np.searchsorted(values, room - values, side="right") - 1
    same = (partner >= 0) & (values[np.maximum(partner, 0)] == values) & (counts[live] < 2)
    partner = np.where(same, partner - 1, partner)
    sums = np.where(partner >= 0, values + values[np.maximum(partner, 0)], -1)
    n = int(sums.argmax()) if len(sums) else 0
    if len(sums) and sums[n] > best:
        pick = int(live[n]), int(live[partner[n]])
    return pick


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(containers, {size: items in each})``: a packing of ``histogram`` (sizes 1 to ``capacity``), best-two-fit."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), dtype=np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns = []
    top = len(sizes) - 1
    while True:
        while top >= 0 and not counts[top]:
            top -= 1
        if top < 0:
            return patterns
        used: dict[int, int] = {}
        gap = capacity

        def take(n: int, used: dict[int, int] = used) -> None:
            used[n] = used.get(n, 0) + 1
            counts[n] -= 1

        at = top
        while gap and at >= 0:
            at = min(at, int(np.searchsorted(sizes, gap, side="right")) - 1)
            while at >= 0 and not counts[at]:
                at -= 1
            if at >= 0:
                take(at)
                gap -= int(sizes[at])
        while gap:
            small = min(used)
            pair = _best_two(sizes, counts, gap + int(sizes[small]), int(sizes[small]))
            if pair is None:
                break
            used[small] -= 1
            counts[small] += 1
            if not used[small]:
                del used[small]
            gap += int(sizes[small])
            for n in pair:
                take(n)
                gap -= int(sizes[n])
        times = 1 + min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= (times - 1) * k
        patterns.append((times, {int(sizes[n]): k for n, k in used.items()}))


def _ranked(items: DataFrame) -> DataFrame:
    """Adds ``rank``, counted from 0 within equal sizes, without sorting a whole size in one task."""
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    within = placed.withColumn("r", F.row_number().over(W.partitionBy("size", "bucket").orderBy("doc_id")) - 1)
    counted = placed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    earlier = counted.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return within.join(earlier, ["size", "bucket"]).withColumn("rank", F.col("r") + F.col("offset")).drop("r", "offset", "bucket")


def pack(documents: DataFrame, doc_id: str, size_col: str, capacities: dict[int, int]) -> DataFrame:
    """``(spec_id, doc_id, piece, container, first_token, tokens)``: every document in containers of every capacity.

    ``capacities`` maps a spec to its capacity. A document longer than the capacity is split into full containers and
    one rest (``piece`` counts from 0); no other is split. Documents of size null, zero or less take no room and stand
    in container 0. Repeated ids count once, with their largest size. Null ids are left out.
    """
    spark: SparkSession = documents.sparkSession
    sized = documents.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("n")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    sized = cut(sized)
    out = None
    for spec, capacity in sorted(capacities.items()):
        if not capacity or capacity < 1:
            raise ValueError(f"capacity of {spec} must be positive")
        full = F.expr(f"n div {capacity}")
        rest = sized.withColumn("whole", F.when(F.col("n") > capacity, full).otherwise(F.lit(0))).withColumn("size", F.col("n") - F.col("whole") * capacity)
        counted = {r["size"]: r["c"] for r in rest.where("size > 0").groupBy("size").agg(F.count("*").alias("c")).collect()}  # at most ``capacity`` rows
        places, base, given = [], 0, dict.fromkeys(counted, 0)
        for times, pattern in pack_histogram(counted, capacity):
            for size, each in pattern.items():
                places.append((size, given[size], given[size] + times * each, each, base))
                given[size] += times * each
            base += times
        table = spark.createDataFrame(places, "size bigint, low bigint, high bigint, each bigint, base bigint")
        ranked = _ranked(rest.where("size > 0").select("doc_id", "whole", "size"))
        dealt = ranked.join(table, (ranked["size"] == table["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        small = dealt.select("doc_id", F.col("whole").alias("piece"), (F.col("base") + F.expr("(rank - low) div each")).alias("container"), ranked["size"].alias("tokens"))
        empty = rest.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("container"), F.lit(0).cast("bigint").alias("tokens"))
        # Full pieces stand alone; their containers are numbered by the running count of whole pieces over id buckets.
        long = rest.where("whole > 0").select("doc_id", "whole").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
        sums = long.groupBy("bucket").agg(F.sum("whole").alias("w"))
        sums = sums.withColumn("offset", F.coalesce(F.sum("w").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("w")  # BUCKETS rows
        run = F.coalesce(F.sum("whole").over(W.partitionBy("bucket").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        wholes = long.withColumn("run", run).join(sums, "bucket").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)))
        big = wholes.select("doc_id", "piece", (F.lit(base) + F.col("offset") + F.col("run") + F.col("piece")).alias("container"), F.lit(capacity).cast("bigint").alias("tokens"))
        one = small.unionByName(empty).unionByName(big).select(F.lit(spec).alias("spec_id"), "doc_id", "piece", "container", (F.col("piece") * capacity).alias("first_token"), "tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "spec_id int, doc_id bigint, piece bigint, container bigint, first_token bigint, tokens bigint")
    return out
