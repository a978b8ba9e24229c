"""k most similar vectors of every vector by an inverted multi-index.

A vector is scaled to length 1 and cut into two halves; each half is quantised with its own codebook, and the pair
of codes names the vector's cell. A query walks the cells in order of the summed distances of its halves to the two
centroids, with a heap, until the cells it has passed hold ``candidates`` vectors; these are ranked by exact cosine.
A cell with more than ``DENSE`` vectors has a multi-index of its own, over codebooks fitted to its own vectors, which
the walk enters when it comes to that cell; so a query never has to meet a whole dense cell.

Codebooks are fitted on a bounded sample (about ``sample`` vectors); every vector is indexed and every vector is a
query. Equal vectors form one class, so a third of all rows being copies costs one index entry. What remains in one
cell is split into chunks of about ``CHUNK`` entries, which are ranked in separate groups. A vector travels once as an
entry, is a query to its own chunk there, and travels again only to the other chunks of its walk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.runtime import cut

#: Index entries of one ranking group; queries meet a group in slices of 256.
CHUNK = 4096
PER_CELL = 300
MOST_CODES = 1024
#: A cell with more entries gets an index of its own.
DENSE = 16_000
#: Vectors that the codebooks of one dense cell are fitted on.
DENSE_SAMPLE = 2000
#: Rows of a table that may be broadcast after its size was counted.
FEW = 100_000
#: Rows that a task gathers before it hands them on.
ROWS_OUT = 20_000


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[: min(k, len(points))]].copy()
    for _ in range(rounds):
        near = (centres**2).sum(1)[None] - 2 * points @ centres.T
        code = near.argmin(1)
        for c in range(len(centres)):
            own = points[code == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def _distances(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (half**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * half @ centres.T


def walk_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> Iterator[tuple[int, int]]:
    """Non-empty cells in order of ``first[i] + second[j]`` until they hold ``wanted`` entries: a heap over the two
    sorted distance lists, each pop opening its right and lower neighbour."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, held = [(fa[0] + sb[0], 0, 0)], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        size = sizes[a[i], b[j]]
        if size:
            yield a[i], b[j]
            held += size
        if j + 1 < len(b):
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))


class Index:
    """Codebooks and cell sizes of one level, and the indexes of its dense cells."""

    def __init__(self, points: np.ndarray, codes: int) -> None:
        half = points.shape[1] // 2
        self.books = _kmeans(points[:, :half], codes), _kmeans(points[:, half:], codes)
        self.sizes = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)
        self.inner: dict[tuple[int, int], Index] = {}

    def distances(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = m.shape[1] // 2
        return _distances(m[:, :half], self.books[0]), _distances(m[:, half:], self.books[1])

    def codes(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(m)
        return a.argmin(1), b.argmin(1)

    def walk(self, vector: np.ndarray, wanted: int, at: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[tuple[int, int, int, int], int]]:
        """``(cell, entries)``; a cell is named by its codes and the codes inside a dense cell, -1 where there are none."""
        da, db = at if at is not None else (x[0] for x in self.distances(vector[None]))
        left = wanted
        for i, j in walk_cells(da, db, self.sizes, wanted):
            deep = self.inner.get((i, j))
            if deep is None:
                yield (i, j, -1, -1), int(self.sizes[i, j])
                left -= int(self.sizes[i, j])
            else:
                for (x, y, _, _), n in deep.walk(vector, left):
                    yield (i, j, x, y), n
                    left -= n
            if left <= 0:
                return


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.sqrt((m * m).sum(1))[:, None]


def nearest_vectors(vectors: DataFrame, level: str, id_col: str, vec_col: str, *, dim: int = 64, k: int = 5, codes: int | None = None, sample: int = 20000, candidates: int = 5000, digits: int = 6, dense: int = DENSE) -> DataFrame:
    """``(level, id, rank, neighbour, cosine)``: the ``k`` most similar vectors of the same level for every vector.

    Cosine is rounded to ``digits`` decimals, ties go to the smaller id. Null ids, null, all-zero, non-finite and
    wrong-length vectors take no part; repeated rows of an id count once. Fewer than two vectors: no rows.
    ``sample`` bounds the vectors that the codebooks are fitted on, ``candidates`` the work of a query. ``codes`` is the
    size of each codebook; by default it grows with the root of the vectors, so that a cell holds ``PER_CELL`` on average.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    wide = dict(vectors.dtypes)[vec_col]
    usable = vectors.select(F.col(level).alias("level"), F.col(id_col).alias("id"), v.alias("vec")).where(F.col("level").isNotNull() & F.col("id").isNotNull() & (F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    # Equal vectors have equal pairs of hashes; only ids and hashes travel until the classes are known.
    usable = usable.withColumns({"h": F.xxhash64("vec"), "g": F.hash("vec")})
    light = cut(usable.groupBy("level", "id").agg(F.min(F.struct("h", "g")).alias("x")).select("level", "id", "x.h", "x.g"))
    # Equal vectors are one class: its smallest id names it and its k + 1 smallest ids stand for all of its members.
    # The row_number filter is applied within each input partition first (window group limit), so copies don't pile up.
    same = W.partitionBy("level", "h", "g")
    heads = light.withColumn("nth", F.row_number().over(same.orderBy("id"))).where(F.col("nth") <= k + 1)
    heads = cut(heads.withColumns({"cls": F.min("id").over(same), "n": F.count("*").over(same)}))
    classes = heads.where("nth = 1").select("level", F.col("id").alias("cls"), "h", "g")
    counts = {r["level"]: r["count"] for r in classes.groupBy("level").count().collect()}  # one row for each level
    if not counts:
        return spark.createDataFrame([], "level string, id bigint, rank int, neighbour bigint, cosine double")
    order = {name: n for n, name in enumerate(sorted(counts))}

    index: dict[str, Index] = {}
    for name, n in counts.items():
        # Every m-th vector by its hash: at least ``sample`` where there are as many, and fewer than about twice that.
        rows = usable.where((F.col("level") == name) & (F.pmod("h", F.lit(max(1, n // sample))) == 0)).dropDuplicates(["h", "g"]).select("vec")
        index[name] = Index(_unit(rows.toPandas()["vec"]), codes or min(MOST_CODES, max(4, round((n / PER_CELL) ** 0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("level", sort=False):
                m, own = _unit(part["vec"]), index[name]
                ca, cb = own.codes(m)
                cells = np.full((len(m), 4), -1, dtype=np.int32)
                cells[:, 0], cells[:, 1] = ca, cb
                for cell, deep in own.inner.items():
                    at = np.flatnonzero((ca == cell[0]) & (cb == cell[1]))
                    if len(at):
                        cells[at, 2], cells[at, 3] = deep.codes(m[at])
                yield pd.DataFrame({"lv": order[name], "cls": part["cls"], "cell": list(cells), "vec": part["vec"]})

    shape = f"lv int, cls bigint, cell array<int>, vec {wide}"
    own = usable.join(classes.withColumnRenamed("cls", "id").select("level", "id", F.col("h").alias("h1"), F.col("g").alias("g1")), ["level", "id"]).where("h = h1 and g = g1")
    named = own.groupBy("level", F.col("id").alias("cls")).agg(F.first("vec").alias("vec"))
    indexed = cut(named.mapInPandas(assign, shape))
    names = {n: name for name, n in order.items()}

    def count_cells(table: DataFrame) -> list:
        # At most levels x codes^2 rows, whatever the size of the data.
        return table.groupBy("lv", "cell").count().collect()

    crowded = []
    for r in count_cells(indexed):
        index[names[r["lv"]]].sizes[r["cell"][0], r["cell"][1]] = r["count"]
        if r["count"] > dense:
            crowded.append((r["lv"], r["cell"], r["count"]))
    if crowded:
        for lv, cell, n in crowded:
            at = indexed.where((F.col("lv") == lv) & (F.col("cell")[0] == cell[0]) & (F.col("cell")[1] == cell[1]))
            rows = at.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, n // DENSE_SAMPLE))) == 0).select("vec").toPandas()
            index[names[lv]].inner[cell[0], cell[1]] = Index(_unit(rows["vec"]), max(4, round((n / min(PER_CELL, dense / 4)) ** 0.5)))
        indexed = cut(indexed.select(F.element_at(F.lit([names[n] for n in sorted(names)]), F.col("lv") + 1).alias("level"), "cls", "vec").mapInPandas(assign, shape))
        for r in count_cells(indexed.where(F.col("cell")[2] >= 0)):
            index[names[r["lv"]]].inner[r["cell"][0], r["cell"][1]].sizes[r["cell"][2], r["cell"][3]] = r["count"]

    def size_of(lv: int, cell: tuple[int, ...]) -> int:
        own = index[names[lv]]
        return int(own.sizes[cell[0], cell[1]] if cell[2] < 0 else own.inner[cell[0], cell[1]].sizes[cell[2], cell[3]])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every vector as an entry of its chunk (side 0) and as a query of the other chunks of its walk (side 1)."""
        for pdf in batches:
            cls, vec = pdf["cls"].to_numpy(), pdf["vec"].to_numpy()
            m = _unit(pdf["vec"])
            mixed = ((cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).tolist()
            for lv, part in pdf.groupby("lv", sort=False):
                own = index[names[lv]]
                rows = pdf.index.get_indexer(part.index)
                da, db = own.distances(m[rows])
                out = []
                for x, n in enumerate(rows.tolist()):
                    cell = tuple(pdf["cell"].iat[n])
                    home = mixed[n] % -(-size_of(lv, cell) // CHUNK)
                    out.append((n, *cell, home, 0))
                    for there, size in own.walk(m[n], candidates, (da[x], db[x])):
                        out.extend((n, *there, c, 1) for c in range(-(-size // CHUNK)) if (there, c) != (cell, home))
                at, i, j, x, y, chunk, side = (np.array(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"lv": lv, "i": i, "j": j, "x": x, "y": y, "chunk": chunk, "side": side, "cls": cls[at], "vec": vec[at]})

    group = ["lv", "i", "j", "x", "y", "chunk"]
    both = indexed.mapInPandas(place, f"lv int, i int, j int, x int, y int, chunk int, side int, cls bigint, vec {wide}")

    def best_of(q: np.ndarray, to: np.ndarray, own: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(0, len(q), 256):
            some = q[at : at + 256]
            sim = np.round(to[at : at + 256] @ entries.T, digits)
            sim[some[:, None] == own[None]] = -9
            keep = min(k + 3, len(own))
            top = np.argpartition(-sim, keep - 1, axis=1)[:, :keep]
            values, ids = np.take_along_axis(sim, top, 1), own[top]
            order = np.lexsort((ids, -values))[:, :k]
            values, ids = np.take_along_axis(values, order, 1), np.take_along_axis(ids, order, 1)
            # Where more than ``keep`` entries tie with the last one taken, the whole row is ordered.
            for n in np.flatnonzero((sim >= values[:, -1:]).sum(1) > keep):
                order = np.lexsort((own, -sim[n]))[:k]
                values[n], ids[n] = sim[n][order], own[order]
            real = values.ravel() > -9
            yield np.repeat(some, values.shape[1])[real], ids.ravel()[real], values.ravel()[real]

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by chunk, entries before queries: a chunk's entries are kept until the next chunk."""
        key, ids, mat, full, done, held = None, [], [], None, [], 0

        def told(lv: int, q: np.ndarray, to: np.ndarray) -> None:
            nonlocal held
            for part in best_of(q, to, *full):
                done.append((np.full(len(part[0]), lv), *part))
                held += len(part[0])

        def entries() -> None:
            """Once a chunk's entries are complete, each is a query to the others."""
            nonlocal full
            if full is None and ids:
                full = np.concatenate(ids), np.concatenate(mat)
                told(key[0], *full)

        for pdf in batches:
            if not len(pdf):
                continue
            keys, side, cls = pdf[group].to_numpy(), pdf["side"].to_numpy(), pdf["cls"].to_numpy()
            vec = _unit(pdf["vec"])
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *edge], [*edge, len(pdf)], strict=True):
                now = tuple(keys[s])
                if now != key:
                    entries()
                    key, ids, mat, full = now, [], [], None
                if side[s] == 0:
                    ids.append(cls[s:e])
                    mat.append(vec[s:e])
                    continue
                entries()
                if full is not None:
                    told(key[0], cls[s:e], vec[s:e])
            if held > ROWS_OUT:
                yield pd.DataFrame(dict(zip(("lv", "cls", "other", "cosine"), map(np.concatenate, zip(*done, strict=True)), strict=True)))
                done, held = [], 0
        entries()
        if done:
            yield pd.DataFrame(dict(zip(("lv", "cls", "other", "cosine"), map(np.concatenate, zip(*done, strict=True)), strict=True)))

    found = both.repartition(*group).sortWithinPartitions(*group, "side").mapInPandas(rank, "lv int, cls bigint, other bigint, cosine double")
    best = W.partitionBy("lv", "cls").orderBy(F.desc("cosine"), "other")
    near = cut(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("lv", "cls", "other", "cosine"))
    level_of = F.element_at(F.lit([names[n] for n in sorted(names)]), F.col("lv") + 1)
    # Classes of several members, which alone have to be spelt out; the k + 1 best of a class hold the k best of each
    # of its members, whichever member is left out.
    number = F.create_map(*(x for name, n in order.items() for x in (F.lit(name), F.lit(n))))
    copied = cut(heads.where("n > 1").select(F.element_at(number, F.col("level")).alias("lv"), "cls", "id"))
    stands = copied.groupBy("lv", "cls").agg(F.collect_list("id").alias("ids"))
    small = stands.limit(FEW + 1).count() <= FEW
    hint = F.broadcast if small else (lambda df: df)
    told = near.join(hint(stands.withColumnRenamed("cls", "other")), ["lv", "other"], "left").select("lv", "cls", "cosine", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"))
    alone = told.join(hint(stands.select("lv", "cls")), ["lv", "cls"], "left_anti")
    single = alone.select("lv", F.col("cls").alias("id"), "neighbour", "cosine")
    grouped = told.join(hint(stands.select("lv", "cls")), ["lv", "cls"], "left_semi").unionByName(copied.select("lv", "cls", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine")))
    best = W.partitionBy("lv", "cls").orderBy(F.desc("cosine"), "neighbour")
    grouped = grouped.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    members = light.join(heads.where("nth = 1 and n > 1").select("level", "h", "g", "cls"), ["level", "h", "g"]).select(F.element_at(number, F.col("level")).alias("lv"), "cls", "id")
    many = members.join(grouped, ["lv", "cls"]).where("id <> neighbour").select("lv", "id", "neighbour", "cosine")
    best = W.partitionBy("lv", "id").orderBy(F.desc("cosine"), "neighbour")
    out = single.unionByName(many).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select(level_of.alias("level"), "id", "rank", "neighbour", "cosine")
