"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from umbra.llm.common import python_ready, table

#: Vectors that the two codebooks are fitted on.
SAMPLE = 20_000
#: Centroids of each half.
CENTROIDS = 32
#: What the visited cells of a query must hold: a share of all vectors, and so many for each neighbour that is wanted.
SHARE, EACH = 0.6, 10
#: Vectors of one coarse list that a task holds at once.
BLOCK = 4096
NEIGHBOURS = 20


def usable(vector: Column, dimension: int) -> Column:
    """Vectors of the right length without null, infinite or NaN components, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dimension) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds; start points are drawn apart from each other."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None, :]
    gap = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = gap.sum()
        pick = int(np.searchsorted(np.cumsum(gap), rng.random() * total)) if total > 0 else int(rng.integers(len(x)))
        centres = np.vstack([centres, x[min(pick, len(x) - 1)]])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class MultiIndex:
    """Two codebooks and the number of vectors in each cell: bounded by centroids, not by rows."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS) -> None:
        self.dimension = sample.shape[1]
        self.half = self.dimension // 2
        self.books = (kmeans(sample[:, : self.half], centroids), kmeans(sample[:, self.half :], centroids, seed=2))
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_centre(x[:, : self.half], self.books[0]), nearest_centre(x[:, self.half :], self.books[1])

    def visit(self, query: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Centroid pairs from the largest summed inner product down, by a heap, until their cells hold enough vectors."""
        first, second = self.books[0] @ query[: self.half], self.books[1] @ query[self.half :]
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        heap, seen, out, held = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            out.append((int(a[i]), int(b[j])))
            held += int(self.counts[a[i], b[j]])
            for ni, nj in ((i + 1, j), (i, j + 1)):
                if ni < len(a) and nj < len(b) and (ni, nj) not in seen:
                    seen.add((ni, nj))
                    heapq.heappush(heap, (-(first[a[ni]] + second[b[nj]]), ni, nj))
        return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, centroids: int = CENTROIDS, share: float = SHARE, each: int = EACH, sample: int = SAMPLE) -> DataFrame:
    """The k rows of largest inner product for each query row: query_id, rank, vec_id, score.

    The codebooks are fitted on the ``sample`` vectors with the smallest hashes of their ids; every row
    is put into the cell of its two nearest half centroids. A query visits cells by summed inner product
    until they hold ``share`` of all rows (``each`` rows for each of the k at any rate) and reranks all their entries in double
    precision. Rows travel once, to the block of their first centroid; a large list has many blocks, so
    equal vectors don't meet in one task; queries stream past a block.

    Defined cases: null ids and vectors that are null, zero, of another than the commonest length, or
    hold null or non-finite components take no part. Rows that repeat an id are separate candidates, but
    none of them is a candidate for a query of that id, which is asked once. Equal scores go by the
    smaller vec_id. Fewer candidates than k give fewer rows; no usable vector gives none.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    rows = rows.where(usable(F.col("v"), common[0]["d"]))
    picked = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not picked:
        return spark.createDataFrame([], schema)
    index = MultiIndex(np.array([r["v"] for r in picked]), centroids)
    books = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                first, second = books.value.cells(_matrix(batch["v"]))
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "c1": first, "c2": second})

    placed = rows.select("id", "v").mapInPandas(place, "id long, v array<double>, c1 int, c2 int")
    for r in placed.groupBy("c1", "c2").count().collect():  # at most centroids squared rows
        index.counts[r["c1"], r["c2"]] = r["count"]
    total = int(index.counts.sum())
    blocks = np.maximum(1, -(-index.counts.sum(1) // BLOCK))
    filled = spark.sparkContext.broadcast(index)
    enough = max(each * k, int(share * total))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number, vector in zip(batch["id"], batch["v"], strict=True):
                lists: dict[int, list[int]] = {}
                for first, second in filled.value.visit(np.asarray(vector, dtype=np.float64), enough):
                    lists.setdefault(first, []).append(second)
                out += [(number, vector, first, seconds) for first, seconds in lists.items()]
            yield pd.DataFrame(out, columns=["id", "v", "c1", "cells"])

    block_of = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("c1") + 1)
    entries = placed.select("c1", F.pmod(F.xxhash64("id"), block_of).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v", F.array("c2").alias("cells"))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).mapInPandas(ask, "id long, v array<double>, c1 int, cells array<int>")
    asked = asked.select("c1", F.explode(F.sequence(F.lit(0), block_of - 1)).alias("block"), F.lit(1).alias("asks"), "id", "v", "cells")
    dealt = entries.unionByName(asked).repartition("c1", "block").sortWithinPartitions("c1", "block", "asks")

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, parts, second = None, [], [], []
        matrix = cells = numbers = None
        for batch in batches:
            out = []
            for (c1, block, asks), group in batch.groupby(["c1", "block", "asks"], sort=True):
                if (c1, block) != key:
                    key, ids, parts, second, matrix = (c1, block), [], [], [], None
                if not asks:
                    ids.append(group["id"].to_numpy())
                    parts.append(_matrix(group["v"]))
                    second.append(np.array([c[0] for c in group["cells"]]))
                    continue
                if not ids:
                    continue
                if matrix is None:
                    matrix, cells, numbers = np.concatenate(parts), np.concatenate(second), np.concatenate(ids)
                out += _best(group, matrix, cells, numbers, k)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = dealt.mapInPandas(rerank, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(asked: pd.DataFrame, matrix: np.ndarray, cells: np.ndarray, numbers: np.ndarray, k: int) -> list[tuple]:
    """The k best entries of a block for each query that comes by."""
    out = []
    queries = _matrix(asked["v"])
    scores = queries @ matrix.T
    for row, (number, seconds) in enumerate(zip(asked["id"], asked["cells"], strict=True)):
        open_ = np.flatnonzero(np.isin(cells, seconds) & (numbers != number))
        if not len(open_):
            continue
        mine = scores[row, open_]
        if len(open_) > k:  # a rounding's width below the k-th, so that exact sums decide ties
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            open_ = open_[mine >= least - 1e-9 * max(1.0, abs(least))]
        exact = (matrix[open_] * queries[row]).sum(1)
        order = np.lexsort((numbers[open_], -exact))[:k]
        out += [(number, int(numbers[open_[o]]), float(exact[o])) for o in order]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
