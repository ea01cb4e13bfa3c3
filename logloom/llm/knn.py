"""Exact top-k inner products by KD-trees over shards.

Vectors are dealt to shards of a bounded size by a hash of their row. Each shard is cut at medians of its widest
side into leaves, with a tight bounding box at every node, and stays where it is: blocks of queries travel to the
shards. In a shard a query takes nodes best bound first, the bound being the largest inner product any point of
the box can have, and stops where the bound is below its k-th best score so far.

Every query first searches one shard. The k-th score it finds there travels with it to all other shards and
prunes their trees from the root on; what they find is at least as good, so little comes back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD = 8192
LEAF = 64
QUERIES = 256
SCALE = 256
NONE = -(1 << 63)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): floor(SCALE * x) of every component; vectors that are null or hold a component that is null or no number go.

    Rows stay apart, even those of one vec_id. A row with a null vec_id has a negative row number and the largest id
    in its place. An empty vector takes no part. Components beyond the range of long count as its ends.
    """
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    slim = embeddings.select("vec_id", "embedding").filter("embedding is not null").filter(good & (F.size("embedding") > 0))
    row = F.monotonically_increasing_id()
    unnamed = F.col("vec_id").isNull()
    return slim.select(F.when(unnamed, -1 - row).otherwise(row).alias("row"), F.when(unnamed, F.lit((1 << 63) - 1)).otherwise(F.col("vec_id").cast("long")).alias("vec_id"), x.alias("v"))


class Tree:
    """A KD-tree in arrays: node i holds rows [start, end); its halves are left[i] and left[i] + 1 (0: a leaf)."""

    def __init__(self, ids: np.ndarray, rows_of: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        points = points[order]
        rows = np.arange(len(ids))
        start, end, left = [0], [len(ids)], [0]
        i = 0
        while i < len(start):
            s, e = start[i], end[i]
            if e - s > LEAF:
                part = points[rows[s:e]]
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                middle = (e - s) // 2
                rows[s:e] = rows[s:e][np.argpartition(part[:, side], middle)]
                left[i] = len(start)
                start += [s, s + middle]
                end += [s + middle, e]
                left += [0, 0]
            i += 1
        self.ids, self.rows, self.points = ids[order][rows], rows_of[order][rows], points[rows]
        self.start, self.end, self.left = start, end, left
        self.low = np.array([self.points[s:e].min(axis=0) for s, e in zip(start, end, strict=True)])
        self.high = np.array([self.points[s:e].max(axis=0) for s, e in zip(start, end, strict=True)])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """At least the largest inner product of each query with any point of each node's box."""
        if queries.dtype == np.int64:  # sums of floats may round down
            q, high, low = queries.astype(np.float64), self.high.astype(np.float64), self.low.astype(np.float64)
            return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T) + 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) + 1
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own_rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple]]]:
        """(query number, its k best (score, -id, -row) here) where any reaches `least`, the query's k-th best so far."""
        bounds = self.bounds(queries)
        for q in np.flatnonzero(bounds[:, 0] >= least).tolist():
            own, query, bound, floor, heap = own_rows[q], queries[q], bounds[q], least[q], []
            open_nodes = [(-bound[0], 0)]
            while open_nodes:
                b, node = heapq.heappop(open_nodes)
                if -b < floor:
                    break
                child = self.left[node]
                if child:
                    for c in (child, child + 1):
                        if bound[c] >= floor:
                            heapq.heappush(open_nodes, (-bound[c], c))
                    continue
                s, e = self.start[node], self.end[node]
                scores = self.points[s:e] @ query
                for i in np.flatnonzero(scores >= floor).tolist():
                    if self.rows[s + i] != own:
                        item = (int(scores[i]), -int(self.ids[s + i]), -int(self.rows[s + i]))
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
                        if len(heap) == k:
                            floor = max(floor, heap[0][0])
            if heap:
                yield q, heap


def _exact(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where no sum of products can pass 2^53, else as 64-bit integers, whose sums beyond 2^63 wrap."""
    most = float(np.abs(queries).max(initial=1)) * float(np.abs(points).max(initial=1)) * points.shape[1]
    return (queries.astype(np.float64), points.astype(np.float64)) if most < 1 << 53 else (queries, points)


_BLOCK = "dim int, shard int, block int, ids binary, rows binary, least binary, points binary"


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a group's ids, rows, bounds and vectors as bytes; block -1 is the shard itself."""
    points = np.array(rows["v"].tolist(), np.int64)
    cols = {c: [rows[n].to_numpy(np.int64).tobytes()] for c, n in (("ids", "vec_id"), ("rows", "row"), ("least", "least"))}
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "block": [key[2]], **cols, "points": [points.tobytes()]})


def _search(k: int):
    """Over blocks sorted by shard, the shard itself first: the best of each query of each block in the shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, exact, at = None, None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, rows, least = (np.frombuffer(x, np.int64) for x in (r.ids, r.rows, r.least))
                points = np.frombuffer(r.points, np.int64).reshape(len(ids), -1)
                if r.block < 0:
                    tree, exact, at = {}, (ids, rows, points), (r.dim, r.shard)
                    continue
                if at != (r.dim, r.shard):
                    continue  # no vector of this length is in the shard
                queries, shard = _exact(points, exact[2])
                if shard.dtype not in tree:
                    tree[shard.dtype] = Tree(exact[0], exact[1], shard)
                found = [(int(ids[q]), int(rows[q]), -v, -w, s) for q, heap in tree[shard.dtype].search(rows, queries, least, k) for s, v, w in heap]
                if found:
                    yield pd.DataFrame(found, columns=["query_id", "query_row", "vec_id", "row", "score"])

    return run


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by `every`, the k best other rows.

    Scores are integer inner products of floor(256 * x); ties go to the smaller vec_id. Rows of one vec_id are rows
    like others: each of them asks, and each is found. Rows with a null vec_id are found, last among ties, but do not ask.
    Vectors of another length than the query's are no candidates. An empty table gives no rows; other columns are not
    read.
    """
    found = written(vectors(embeddings).withColumn("dim", F.size("v")), "vectors")
    n = found.count()
    shards = max(1, -(-n // shard))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    placed = found.withColumn("shard", home).withColumn("least", F.lit(NONE))
    index = placed.withColumn("block", F.lit(-1)).groupBy("dim", "shard", "block").applyInPandas(_packed, _BLOCK)
    index = written(index, "shards")
    asked = placed.filter((F.col("row") >= 0) & (F.pmod("vec_id", F.lit(every)) == 0))
    most = max(1, -(-asked.count() // QUERIES))

    def searched(queries: DataFrame) -> DataFrame:
        """queries: blocks with the shard each goes to."""
        both = index.unionByName(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")
        return written(both.mapInPandas(_search(k), "query_id long, query_row long, vec_id long, row long, score long"), "found")

    per_home = max(1, -(-most // shards))
    cut = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(per_home)).cast("int")
    first = searched(asked.withColumn("block", cut).groupBy("dim", "shard", "block").applyInPandas(_packed, _BLOCK))
    kth = first.groupBy("query_row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k)
    bound = asked.join(kth.select(F.col("query_row").alias("row"), "kth"), "row", "left").withColumn("least", F.coalesce("kth", "least"))
    blocks = bound.withColumn("block", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(most)).cast("int"))
    out = first
    if shards > 1:
        travelling = blocks.withColumn("shard", F.lit(-1)).groupBy("dim", "shard", "block").applyInPandas(_packed, _BLOCK)
        everywhere = travelling.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        out = searched(everywhere)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("row") >= 0, F.col("vec_id")).alias("vec_id"), "score")
