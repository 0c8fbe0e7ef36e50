"""Nearest neighbours by vantage-point trees, one for each shard.

For the largest inner product each vector gets one more coordinate that brings all to the same norm; the Euclidean order
is then the order by inner product, and the triangle inequality holds.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightsieve.llm.common import staged
from nightsieve.shipping import ship

SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
LEAF = 256


class Tree:
    """A vantage-point tree over rows of `points`; leaves hold about `leaf` rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        norm = (points * points).sum(axis=1)
        self.top = float(norm.max())
        self.points, self.ids = points, ids
        self.extra = np.sqrt(np.maximum(self.top - norm, 0))
        self.root = self._grow(np.arange(len(points)), leaf)

    def _distance(self, at: int, rows: np.ndarray) -> np.ndarray:
        inner = self.points[rows] @ self.points[at] + self.extra[rows] * self.extra[at]
        return np.sqrt(np.maximum(2 * (self.top - inner), 0))

    def _grow(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        some = rows[:: max(1, len(rows) // 64)]
        # the vantage point is the row farthest from the first: borders cut less there
        at = int(some[np.argmax(self._distance(int(rows[0]), some))])
        far = self._distance(at, rows)
        middle = float(np.median(far))
        near = far <= middle
        if near.all() or not near.any():  # equal rows cannot be parted
            return rows
        return at, middle, self._grow(rows[near], leaf), self._grow(rows[~near], leaf)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k largest inner products of each query with other rows, as (scores, ids), best first; -inf where there are fewer.

        A side is skipped when its border lies farther from the query than `factor` times the k-th best distance so far.
        Factor one skips only what cannot hold a nearer row (a hair is left for rounding); less skips more.
        """
        size = len(queries)
        scores = np.full((size, k), -np.inf)
        ids = np.full((size, k), np.iinfo(np.int64).max)
        norm = (queries * queries).sum(axis=1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                got = queries[who] @ self.points[node].T
                name = np.broadcast_to(self.ids[node], got.shape)
                got = np.where(name == own[who][:, None], -np.inf, got)
                all_scores = np.concatenate((scores[who], got), axis=1)
                all_ids = np.concatenate((ids[who], name), axis=1)
                order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                scores[who] = np.take_along_axis(all_scores, order, axis=1)
                ids[who] = np.take_along_axis(all_ids, order, axis=1)
                return
            at, middle, near, far = node
            # the query's own extra coordinate is 0
            reach = np.sqrt(np.maximum(norm[who] + self.top - 2 * (queries[who] @ self.points[at]), 0))
            inside = reach <= middle
            visit(near, who[inside])
            visit(far, who[~inside])
            worst = np.sqrt(np.maximum(norm[who] + self.top - 2 * scores[who, -1], 0))
            open_ = np.abs(reach - middle) <= factor * worst + 1e-9
            visit(far, who[inside & open_])
            visit(near, who[~inside & open_])

        visit(self.root, np.arange(size))
        return scores, ids


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(left: pa.Table, right: pa.Table, k: int, factor: float) -> pa.Table:
    """The rows of one shard against one block of queries."""
    if not left.num_rows or not right.num_rows:
        return OUT.empty_table()
    points, queries = _matrix(left.column("vector")), _matrix(right.column("vector"))
    own = right.column("id").to_numpy()
    scores, ids = Tree(points, left.column("id").to_numpy()).search(queries, own, min(k, len(points)), factor)
    hit = np.isfinite(scores)
    who = np.broadcast_to(own[:, None], scores.shape)[hit]
    return pa.Table.from_arrays([pa.array(who), pa.array(ids[hit]), pa.array(scores[hit])], schema=OUT)


def usable(vector):
    """Not null, no null or non-finite component, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products of each query with all rows of other ids.

    Vectors that are null, zero or hold null or non-finite components take no part; only vectors of one length are compared.
    Ties go to the smaller id; with fewer candidates all are returned; repeated ids each answer.  Rows are dealt to shards of
    about `shard_rows` by hash, queries to blocks of about `block_rows`; every block meets every shard once, and of each meeting
    only the `k` best of a query leave.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    rows, asked = pick(vectors), pick(queries)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", deal(shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    ship(vectors.sparkSession)
    keys = ["dim", "shard", "block"]
    work = partial(_search, k=k, factor=factor)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: work(a, b), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = staged(met, "neighbours").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
