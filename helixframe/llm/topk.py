"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

A shard is a run of rows that one task has at hand: each task builds the ball trees of its own rows, so that vectors are
never shuffled, and trees are written once. Queries are taken in blocks of bounded bytes, one after the other; a block is
broadcast, and all trees stream past it where they lie. In the first round every query is followed to one leaf of each
tree; merged over all shards, this gives a true lower bound of its kth score, which is broadcast with the block for the
second round. There a tree's root drops the queries that it has nothing for, and for the others nodes are taken from a heap
in order of the largest inner product that their ball allows, until that is below the kth score so far (the better of the
shared bound and the shard's own). Each shard returns k rows for a query at most, which are ranked once more.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, forget

K, SHARD_ROWS, LEAF = 5, 8192, 128
#: Bytes of queries in a block, eight a component; it is broadcast.
BLOCK_BYTES = 32 << 20
#: Whole numbers below this are exact in doubles; scores that may pass it are summed in 64-bit or Python numbers.
EXACT, LONG = 1 << 53, (1 << 63) - 1


def exactly(numbers: np.ndarray, limit: float) -> np.ndarray:
    """Whole numbers held in doubles, as numbers in which sums of products up to `limit` are exact: doubles, 64 bits, or
    Python's own."""
    if limit < EXACT:
        return numbers
    if limit < LONG:
        return numbers.astype(np.int64)
    return np.array([int(x) for x in numbers.ravel().tolist()], object).reshape(numbers.shape)


def narrow(rows: np.ndarray) -> np.ndarray:
    """Doubles in 16 bits if they fit: a quarter of what is written and sent about."""
    return rows.astype(np.int16) if not rows.size or np.abs(rows).max() < 1 << 15 else rows


class BallTree:
    """Rows in tree order; nodes as [start, end, left, right], their centres and radii as arrays."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        by = np.arange(len(ids))
        self.nodes: list[list[int]] = []
        centres, radii = [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = rows[by[a:b]]
            centre = own.mean(0)
            far = np.sqrt(((own - centre) ** 2).sum(1))
            here = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            centres.append(centre)
            radii.append(float(far.max()))
            if parent >= 0:
                self.nodes[parent][2 + side] = here
            if b - a > leaf and far.max() > 0:
                one = own[far.argmax()]
                two = own[((own - one) ** 2).sum(1).argmax()]
                half = np.argpartition(own @ (two - one), (b - a) // 2)
                by[a:b] = by[a:b][half]
                middle = a + (b - a) // 2
                stack += [(a, middle, here, 0), (middle, b, here, 1)]
        self.ids, self.rows = ids[by], rows[by]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": narrow(self.rows)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"rows": state["rows"].astype(np.float64)}

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's ball allows with each query (queries x nodes); a little is added, as
        centres, radii and products are rounded."""
        length = np.sqrt((queries**2).sum(1))
        reach = self.radii + np.sqrt((self.centres**2).sum(1))
        out = queries @ self.centres.T + np.outer(length, self.radii)
        out += 1e-9 * np.outer(length, reach) + 1e-6
        return np.where(np.isnan(out), np.inf, out)  # sums beyond a double

    def search(self, exact: np.ndarray, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: float, first_leaf: bool = False):
        """Scores and ids of up to k rows that score `floor` or more, the query's own id apart; ties to smaller ids. exact,
        query: the rows and the query as numbers in which scores are exact."""
        scores, ids = exact[:0] @ query, np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break  # no node left allows more
            a, b, left, right = self.nodes[node]
            if left >= 0:
                if first_leaf:
                    heap = []
                    left = right = left if bounds[left] >= bounds[right] else right
                for child in {left, right}:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            s = exact[a:b] @ query
            take = (s >= floor) & (self.ids[a:b] != own)
            scores, ids = np.concatenate((scores, s[take])), np.concatenate((ids, self.ids[a:b][take]))
            if len(ids) > k:
                best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if len(ids) == k:
                floor = max(floor, scores.min())
        return scores, ids


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """(vec_id, v, more...): components as floor(256 * x) in doubles; rows without an id or a vector, and vectors that hold null or
    non-finite numbers (or such whose product with 256 is), take no part. An empty vector does: its product with another one is 0."""
    scaled = lambda x: F.lit(256.0) * x.cast("double")
    given = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(scaled(x)) < float("inf")) & ~F.isnan(x))
    # floor() gives 64-bit numbers; from 2 ** 52 on a double has no fraction, so that it stands as it is.
    floor = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return vectors.where(given).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: floor(scaled(x))).alias("v"), *more)


def by_length(ids: list[int], vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        own = out.setdefault(len(v), ([], []))
        own[0].append(i)
        own[1].append(v)
    return {n: (np.array(i, np.int64), np.array(v, np.float64).reshape(len(i), n)) for n, (i, v) in out.items()}


def trees(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """(length, data): the ball trees of each task's rows, one for each shard_rows rows and each length of vectors there."""

    def build(frames):
        held_ids: list[int] = []
        held: list = []

        def made():
            for n, (ids, rows) in by_length(held_ids, held).items():
                for k in range(0, len(ids), shard_rows):
                    yield pd.DataFrame({"length": [n], "data": [pickle.dumps(BallTree(ids[k : k + shard_rows], rows[k : k + shard_rows]), 5)]})
            held_ids.clear()
            held.clear()

        for pdf in frames:
            for k in range(0, len(pdf), shard_rows):
                held_ids += pdf["vec_id"].iloc[k : k + shard_rows].tolist()
                held += pdf["v"].iloc[k : k + shard_rows].tolist()
                if len(held_ids) >= shard_rows:
                    yield from made()
        yield from made()

    return vectors.mapInPandas(build, "length int, data binary")


def top_k(vectors: DataFrame, every: int, k: int = K, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose vec_id is divisible by `every`, against all other rows.

    Rows that repeat a vec_id are candidates of their own, and, as queries, one (the smallest vector); a query's
    candidates never have its id. Vectors of other lengths than the query's never meet it; empty ones meet with score 0. No rows: no rows.
    Scores are exact whatever the components; one beyond a long is given as the nearest long, its rank going by that.
    """
    spark = vectors.sparkSession
    grown = cut(trees(usable(vectors), shard_rows))
    # A query's vector counts from 24 bytes on, whatever its length.
    asked = cut(usable(vectors).where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    size = asked.agg(F.sum(F.size("v") * 8 + 24).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(blocks)) == b).toArrow()  # a block
        queries = by_length(rows.column("vec_id").to_pylist(), rows.column("v").to_numpy().tolist())
        seeds = searched(grown, queries, {}, k, True)
        bound = seeds.withColumn("n", F.row_number().over(nth)).where(F.col("n") == k).select("query_id", "score")
        floors = dict(map(tuple, bound.collect()))  # a number for each query of the block
        found = searched(grown, queries, floors, k, False)
        more = found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        more = cut(more) if blocks > 1 else more
        out = more if out is None else out.union(more)
    forget(asked)
    return out


def searched(grown: DataFrame, queries: dict, floors: dict[int, int], k: int, first: bool) -> DataFrame:
    """(query_id, vec_id, score, copy) of the k best of each tree for each query, those below the query's floor left out."""
    sent = grown.sparkSession.sparkContext.broadcast((queries, floors))

    def run(frames):
        queries, floors = sent.value
        low = {n: np.array([floors.get(i, -np.inf) for i in ids.tolist()], np.float64) for n, (ids, _) in queries.items()}
        for pdf in frames:
            for n, data in zip(pdf["length"], pdf["data"], strict=True):
                if n not in queries:
                    continue
                tree, (ids, v) = pickle.loads(data), queries[n]
                limit = float(np.abs(tree.rows).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, n)
                exact, found = exactly(tree.rows, limit), ([], [], [], [])
                for part in range(0, len(ids), 1024):
                    bounds = tree.bounds(v[part : part + 1024])
                    for j in np.flatnonzero(bounds[:, 0] >= low[n][part : part + 1024]).tolist():
                        i = int(ids[part + j])
                        scores, rows = tree.search(exact, exactly(v[part + j], limit), bounds[j], i, k, floors.get(i, -np.inf), first)
                        for column, values in zip(found, ([i] * len(rows), rows.tolist(), [min(max(int(s), -LONG - 1), LONG) for s in scores.tolist()], range(len(rows))), strict=True):
                            column.extend(values)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.array(x, np.int64) for x in found[:3]), strict=True)) | {"copy": np.array(found[3], np.int32)})

    return grown.mapInPandas(run, "query_id long, vec_id long, score long, copy int")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 50)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
