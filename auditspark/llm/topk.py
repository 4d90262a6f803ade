"""Exact top-k search by inner product without random access.

Queries and candidates are cut into blocks, and every query block meets every candidate block in a task.  There each
dimension is a list of the candidates sorted by its component.  A query reads the list from the top where its own
component is positive and from the bottom where it is negative.  After each stretch of all lists every candidate has a
lower bound (what was read, and the worst end of the lists not yet read) and an upper bound (what was read, and the last
value read from the others).  Reading stops when few candidates reach the k-th best score that is certain; their scores
are then resolved exactly.  Results of earlier stretches of candidates raise that certain score.

Results in odd cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
missing components of shorter vectors count as zero; candidates with the query's own id are left out, so repeated rows do
not find each other; repeated candidates each take a rank; scores beyond 64 bits are cut off at the largest long; columns
other than id and vector are not read; empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import column, ship_package

LONG = np.iinfo(np.int64)


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor x) of every component as a long; null for vectors that take no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


class Best:
    """The k best candidates of each query so far; ties go to the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, object)
        self.floor = np.full(n_queries, -np.inf)  # score that k candidates are certain to have

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.append(self.query, query), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score.astype(object) if score.dtype == object else ~score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - starts
        chosen = rank < self.k
        self.query, self.score, self.id = query[chosen], score[chosen], ids[chosen]
        full = np.flatnonzero(rank == self.k - 1)
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full].astype(float))


def _exact(queries: np.ndarray, candidates: np.ndarray, safe: bool) -> np.ndarray:
    """Row-wise inner products as longs."""
    if safe:
        return np.einsum("ij,ij->i", queries, candidates)
    wide = (queries.astype(object) * candidates.astype(object)).sum(1)
    return np.array([min(max(int(x), LONG.min), LONG.max) for x in wide], np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, *, chunk_rows: int = 1024,
           stops: tuple[float, ...] = (0.3, 0.4, 0.5, 0.65, 0.8, 1.0), few: float = 0.02) -> Best:
    """The k best candidates for every query: bounds while lists are read, then exact scores."""
    best = Best(len(queries), k)
    if not len(queries) or not len(candidates):
        return best
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    safe = largest < 2.0 ** 53
    slack = 0.0 if safe else largest * 2.0 ** -40  # what rounding can do to a bound
    for begin in range(0, len(candidates), chunk_rows):
        own, own_ids = candidates[begin:begin + chunk_rows], ids[begin:begin + chunk_rows]
        n, width = own.shape
        lists = np.argsort(own, axis=0, kind="stable")
        values = np.take_along_axis(own, lists, 0).astype(float)
        top, bottom = np.full((n, width), np.nan), np.full((n, width), np.nan)  # what was read from either end
        done = 0
        for stop in stops:
            depth = max(1, int(np.ceil(stop * n)))
            np.put_along_axis(top, lists[n - depth:n - done], values[n - depth:n - done], 0)
            np.put_along_axis(bottom, lists[done:depth], values[done:depth], 0)
            done = depth
            unread_top, unread_bottom = np.isnan(top), np.isnan(bottom)
            upper = (up @ np.where(unread_top, values[n - depth], top).T + down @ np.where(unread_bottom, values[depth - 1], bottom).T) + slack
            lower = (up @ np.where(unread_top, values[0], top).T + down @ np.where(unread_bottom, values[n - 1], bottom).T) - slack
            # A candidate that is the query itself counts for nothing.
            itself = query_ids[:, None] == own_ids[None, :]
            upper[itself] = lower[itself] = -np.inf
            if n >= k:
                best.floor = np.maximum(best.floor, np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = (upper >= best.floor[:, None]) & ~itself
            if depth == n or open_.mean() <= few:
                break
        at_query, at = np.nonzero(open_)
        best.add(at_query, _exact(queries[at_query], own[at], safe), own_ids[at])
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector", *,
          shard_rows: int = 2048, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): for each query the k best of ``vectors``; both tables hold an id and an array of longs.

    ``shard_rows`` candidates and ``block_rows`` queries meet in a task, on average.
    """
    ship_package(vectors.sparkSession)
    usable = column(id_col).isNotNull() & column(vector_col).isNotNull()
    candidates = vectors.where(usable).select(column(id_col).alias("id"), column(vector_col).alias("v"))
    asked = queries.where(usable).select(column(id_col).alias("id"), column(vector_col).alias("v"))
    n_shards = -(-candidates.count() // shard_rows) or 1
    n_blocks = -(-asked.count() // block_rows) or 1

    def cells(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    id_type = candidates.schema["id"]
    schema = T.StructType([T.StructField("query_id", id_type.dataType), T.StructField("id", id_type.dataType), T.StructField("score", T.LongType())])

    def matrix(table: pa.Table, width: int) -> np.ndarray:
        rows = [x.values.to_numpy() for x in table.column("v")]
        out = np.zeros((len(rows), width), np.int64)
        for i, row in enumerate(rows):
            out[i, :len(row)] = row
        return out

    def meet(asked_here: pa.Table, here: pa.Table) -> pa.Table:
        width = max([1, *(len(x) for t in (asked_here, here) for x in t.column("v"))])
        ids, query_ids = (np.array(t.column("id").to_pylist(), object) for t in (here, asked_here))
        if pa.types.is_integer(here.schema.field("id").type):
            ids, query_ids = ids.astype(np.int64), query_ids.astype(np.int64)
        best = search(matrix(asked_here, width), query_ids, matrix(here, width), ids, k)
        kind = here.schema.field("id").type
        return pa.table({"query_id": pa.array(query_ids[best.query].tolist(), kind), "id": pa.array(best.id.tolist(), kind), "score": pa.array(best.score)})

    met = (cells(asked, "block", n_blocks, "shard", n_shards).groupBy("block", "shard")
           .cogroup(cells(candidates, "shard", n_shards, "block", n_blocks).groupBy("block", "shard")).applyInArrow(meet, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
