"""Exact top-k search by inner product over a vector-approximation file.

Components become whole numbers, floor(scale * x). The approximation file keeps
for each vector one cell number of ``bits`` bits a component; the cells of a
component part its range evenly. Queries come in blocks of a bounded size, and
each block is one scan of that file: the corners of a vector's cells bound its
score from both sides, and a vector whose upper bound lies below the k-th best
lower bound seen is passed over. Exact vectors are then read in the order of
their bounds, a few for each query first and more only while an unread bound
reaches the k-th exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored, with_row_id

#: Bytes of the queries of one block, which is what is sent to tasks, and vectors held against them at once.
BLOCK_BYTES, AT_ONCE = 1 << 20, 512


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, in doubles, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _approximated(vectors: DataFrame, dim: int, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(rid, cells): the approximation file."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            found = ((v - low) // width).astype(np.uint8)
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["rid", "cells"])

    return stored(vectors.select("rid", "v").mapInArrow(cells, "rid long, cells binary"))


def _scan(file: DataFrame, queries: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(q, rid, lower, upper): of each query, the vectors whose upper bound reaches the k-th best lower bound that the task has seen.

    The k best lower bounds of a task are among its rows.
    """
    dim = queries.shape[1]
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), -np.inf)
        for batch in batches:
            rids = batch.column(0).to_numpy()
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, dim)
            for at in range(0, len(rids), AT_ONCE):
                rid, least = rids[at : at + AT_ONCE], low + cells[at : at + AT_ONCE].astype(np.float64) * width
                most = least + (width - 1)
                # Sums beyond 2 ** 53 are rounded; what that can be is added to the bounds.
                slack = np.abs(queries).astype(np.float64) @ np.maximum(np.abs(least), np.abs(most)).T * 2.0**-44
                slack[slack < 2.0**-3] = 0
                lower = positive @ least.T + negative @ most.T - slack
                upper = positive @ most.T + negative @ least.T + slack
                lower[own[:, None] == rid] = upper[own[:, None] == rid] = -np.inf
                best = -np.partition(-np.concatenate([best, lower], 1), k - 1, 1)[:, :k]
                q, c = np.nonzero((upper >= best.min(1)[:, None]) & (upper > -np.inf))
                yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(rid[c]), pa.array(lower[q, c]), pa.array(upper[q, c])], names=["q", "rid", "lower", "upper"])

    return file.mapInArrow(bounds, "q int, rid long, lower double, upper double")


def _exact(asked: DataFrame, vectors: DataFrame, queries: np.ndarray) -> DataFrame:
    """(q, id, rid, score) of the asked (q, rid)."""
    dim = queries.shape[1]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).to_numpy()
            found = np.einsum("ij,ij->i", queries[q], _matrix(batch.column(3), dim)) if len(q) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(found)], names=["q", "id", "rid", "score"])

    return asked.select("q", "rid").join(vectors, "rid").select("q", "id", "rid", "v").mapInArrow(scores, "q int, id long, rid long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(file: DataFrame, vectors: DataFrame, queries: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(q, id, rid, score, rank) of one block of queries."""
    found = stored(_scan(file, queries, own, low, width, k))
    by_lower = Window.partitionBy("q").orderBy(F.desc("lower"))
    least = found.select("q", "lower").withColumn("r", F.row_number().over(by_lower)).where(F.col("r") <= k).groupBy("q").agg(F.min("lower").alias("least"))  # fewer than k are all taken
    full = found.groupBy("q").agg((F.count("*") >= k).alias("full"))
    in_order = Window.partitionBy("q").orderBy(F.desc("upper"), "rid")
    open_ = found.join(least, "q").join(full, "q").where(~F.col("full") | (F.col("upper") >= F.col("least"))).select("q", "rid", "upper", F.row_number().over(in_order).alias("place"))
    open_ = stored(open_)
    done, read, more = None, 0, 4 * k
    while True:
        asked = open_.where((F.col("place") > read) & (F.col("place") <= more))
        if done is not None:  # bounds below the k-th exact score are settled
            asked = open_.where((F.col("place") > read) & (F.col("place") <= more)).join(done.where(F.col("rank") == k).select("q", "score"), "q", "left").where(F.col("score").isNull() | (F.col("upper") >= F.col("score")))
            if asked.isEmpty():
                break
        scored = _exact(asked, vectors, queries)
        done = stored(_best(scored if done is None else scored.unionByName(done.drop("rank")), k))
        read, more = more, more * 8
    for t in (found, open_):
        dropped(t)
    return done


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bits: int = 6, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner products for each row that ``is_query``.

    Ties go to the smaller key (null last), then the earlier row; a row is no
    candidate of its own, but one of others with the same key, and repeated query
    rows have their results each. Vectors that are null or hold null or
    non-finite components take no part. Inner products are between vectors of
    equal length, and exact while they fit 63 bits. A query without candidates,
    and an empty table, give no rows. Rows must be read from files. Other
    columns, whatever their names, play no part.
    """
    rows = with_row_id(vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("v")), "rid")
    rows = stored(rows.where(_usable(F.col("v"))).select("rid", "id", "asks", whole(F.col("v"), scale).alias("v")))
    out = None
    for dim in [r[0] for r in rows.where("asks").select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]:
        mine = rows.where(F.size("v") == dim)
        # An empty vector has a component of 0, so that its products are 0.
        mine, dim = (mine, dim) if dim else (mine.withColumn("v", F.array(F.lit(0).cast("long"))), 1)
        ends = mine.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()  # a row a component
        low, high = (np.array([r[i] for r in ends], np.float64) for i in (1, 2))
        width = np.floor((high - low) / (1 << bits)) + 1
        file, asking = _approximated(mine, dim, low, width), mine.where("asks")
        blocks = -(-asking.count() * dim * 8 // BLOCK_BYTES)
        for b in range(blocks):
            block = asking.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).select("rid", "id", "v").toPandas()  # BLOCK_BYTES or so
            if block.empty:
                continue
            queries = np.array(block["v"].tolist(), np.int64)
            names = vectors.sparkSession.createDataFrame([(q, None if i is None or i != i else int(i)) for q, i in enumerate(block["id"])], "q int, query_id long")
            found = _block(file, mine.select("rid", "id", "v"), queries, block["rid"].to_numpy(), low, width, k)
            found = found.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
            out = found if out is None else out.union(found)
    return out if out is not None else rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
