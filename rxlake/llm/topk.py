"""Exact top-k inner products: tiles of queries by shards, partial selection, tree merge.

Vectors are dealt to shards and queries to blocks by a hash of the id, each of bounded size. A tile meets one block
of queries and one shard: it multiplies them in slices, keeps the k best of each query per slice by partial
selection, and returns at most k rows per query. Lists are merged in two levels, first among neighbouring shards. The
integer products run in float64 wherever every partial sum stays below 2 ** 53, and in Python integers otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SHARD = 16_384
BLOCK = 8_192
SLICE = 1_024
FAN = 16  # shards whose lists are merged first


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; a product beyond 64 bits stays at the nearest 64-bit value."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    wide = whole(queries) @ whole(rows).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores (ties to smaller ids), as (row, column)."""
    if score.shape[1] > k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(score >= edge)
    else:
        row, col = np.nonzero(np.ones(score.shape, bool))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            q_ids, ids = left.column("vec_id").to_numpy(), right.column("row_id").to_numpy()
            queries = matrix(left.column("vector").combine_chunks())
            rows = matrix(right.column("row_vector").combine_chunks())
            for a in range(0, len(q_ids), SLICE):
                kept = []
                for b in range(0, len(ids), SLICE * 4):
                    some = ids[b:b + SLICE * 4]
                    score = products(queries[a:a + SLICE], rows[b:b + SLICE * 4])
                    # the query's own row takes no part: it loses its place by an extra selection
                    row, col = best(score, some, k + int((np.bincount(np.unique(some, return_inverse=True)[1])).max()))
                    apart = some[col] != q_ids[a:a + SLICE][row]
                    kept.append((row[apart], some[col[apart]], score[row[apart], col[apart]]))
                row, found, value = (np.concatenate(x) for x in zip(*kept))
                order = np.lexsort((found, -value, row))
                row, found, value = row[order], found[order], value[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append((q_ids[a + row[top]], found[top], value[top]))
        q, v, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = 1024.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the k best rows of each query but its own.

    Needs ``vec_id`` and ``embedding``; each component counts as floor(scale * x). Rows without an id or with a null
    or non-finite component take no part; vectors of different lengths do not meet, and the product of two empty ones
    is 0. Ties go to the smaller id; rows that share an id are rows of their own, none of which meets a query of that
    id. An empty table gives an empty result.
    """
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.expr(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    ready = vectors.where(sound).select(
        F.col("vec_id").cast("long"), F.expr(f"transform(embedding, x -> cast(floor(cast({scale!r}D as double) * cast(x as double)) as double))").alias("vector"),
        F.size("embedding").alias("dim"), is_query.alias("asks"),
    )
    total, asked = ready.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, math.ceil(total / SHARD)), max(1, math.ceil(asked / BLOCK))
    deal = F.xxhash64("vec_id")
    rows = ready.select(F.col("vec_id").alias("row_id"), F.col("vector").alias("row_vector"), F.col("dim").alias("row_dim"), F.pmod(deal, F.lit(shards)).cast("int").alias("shard"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = ready.where("asks").select("vec_id", "vector", "dim", F.pmod(deal, F.lit(blocks)).cast("int").alias("block"),
                                         F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    tiles = ["dim", "block", "shard"]
    lists = queries.groupBy(*tiles).cogroup(rows.groupBy("row_dim", "block", "shard")).applyInArrow(tile(k), "query_id long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    part = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(shards)) / FAN)
    lists = lists.withColumn("part", part)
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
