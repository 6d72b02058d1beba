"""Exact top-k search by inner product: Fagin's threshold algorithm.

Vectors are dealt evenly into row blocks and queries into query blocks; each pair of blocks is
a cell, so a cell's memory is bounded and all of the query set meets all rows. In a cell each
dimension has a sorted list of its values. A query walks the lists of all its dimensions at
once (from the top for positive weights, from the bottom for negative ones), scores each row
that it meets for the first time on the whole vector, and stops when the threshold, which is
the sum of the weights times the values that the lists have come to, cannot beat its kth best
score, or when its lists have shown every row. The first row block is searched first: its kth
score is a floor that each query takes to all other cells, which stop by it and return only
what reaches it. The best k of the cells are merged by query.

In many dimensions of noise the threshold sinks slowly: the lists show every row before it
comes down to the kth score. README has measured figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows and queries of a cell: each row is sent once for so many queries, each query once for so many rows.
ROW_BLOCK, QUERY_BLOCK = 16_384, 16_384
FIRST_DEPTH = 16


def threshold_search(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int, order: np.ndarray, values: np.ndarray, floor: int | None = None) -> tuple[list[tuple[int, int]], int, bool]:
    """The k best (score, id) of ``rows``, ties to smaller ids, without those of id ``own``; rows scored; whether it stopped by the threshold.

    ``order`` and ``values`` are the ascending lists of each dimension (rows x dimensions). A
    ``floor`` is a score that the kth best of all rows is known to reach: lower ones are left out.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    if not len(used):  # every score is 0: any list shows the rows
        used = np.arange(min(1, len(query)))
    weight = query[used]
    up = weight < 0
    seen = np.zeros(n, bool)
    best_s, best_i = np.zeros(0, rows.dtype), np.zeros(0, np.int64)
    depth, step, scored, stopped = 0, FIRST_DEPTH, 0, False
    while scored < n:
        to = min(n, depth + step) if len(used) else n
        met = np.zeros(n, bool)
        if len(used):
            met[order[depth:to, used[up]].ravel()] = True
            met[order[n - to : n - depth, used[~up]].ravel()] = True
        else:
            met[:] = True
        fresh = np.flatnonzero(met & ~seen)
        seen |= met
        scored += len(fresh)
        score = rows[fresh] @ query
        good = ids[fresh] != own
        if floor is not None:
            good &= score >= floor
        best_s, best_i = np.concatenate([best_s, score[good]]), np.concatenate([best_i, ids[fresh][good]])
        if len(best_s) > k:
            least = np.partition(best_s, len(best_s) - k)[len(best_s) - k]
            near = best_s >= least
            best_s, best_i = best_s[near], best_i[near]
            first = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[first], best_i[first]
        depth, step = to, step * 2
        if depth < n and scored < n:
            bound = (weight * np.where(up, values[depth, used], values[n - 1 - depth, used])).sum()
            beat = max([*([best_s.min()] if len(best_s) >= k else []), *([floor] if floor is not None else [])], default=None)
            if beat is not None and bound < beat:
                stopped = True
                break
    first = np.lexsort((best_i, -best_s))[:k]
    return [(int(best_s[x]), int(best_i[x])) for x in first], scored, stopped


FOUND, FOUND_NAMES = "ask long, query_id long, vec_id long, score long, scored long, stopped boolean", ["ask", "query_id", "vec_id", "score", "scored", "stopped"]


def _cell(k: int):
    """Rows of the best k of each query; one with a null vec_id says how many rows a query scored and whether it stopped early."""

    def search(group: pa.Table) -> pa.Table:
        ask = group.column("ask")
        asked = ~np.asarray(ask.is_null())
        ids = group.column("id").to_numpy()
        flat = group.column("vector").combine_chunks().flatten().to_numpy()
        dims = len(flat) // max(1, len(ids))
        data = flat.reshape(len(ids), dims)
        rows, own = data[~asked], ids[~asked]
        out: list[tuple] = []
        # Sums of products are exact in doubles below 2^53, and much faster there.
        exact = dims and float(np.abs(data.astype(np.float64)).max(initial=0)) ** 2 * dims < 2**53
        rows = rows.astype(np.float64 if exact else np.int64)
        order = np.argsort(rows, axis=0, kind="stable")
        values = np.take_along_axis(rows, order, axis=0)
        if len(own):
            for a, q, v, floor in zip(np.asarray(ask.to_pylist(), object)[asked], ids[asked], data[asked], np.asarray(group.column("floor").to_pylist(), object)[asked], strict=True):
                got, scored, stopped = threshold_search(own, rows, v.astype(rows.dtype), int(q), k, order, values, floor)
                out.extend((a, int(q), i, s, None, None) for s, i in got)
                out.append((a, int(q), None, None, scored, stopped))
        types = [pa.int64()] * 5 + [pa.bool_()]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table({n: pa.array(c, t) for n, c, t in zip(FOUND_NAMES, cols, types, strict=True)})

    return search


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "id", vector_col: str = "vector", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """What the cells find (FOUND): candidates for each query's best k, and how many rows it scored in each cell."""
    good = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    good = good.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    n, asked = good.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    r, q = max(1, -(-n // row_block)), max(1, -(-asked // query_block))
    deal = F.xxhash64(F.monotonically_increasing_id())  # evenly, however often an id is repeated
    none = F.lit(None).cast("long")
    rows = good.select(none.alias("ask"), "id", "vector", F.size("vector").alias("dims"), F.pmod(deal, F.lit(r)).alias("r"), none.alias("floor"))
    rows = cut(rows) if r > 1 else rows  # the deal is the same for both passes
    queries = good.where("asked").select(F.xxhash64("id", "vector").alias("ask"), "id", "vector", F.size("vector").alias("dims")).distinct()
    queries = queries.withColumn("q", F.pmod("ask", F.lit(q)))

    def cells(rows: DataFrame, queries: DataFrame, blocks: Column) -> DataFrame:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q - 1).cast("long"))).alias("q"))
        sent = queries.select("ask", "id", "vector", "dims", F.explode(blocks).alias("r"), "floor", "q")
        return rows.unionByName(sent).groupBy("dims", "r", "q").applyInArrow(_cell(k), FOUND)

    first = cells(rows.where("r = 0"), queries.withColumn("floor", none), F.array(F.lit(0).cast("long")))
    if r == 1:
        return first
    first = cut(first)
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score")))
    floors = first.where("vec_id is not null").withColumn("n", place).where(F.col("n") == k).select("ask", F.col("score").alias("floor"))
    more = cells(rows.where("r > 0"), queries.join(floors, "ask", "left"), F.sequence(F.lit(1).cast("long"), F.lit(r - 1).cast("long")))
    return first.unionByName(more)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "id", vector_col: str = "vector", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product with each query row.

    Vectors are arrays of long. Ties go to smaller ids; a query never meets rows of its own
    id; with fewer than k other rows, all are returned. Rows with a null id or vector or a
    null component take no part; a query meets the vectors of its own number of dimensions.
    Query rows with equal ids and vectors are one query; with equal ids and other vectors they
    are queries of their own, with ranks of their own; as candidates, rows that repeat an id
    each count. An empty table gives an empty result; extra columns are not read.
    """
    found = search(vectors, is_query, k, id_col, vector_col, row_block, query_block).where("vec_id is not null")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 best rows for each vec_id divisible by 100."""
    whole = embeddings.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = whole.select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(whole, F.col("id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
