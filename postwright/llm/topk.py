"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Candidates are dealt into blocks; a block holds one list per dimension, sorted by
component. A query reads each list from the end that its weight favours, slice by
slice; a slice only adds the entries that it reads. What has been read bounds every
candidate's score from both sides: unread components are no better than the
list's frontier and no worse than its far end. A query stops when the candidates whose
upper bound reaches its k-th lower bound are few, or cost less to resolve than the
next slice to read; their scores are then resolved. A first pass over one block
gives each query a score that its k best must reach, which all other blocks share.

Bounds are kept in doubles with a margin for their rounding, scores are resolved as
integers: exactly in doubles if all sums stay below 2**51, else in integers of any size.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, nor does a row without an id. A vector without components scores 0.
Shorter vectors count as padded with zeros. Every row is a candidate but the query's
own row; rows that repeat an id or a vector count row by row, as candidates and as
queries; ties go to the smaller vec_id. Scores outside 64 bits saturate. An empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwright.llm.common import stage

#: Candidates of a block, queries that meet it at once, first slice of a list, open candidates that a query resolves without more
#: reading, and what reading an entry costs, in products of two components.
BLOCK, QUERY_BLOCK, SLICE, RESOLVE, READ_COST = 4096, 1024, 64, 96, 16
TOP, BOTTOM = 1, 2
_OUT = "query_rid long, query_id long, rid long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


class Lists:
    """A block's sorted lists: candidates and their components, dimension by dimension, in ascending order."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.value = np.take_along_axis(vectors, self.order, axis=0)


def bounds(lists: Lists, queries: np.ndarray, depths: tuple[int, int], sums: np.ndarray, unread: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Reads a slice of every list for ``queries`` and returns lower and upper bounds of all scores.

    ``sums``: what has been read (candidates x queries); ``unread``: the sums of the worst
    values of unread components, and from which ends each list has been read as far as a
    candidate (lists x candidates). All are updated in place.
    """
    m = len(lists.order)
    low, high = depths
    worst, seen = unread
    for i in range(queries.shape[1]):
        ends = ((queries[:, i] > 0, slice(m - high, m - low), lists.value[0, i], TOP), (queries[:, i] < 0, slice(low, high), lists.value[-1, i], BOTTOM))
        for favoured, rows, value, end in ends:
            cols = np.flatnonzero(favoured)
            if len(cols):
                who, w = lists.order[rows, i], queries[cols, i]
                cells = np.ix_(who, cols)
                sums[cells] += lists.value[rows, i][:, None] * w
                worst[cells] -= value * w
                seen[i, who] |= end
    top, bottom = lists.value[m - high], lists.value[high - 1]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    edge = (up @ top + down @ bottom)[None, :]
    read = (seen & TOP).T.astype(float) @ (up * top).T + (seen // BOTTOM).T.astype(float) @ (down * bottom).T
    return sums + worst, sums + edge - read


def search_block(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, bar: np.ndarray, k: int, margin: float) -> list[np.ndarray]:
    """For each query the candidates (row numbers) that may be among its k best: all whose upper bound reaches its bar.

    ``own``: the query's own row or -1; ``bar``: a score that its k best reach; ``margin``: the rounding of bounds.
    """
    m, lists = len(vectors), Lists(vectors)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    active, sums, seen = np.arange(len(queries)), np.zeros((m, len(queries))), np.zeros((vectors.shape[1], m), np.int8)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    worst = np.tile(up @ lists.value[0] + down @ lists.value[-1], (m, 1))
    depth, step = 0, min(m, SLICE)
    while len(active):
        lower, upper = bounds(lists, queries[active], (depth, depth + step), sums, (worst, seen))
        depth += step
        step = min(m - depth, 2 * step)
        mine = own[active]
        has = np.flatnonzero(mine >= 0)
        lower[mine[has], has] = upper[mine[has], has] = -np.inf
        if m > k:
            kth = np.partition(lower, m - k, axis=0)[m - k]
            bar[active] = np.maximum(bar[active], kth - margin)
        open_ = upper >= bar[active] - margin
        open_[mine[has], has] = False
        count = open_.sum(axis=0)
        # reading on must promise to cost less than resolving what is open
        done = (count <= max(RESOLVE, k)) | (count <= READ_COST * step) | (step == 0)
        for col in np.flatnonzero(done):
            out[active[col]] = np.flatnonzero(open_[:, col])
        left = np.flatnonzero(~done)
        active, sums, worst = active[left], sums[:, left], worst[:, left]
    return out


def _resolve(queries: np.ndarray, vectors: np.ndarray, open_: list[np.ndarray], exact: bool) -> list[list[int]]:
    """Final scores of each query's open candidates."""
    if not exact:
        whole = [[int(x) for x in v] for v in vectors]
        return [[sum(a * b for a, b in zip([int(x) for x in q], whole[i], strict=True)) for i in rows] for q, rows in zip(queries, open_, strict=True)]
    if 8 * sum(map(len, open_)) > len(vectors) * len(queries):
        scores = queries @ vectors.T
        return [scores[j][rows].astype(np.int64).tolist() for j, rows in enumerate(open_)]
    return [(vectors[rows] @ q).astype(np.int64).tolist() for q, rows in zip(queries, open_, strict=True)]


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list[int]] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            width = max(1, *(max(pa.compute.list_value_length(t["v"]).to_pylist()) for t in (left, right)))
            queries, vectors = _matrix(left["v"], width), _matrix(right["v"], width)
            rid, ids = right["rid"].to_numpy(), right["vec_id"].to_numpy()
            place = {int(r): i for i, r in enumerate(rid)}
            own = np.array([place.get(r, -1) for r in left["rid"].to_pylist()])
            bar = np.array([-np.inf if b is None else b for b in left["bar"].to_pylist()])
            reach = width * np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)
            exact = reach < 2.0**51
            margin = 0.0 if exact else reach * width * 2.0**-50
            found = search_block(queries, vectors, own, bar, k, margin)
            scores = _resolve(queries, vectors, found, exact)
            for query_rid, query_id, rows, score_of in zip(left["rid"].to_pylist(), left["vec_id"].to_pylist(), found, scores, strict=True):
                best = heapq.nsmallest(k, ((-s, int(ids[i]), int(i)) for s, i in zip(score_of, rows, strict=True)))
                for score, vec, i in best:
                    for column, x in zip(columns, (query_rid, query_id, int(rid[i]), vec, max(-(2**63), min(2**63 - 1, -score))), strict=True):
                        column.append(x)
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(_OUT.split(", "), columns, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``vectors`` (vec_id, v array<double> of integers) and a condition on vec_id -> query_id, rank, vec_id, score.

    Blocks of queries meet blocks of candidates; each pair of blocks returns k rows a
    query, of which the k best stay. The first block gives the bars that the others
    share. Neither side is broadcast or gathered; no row stands in more than its
    share of blocks, whatever its id.
    """
    vectors = stage(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "topk-vectors")
    queries = vectors.filter(is_query)
    n, m = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda size, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(size)).cast("int")
    c, q = vectors.withColumn("c", block(n, 1)), queries.withColumn("q", block(m, 2))
    best = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")

    def met(q: DataFrame, c: DataFrame) -> DataFrame:
        c = c.toDF(*c.columns)  # both sides stem from one table: their columns need names of their own
        found = q.groupBy("c", "q").cogroup(c.groupBy("c", "q")).applyInArrow(_search(k), _OUT)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    many = lambda size, name: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)
    first = met(q.select("rid", "vec_id", "v", F.lit(None).cast("double").alias("bar"), F.lit(0).alias("c"), "q"), c.filter("c = 0").select("rid", "vec_id", "v", "c", many(m, "q")))
    if n > 1:
        first = stage(first, "topk-first")
        bars = first.filter(F.col("rank") == k).select(F.col("query_rid").alias("rid"), F.col("score").cast("double").alias("bar"))
        blocks = F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("c")
        later = met(q.join(bars, "rid", "left").select("rid", "vec_id", "v", "bar", blocks, "q"), c.filter("c > 0").select("rid", "vec_id", "v", "c", many(m, "q")))
        both = first.drop("rank").union(later.drop("rank"))
        first = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return first.select("query_id", "rank", "vec_id", "score")


def quantised(table: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v): components floor(scale * x); unusable vectors are left out."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double gives a bigint and fails beyond 64 bits; x - x % 1 stays a double
    x = lambda x: F.lit(scale) * x.cast("double")
    floor = lambda x: F.when(x >= 0, x - x % 1).otherwise(x - (x % 1 + 1) % 1)
    return table.select("vec_id", "embedding").filter("vec_id IS NOT NULL").filter(usable).select("vec_id", F.transform("embedding", lambda e: floor(x(e))).alias("v"))


def op9(spark, sf_dir: str) -> DataFrame:
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c AS (SELECT r, vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
s AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.r <> c.r WHERE q.vec_id % 100 = 0 GROUP BY 1, 2, 3, 4
), k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, r) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM k WHERE "rank" <= 10
"""
