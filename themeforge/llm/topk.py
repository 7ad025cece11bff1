"""Exact top-k by inner product with a pivot table.

Inner products become distances: with an added coordinate every candidate has the same
norm M, the largest there is, and a query keeps 0 there, so that the squared distance is
|q|^2 + M^2 - 2 q.x. Larger products are smaller distances, and the triangle inequality
holds. Every row carries its distances to all pivots (the pivot table). For a query and a
candidate the greatest difference of their entries is a lower bound of the distance; it
is the tightest that the table allows. Candidates are evaluated in the order of this
bound, in growing steps, until the next bound exceeds the k-th best distance found.

The queries are dealt to blocks, and so are the candidates; each block of queries meets
each block of candidates once, in a task of bounded size, and the few best of each
meeting are merged by query.

The pivots are ``PIVOTS`` rows chosen farthest-first from a sample of ``PIVOT_SAMPLE``
rows; they influence speed only.

Defined cases: vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; rows that repeat id and vector count once; a query's own row,
which is every row with its id, is no candidate; missing trailing components count as
zero; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table
gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.llm.frames import broadcast_value, map_batches
from themeforge.session import stage

PIVOTS = 32
PIVOT_SAMPLE = 1024
QUERY_ROWS = 2048
CANDIDATE_ROWS = 1024
FIRST_STEP = 64


def integer_vectors(
    embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for rows with finite vectors."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return (
        embeddings.filter(sound & F.col(id).isNotNull())
        .select(F.col(id).cast("bigint").alias("vec_id"), whole.alias("v"))
        .dropDuplicates(["vec_id", "v"])
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of equal width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Row-wise integer products of all pairs; doubles are exact below 2**53."""
    return (a.astype(float) @ b.astype(float).T) if exact else a @ b.T


def pivots_of(vectors: DataFrame, width: int, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Rows far from each other, chosen among the first ``sample`` rows in hash order."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    rows = _matrix(some.column("v"), width).astype(float)
    if not len(rows):
        return np.zeros((0, width))
    chosen = [0]
    nearest = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(rows)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _with_table(vectors: DataFrame, pivots: np.ndarray, norm: float, width: int) -> DataFrame:
    """Add ``as_query`` and ``as_candidate``: the distances of a row to the pivots in either part."""
    shared = broadcast_value(vectors.sparkSession, pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        own = (p * p).sum(1)
        for batch in batches:
            v = _matrix(batch.column(1), width).astype(float)
            dots = v @ p.T
            square = (v * v).sum(1)[:, None] + own - 2 * dots
            query = np.sqrt(np.maximum(square, 0))
            candidate = np.sqrt(np.maximum(own - 2 * dots + norm, 0))
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(p)).cast(pa.list_(pa.float64()))
                if len(p) else pa.array([[]] * len(v), pa.list_(pa.float64()))
                for x in (query, candidate)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *lists], ["vec_id", "v", "as_query", "as_candidate"]
            )

    return map_batches(
        vectors, work,
        "vec_id bigint, v array<bigint>, as_query array<double>, as_candidate array<double>",
    )


def search_block(
    q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray,
    c_ids: np.ndarray, c: np.ndarray, c_table: np.ndarray,
    norm: float, k: int, exact: bool,
) -> list[tuple[int, int, int]]:
    """(query, candidate, score): at least the k best of each query within the block.

    A candidate is left out only if k evaluated ones are strictly nearer than its bound.
    """
    out: list[tuple[int, int, int]] = []
    bound = np.zeros((len(q), len(c)))
    for j in range(q_table.shape[1]):
        np.maximum(bound, np.abs(q_table[:, j, None] - c_table[None, :, j]), out=bound)
    own = q_ids[:, None] == c_ids[None, :]
    bound[own] = np.inf
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    squares = (q.astype(float) ** 2).sum(1)
    for i in range(len(q)):
        usable = int(np.searchsorted(bound[i], np.inf))
        done, step, scores, reach = 0, FIRST_STEP, np.zeros(0, np.int64), np.inf
        while done < usable and bound[i, done] <= reach:
            end = min(usable, done + step)
            found = _products(c[order[i, done:end]], q[i : i + 1], exact)[:, 0]
            scores = np.concatenate((scores, np.rint(found).astype(np.int64) if exact else found))
            done, step = end, step * 2
            if len(scores) >= k:
                best = np.partition(scores, len(scores) - k)[len(scores) - k]
                # a little more than the distance, for rounding
                reach = np.sqrt(max(0.0, squares[i] + norm - 2 * float(best))) * (1 + 1e-9) + 1e-6
        ids = c_ids[order[i, :done]]
        for at in np.lexsort((ids, -scores))[:k].tolist():
            out.append((int(q_ids[i]), int(ids[at]), int(scores[at])))
    return out


def top_k(
    embeddings: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id",
    vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``."""
    vectors = stage(integer_vectors(embeddings, id, vector, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    is_query = F.col("vec_id") % every == 0
    facts = vectors.agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("queries"),
        F.max(F.size("v")).alias("width"), F.max(square).alias("norm"),
    ).first()
    width, norm = facts["width"] or 0, facts["norm"] or 0.0
    exact = norm < 2.0**51
    q_blocks = max(1, -(-facts["queries"] // QUERY_ROWS))
    c_blocks = max(1, -(-facts["n"] // CANDIDATE_ROWS))
    table = _with_table(vectors, pivots_of(vectors, width), norm, width)

    def in_blocks(rows: DataFrame, own: str, blocks: int, other: str, others: int, entries: str) -> DataFrame:
        """Deal rows to blocks of their own, and send them to every block of the other side."""
        return rows.select(
            "vec_id", "v", F.col(entries).alias("entries"),
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))).alias(other),
        )

    queries = in_blocks(table.filter(is_query), "qb", q_blocks, "cb", c_blocks, "as_query")
    candidates = in_blocks(table, "cb", c_blocks, "qb", q_blocks, "as_candidate")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            sides = []
            for side in (left, right):
                entries = side.column("entries").combine_chunks()
                n = side.num_rows
                sides += [
                    side.column("vec_id").to_numpy(), _matrix(side.column("v"), width),
                    entries.flatten().to_numpy(zero_copy_only=False).reshape(n, -1),
                ]
            q_ids, q, q_table, c_ids, c, c_table = sides
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                found += search_block(
                    q_ids[part], q[part], q_table[part], c_ids, c, c_table, norm, k, exact
                )
        return pa.table(
            {
                "query_id": pa.array([f[0] for f in found], pa.int64()),
                "vec_id": pa.array([f[1] for f in found], pa.int64()),
                "score": pa.array([f[2] for f in found], pa.int64()),
            }
        )

    met = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(
        meet, "query_id bigint, vec_id bigint, score bigint"
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
