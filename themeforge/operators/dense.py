"""Exact comparison of dense vectors in blocks.

Each task multiplies a block of query vectors with a block of reference vectors
in NumPy and hands back only what the caller keeps of it (the k nearest, a sum
per class), so all pairs are looked at but never written out. Spark spreads and
merges the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from themeforge.operators.ordering import order_hash, top_rows
from themeforge.session import ship_package, stage

LOWER_IS_NEARER = {"euclidean": True, "inverse_cosine": True, "cosine": False, "dot": False}

BROADCAST_VALUES = 8_000_000  # at most 64 MB of float64 travels to every task
BLOCK_ROWS = 20_000
MOST_BLOCKS = 16  # blocks smaller than BLOCK_ROWS grow before a table is cut into more
ALL_PAIRS_ROWS = 1_000


def _matrix(column, width: int) -> np.ndarray:
    """Lists of numbers as rows; a list of another length than ``width`` is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    if len(column) and not pc.all(pc.equal(lengths, width)).as_py():
        odd = next(n for n in lengths.to_pylist() if n != width)
        raise ValueError(f"a vector has {odd} components where the others have {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), width)


CLOSE = 1e-3  # squared distances below this share of the squared norms are taken directly


def _squared_distances(queries: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """From products where this keeps the digits, from differences where it would lose them."""
    q = np.einsum("ij,ij->i", queries, queries)
    r = np.einsum("ij,ij->i", refs, refs)
    sizes = q[:, None] + r[None, :]
    squared = np.maximum(sizes - 2.0 * (queries @ refs.T), 0.0)
    rows, cols = np.nonzero(squared < CLOSE * sizes)
    for at in range(0, len(rows), 50_000):
        i, j = rows[at : at + 50_000], cols[at : at + 50_000]
        gap = queries[i] - refs[j]
        squared[i, j] = np.einsum("ij,ij->i", gap, gap)
    return squared


def compare(queries: np.ndarray, refs: np.ndarray, measure: str) -> np.ndarray:
    """Matrix of measures, one row per query; NaN where a cosine has a zero norm."""
    if measure == "euclidean":
        return np.sqrt(_squared_distances(queries, refs))
    product = queries @ refs.T
    if measure == "dot":
        return product
    q = np.einsum("ij,ij->i", queries, queries)
    r = np.einsum("ij,ij->i", refs, refs)
    with np.errstate(divide="ignore", invalid="ignore"):
        similarity = product / np.sqrt(q[:, None] * r[None, :])
        if measure == "cosine":
            return similarity
        return np.where(similarity == 0.0, np.inf, 1.0 / similarity)


RANK_SCALE = 1e12  # scores that agree to this many parts rank by name


def _rank_key(score: str, measure: str) -> Column:
    """What workers rank by, as a column: the same products and roundings."""
    signed = F.col(score) if LOWER_IS_NEARER[measure] else -F.col(score)
    return F.rint(signed * RANK_SCALE)


def _keep_nearest(k: int, measure: str, q_ids, scores, ref_table) -> pa.Table:
    """The k best references of each query; equal scores rank by reference name."""
    keyed = np.rint((scores if LOWER_IS_NEARER[measure] else -scores) * RANK_SCALE)
    keyed[np.isnan(keyed)] = np.inf
    width = min(k, keyed.shape[1])
    bound = np.partition(keyed, width - 1, axis=1)[:, width - 1]
    row, col = np.nonzero((keyed <= bound[:, None]) & ~np.isnan(scores))
    order = np.lexsort((col, keyed[row, col], row))  # references come sorted by name
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    kept = rank <= k
    row, col, rank = row[kept], col[kept], rank[kept]
    return pa.table(
        [q_ids.take(pa.array(row)), ref_table.column(0).take(pa.array(col)),
         pa.array(scores[row, col], pa.float64()), pa.array(rank, pa.int32())],
        names=["q", "r", "s", "rank"],
    )


def _keep_all(q_ids, scores, ref_table) -> pa.Table:
    """Every pair; null where the measure is undefined."""
    n, m = scores.shape
    rows, cols = np.divmod(np.arange(n * m), m)
    values = scores.ravel()
    return pa.table(
        [q_ids.take(pa.array(rows)), ref_table.column(0).take(pa.array(cols)),
         pa.array(values, pa.float64(), mask=np.isnan(values))],
        names=["q", "r", "s"],
    )


def _keep_kernel_mass(sigma: float, q_ids, scores, ref_table) -> pa.Table:
    """Per query and group: the sum of exp(-(d / sigma)^2 / 2) over the group's references."""
    values = np.exp(-0.5 * (scores / sigma) ** 2)
    names = pc.unique(ref_table.column(2))
    codes = pc.index_in(ref_table.column(2), names).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    sums = np.add.reduceat(values[:, order], starts, axis=1)
    sizes = np.diff(np.r_[starts, len(codes)])
    n, g = sums.shape
    rows, cols = np.divmod(np.arange(n * g), g)
    return pa.table(
        [q_ids.take(pa.array(rows)), names.take(pa.array(cols)),
         pa.array(sums.ravel(), pa.float64()), pa.array(sizes[cols], pa.int64())],
        names=["q", "g", "mass", "n"],
    )


def _arrow_schema(out: StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])


def _worker(keep, measure: str, out: StructType, ref_name: str, width: int):
    """Compare one query block with one reference block and reduce it with ``keep``."""
    arrow_out = _arrow_schema(out)

    def work(q_ids, q_vectors, table: pa.Table) -> pa.Table:
        table = table.sort_by(ref_name)
        ids = q_ids.combine_chunks() if isinstance(q_ids, pa.ChunkedArray) else q_ids
        scores = compare(_matrix(q_vectors, width), _matrix(table.column(1), width), measure)
        found = keep(ids, scores, table)
        return found.rename_columns(arrow_out.names).cast(arrow_out)

    return work


def block_count(n: int, block_rows: int) -> int:
    """Blocks for ``n`` rows, of ``block_rows`` or, beyond ``MOST_BLOCKS``, of up to ``BLOCK_ROWS`` rows.

    Every row is shuffled once for each block of the other side, and each block gives back
    what it keeps of every query. Small blocks of large tables would multiply both.
    """
    return math.ceil(n / max(block_rows, min(BLOCK_ROWS, math.ceil(n / MOST_BLOCKS))))


def _bucket(name: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(name)), n).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], work, out: StructType) -> DataFrame:
    """Bring query and reference blocks with equal keys together; blocks have bounded size."""
    arrow_out = _arrow_schema(out)

    def block_pair(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return arrow_out.empty_table()
        r = r.drop_columns(keys)
        step = max(1, 4_000_000 // r.num_rows)
        found = [
            work(part.column(0), part.column(1), r)
            for part in (q.slice(at, step) for at in range(0, q.num_rows, step))
        ]
        return pa.concat_tables(found)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_pair, out)


def _blockwise(
    queries: DataFrame,
    refs: DataFrame,
    measure: str,
    keep: Callable[..., pa.Table],
    out: StructType,
    broadcast_values: int,
    block_rows: int,
    reduces: bool = True,
) -> tuple[DataFrame, bool]:
    """Run ``keep`` on every (query block, reference block); columns are id, vector[, group].

    ``reduces`` says that ``keep`` returns few rows per query, so that blocks may grow.

    The flag says whether each query met all references in one block, so that
    nothing is left to merge.
    """
    spark = queries.sparkSession
    ship_package(spark)
    queries = queries.filter(F.col(queries.columns[1]).isNotNull())
    refs = refs.filter(F.col(refs.columns[1]).isNotNull())
    # Row count and width are measured, for all rows, before anything is fetched.
    length = F.size(refs.columns[1])
    facts = refs.agg(F.count("*").alias("n"), F.min(length).alias("least"), F.max(length).alias("most")).first()
    n_refs, width = facts["n"], facts["most"]
    if not n_refs:
        return spark.createDataFrame([], out), True
    if facts["least"] != width:
        raise ValueError(f"vectors have {facts['least']} to {width} components")
    work = _worker(keep, measure, out, refs.columns[0], width)

    if n_refs * max(1, width) <= broadcast_values:
        # All references together are at most ``broadcast_values`` numbers.
        shared = spark.sparkContext.broadcast(refs.toArrow())

        def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            step = max(1, 4_000_000 // max(1, table.num_rows))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    yield from work(part.column(0), part.column(1), table).to_batches()

        return queries.mapInArrow(map_side, out), True

    n_queries = queries.count()
    count = block_count if reduces else lambda n, rows: math.ceil(n / rows)
    blocks, splits = count(n_refs, block_rows), max(1, count(n_queries, block_rows) if n_queries else 1)

    left = queries.withColumn("_s", _bucket(queries.columns[0], F.lit(splits)))
    right = refs.withColumn("_b", _bucket(refs.columns[0], F.lit(blocks)))
    left, right = left.withColumn("_b", _every(F.lit(blocks))), right.withColumn("_s", _every(F.lit(splits)))

    return _meet(left, right, ["_b", "_s"], work, out), False


def _pick(df: DataFrame, names: list[str], vector: str) -> DataFrame:
    wide = ArrayType(DoubleType())
    return df.select(*[F.col(n).cast(wide).alias(n) if n == vector else F.col(n) for n in names])


def _score_schema(q: DataFrame, r: DataFrame, query_id: str, ref_id: str, score: str) -> StructType:
    return StructType([
        StructField(query_id, q.schema[query_id].dataType),
        StructField(ref_id, r.schema[ref_id].dataType),
        StructField(score, DoubleType()),
    ])


def _scored(
    queries, refs, query_id, query_vector, ref_id, ref_vector, score, measure, keep, sizes, ranked
):
    if measure not in LOWER_IS_NEARER:
        raise ValueError(f"unknown measure: {measure}")
    q = _pick(queries, [query_id, query_vector], query_vector)
    r = _pick(refs, [ref_id, ref_vector], ref_vector)
    out = _score_schema(q, r, query_id, ref_id, score)
    if ranked:
        out = out.add("rank", IntegerType())
    return _blockwise(q, r, measure, keep, out, *sizes, reduces=ranked)


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    query_id: str,
    query_vector: str,
    ref_id: str,
    ref_vector: str,
    measure: str = "euclidean",
    score: str = "distance",
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, ref_id, score, rank): the ``k`` nearest references of each query, exactly.

    Ties rank by ``ref_id``. References too large to send everywhere are split
    into blocks that meet the query blocks through a shuffle.
    """

    def keep(ids, scores, table):
        return _keep_nearest(k, measure, ids, scores, table)

    found, complete = _scored(
        queries, refs, query_id, query_vector, ref_id, ref_vector, score, measure, keep,
        (broadcast_values, block_rows), True,
    )
    if complete:
        return found
    found = found.drop("rank")
    return top_rows(found, [query_id], [_rank_key(score, measure), F.col(ref_id)], k)


def nearest_probed(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    query_id: str,
    query_vector: str,
    ref_id: str,
    ref_vector: str,
    cells: int,
    probes: int = 8,
    score: str = "distance",
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Approximate Euclidean ``nearest``: each query looks into its ``probes`` closest cells.

    References belong to the cell of their closest pivot; pivots are ``cells``
    references in hash order. A cell of any size is split into blocks, so crowded
    cells stay parallel. Queries whose cells hold fewer than ``k`` references go on
    with twice as many until they have k, or all there are. With as many probes as
    cells the result is exact.
    """
    ship_package(queries.sparkSession)
    q = _pick(queries, [query_id, query_vector], query_vector)
    r = _pick(refs, [ref_id, ref_vector], ref_vector)
    q, r = q.filter(F.col(query_vector).isNotNull()), r.filter(F.col(ref_vector).isNotNull())
    facts = r.agg(F.count("*").alias("n"), F.max(F.size(ref_vector)).alias("width")).first()
    out = _score_schema(q, r, query_id, ref_id, score).add("rank", IntegerType())
    if not facts["n"]:
        return queries.sparkSession.createDataFrame([], out)
    wanted, cells = min(k, facts["n"]), min(cells, facts["n"])
    pivots = stage(
        r.orderBy(order_hash(ref_id, seed)).limit(cells).withColumnRenamed(ref_id, "_cell"), "pivots"
    )
    homes = stage(
        nearest(r, pivots, 1, ref_id, ref_vector, "_cell", ref_vector).select(ref_id, "_cell"), "homes"
    )

    def keep(ids, scores, table):
        return _keep_nearest(k, "euclidean", ids, scores, table)

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    def search(asked: DataFrame, n: int) -> DataFrame:
        looks = nearest(asked, pivots, n, query_id, query_vector, "_cell", ref_vector).select(
            query_id, "_cell"
        )
        sizes = parts(homes, "_blocks").join(parts(looks, "_splits"), "_cell")
        left = asked.join(looks, query_id).join(sizes, "_cell").select(
            query_id, query_vector, "_cell", _bucket(query_id, F.col("_splits")).alias("_s"),
            _every(F.col("_blocks")).alias("_b"),
        )
        right = r.join(homes, ref_id).join(sizes, "_cell").select(
            ref_id, ref_vector, "_cell", _bucket(ref_id, F.col("_blocks")).alias("_b"),
            _every(F.col("_splits")).alias("_s"),
        )
        work = _worker(keep, "euclidean", out, ref_id, facts["width"])
        found = _meet(left, right, ["_cell", "_b", "_s"], work, out)
        order = [_rank_key(score, "euclidean"), F.col(ref_id)]
        return stage(top_rows(found.drop("rank"), [query_id], order, k), "probed")

    found, done = search(q, min(probes, cells)), []
    while probes < cells:
        full = found.groupBy(query_id).agg(F.count("*").alias("_n")).filter(F.col("_n") >= wanted)
        short = q.join(full, query_id, "left_anti")
        if not short.limit(1).count():
            break
        done.append(found.join(full, query_id, "left_semi"))
        probes, q = min(cells, 2 * probes), short
        found = search(q, probes)
    return reduce(DataFrame.unionByName, [*done, found])


def all_scores(
    queries: DataFrame, refs: DataFrame, query_id: str, query_vector: str,
    ref_id: str, ref_vector: str, measure: str = "euclidean", score: str = "distance",
) -> DataFrame:
    """(query_id, ref_id, score) of every query against every reference.

    Each block gives at most ``ALL_PAIRS_ROWS`` squared rows at a time.
    """
    found, _ = _scored(
        queries, refs, query_id, query_vector, ref_id, ref_vector, score, measure, _keep_all,
        (BROADCAST_VALUES, ALL_PAIRS_ROWS), False,
    )
    return found


def kernel_mass(
    queries: DataFrame,
    refs: DataFrame,
    query_id: str,
    ref_id: str,
    group: str,
    vector: str = "embedding",
    sigma: float = 1.0,
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, group, mass, n): Gaussian kernel sums over each group's references.

    The mass normalises a row of kernel values to 1, see ``kernel_row``.
    """
    q = _pick(queries, [query_id, vector], vector)
    r = _pick(refs, [ref_id, vector, group], vector)
    out = StructType([
        StructField(query_id, q.schema[query_id].dataType),
        StructField(group, r.schema[group].dataType),
        StructField("mass", DoubleType()),
        StructField("n", LongType()),
    ])

    def keep(ids, scores, table):
        return _keep_kernel_mass(sigma, ids, scores, table)

    parts, complete = _blockwise(q, r, "euclidean", keep, out, broadcast_values, block_rows)
    if complete:
        return parts
    return parts.groupBy(query_id, group).agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"))


def kernel_row(pairs: DataFrame, mass: DataFrame, query_id: str, group: str, sigma: float = 1.0) -> DataFrame:
    """Add ``pmf`` to (query, reference, group, distance) pairs: kernel value over the row's mass.

    Null where the mass underflows to zero.
    """
    value = F.exp(-0.5 * (F.col("distance") / sigma) * (F.col("distance") / sigma))
    joined = pairs.join(mass.select(query_id, group, "mass"), [query_id, group])
    return joined.withColumn("pmf", F.when(F.col("mass") > 0, value / F.col("mass"))).drop("mass")
