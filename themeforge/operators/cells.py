"""A trained partition of vectors into cells, for nearest neighbours without all pairs.

The cells are the k-means clusters of a bounded sample (``SAMPLE_ROWS`` rows in hash
order); every row is assigned to the nearest centre. A cell knows how many rows it has and,
for up to ``PIVOTS`` centres, the least and the greatest distance of its rows to them.

- ``search`` is exact. A first round looks into the cells closest to a query until they hold
  k rows; the k-th distance found is the query's reach. By the triangle inequality no row of a
  cell is nearer than the gap between the query's distance to a pivot and the cell's
  distances to it, so a second round sends the query only to cells whose gap is within
  its reach.
- ``search_probed`` looks into the closest ``probes`` cells only. ``learn_probes`` finds how
  many that must be for a wanted recall, by exact search for a bounded sample of queries.

- ``kernel_mass`` sums a Gaussian kernel; cells in which it hardly varies are not visited.

How much these save depends on the data: where vectors form clusters, few cells are
visited; where they are spread evenly in many dimensions, all distances are alike and
most cells must be. Cells of any size are split into blocks, so a crowded one stays parallel.

Distances are Euclidean. Null vectors take no part; rows of equal distance rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from themeforge.operators.dense import (
    BLOCK_ROWS, _bucket, _every, _keep_kernel_mass, _keep_nearest, _matrix, _meet, _pick, _rank_key, _score_schema,
    _squared_distances, _worker,
)
from themeforge.operators.ordering import order_hash, top_rows
from themeforge.session import ship_package, stage

SAMPLE_ROWS = 50_000
SAMPLE_QUERIES = 500
PIVOTS = 32
#: Distances from rounded sums may be off by this share; bounds give way by as much.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """Vectors in cells. The arrays are bounded by the number of cells, a parameter."""

    members: DataFrame  # (id, vector, cell)
    id: str
    vector: str
    centres: np.ndarray  # by cell
    sizes: np.ndarray  # rows by cell
    least: np.ndarray  # by cell and pivot: least distance of a row; pivots are the first centres
    most: np.ndarray

    @property
    def rows(self) -> int:
        return int(self.sizes.sum())


def _batches(frame: DataFrame, place: int, width: int, work, schema) -> DataFrame:
    """``mapInArrow`` in which ``work(batch, matrix)`` sees the vectors as a matrix."""
    ship_package(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch, _matrix(batch.column(place), width))

    return frame.mapInArrow(run, schema)


def _distances(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(_squared_distances(matrix, centres))


def build_cells(
    refs: DataFrame, id: str, vector: str, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 42,
    pivots: int = PIVOTS, iterations: int = 10,
) -> Cells:
    """Train ``cells`` centres on a sample of at most ``sample_rows`` rows and assign every row."""
    spark = refs.sparkSession
    given = _pick(refs, [id, vector], vector).filter(F.col(vector).isNotNull())
    sample = stage(given.orderBy(order_hash(id, seed), id).limit(sample_rows), "cell-sample")
    size = F.size(vector)
    facts = given.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if not facts["n"]:
        none = np.zeros((0, 0))
        return Cells(given.withColumn("cell", F.lit(0)), id, vector, none, np.zeros(0, int), none, none)
    if facts["least"] != facts["most"]:
        raise ValueError(f"vectors have {facts['least']} to {facts['most']} components")
    width = facts["most"]
    if facts["n"] > 1 and cells > 1:
        points = sample.select(array_to_vector(vector).alias("features"))
        model = KMeans(k=min(cells, facts["n"]), seed=seed, maxIter=iterations).fit(points)
        centres = np.array(model.clusterCenters())
    else:
        centres = np.array(sample.select(vector).first()[0], float)[None]
    shared = spark.sparkContext.broadcast(centres)

    def home(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell = _distances(matrix, shared.value).argmin(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [id, vector, "cell"])

    kind = given.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, `{vector}` array<double>, cell int"
    members = stage(_batches(given, 1, width, home, schema), "cell-members")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per cell and pivot of a task, whatever its rows."""
        marks = shared.value[:pivots]
        shape = (len(shared.value), len(marks))
        least, most, n = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape[0], np.int64)
        for batch in batches:
            if batch.num_rows:
                gap = _distances(_matrix(batch.column(0), width), marks)
                cell = batch.column(1).to_numpy()
                np.minimum.at(least, cell, gap)
                np.maximum.at(most, cell, gap)
                n += np.bincount(cell, minlength=shape[0])
        cell = np.flatnonzero(n)
        at = np.repeat(cell, shape[1])
        pivot = np.tile(np.arange(shape[1]), len(cell))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (at, pivot, n[at], least[at, pivot], most[at, pivot])],
            ["cell", "pivot", "n", "least", "most"],
        )

    parts = members.select(vector, "cell").mapInArrow(
        spread, "cell bigint, pivot bigint, n bigint, least double, most double"
    )
    table = parts.groupBy("cell", "pivot").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    ).toArrow()
    cell, pivot, n, least, most = (table.column(k).to_numpy() for k in range(5))
    shape = (len(centres), min(pivots, len(centres)))
    sizes, low, high = np.zeros(shape[0], np.int64), np.full(shape, np.inf), np.full(shape, np.inf)
    sizes[cell], low[cell, pivot], high[cell, pivot] = n, least, most
    return Cells(members, id, vector, centres, sizes, low, high)


def _asked(queries: DataFrame, id: str, vector: str) -> DataFrame:
    return _pick(queries, [id, vector], vector).filter(F.col(vector).isNotNull())


def _looks(queries: DataFrame, index: Cells, id: str, choose, extra: list[str]) -> DataFrame:
    """(id, cell) of the cells that ``choose(distances, extra columns)`` marks for each query."""
    centres = queries.sparkSession.sparkContext.broadcast(index.centres)

    def work(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        gaps = _distances(matrix, centres.value)
        more = [batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(extra))]
        row, cell = np.nonzero(choose(gaps, *more))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(cell, pa.int32())], [id, "cell"]
        )

    kind = queries.schema[id].dataType.simpleString()
    return _batches(queries, 1, index.centres.shape[1], work, f"`{id}` {kind}, cell int")


def _met(
    asked: DataFrame, looks: DataFrame, index: Cells, members: DataFrame, id: str, vector: str, work, out,
    block_rows: int,
) -> DataFrame:
    """Bring the queries of a cell and its members together, in blocks of ``block_rows``."""
    splits = looks.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_splits"))
    sizes = asked.sparkSession.createDataFrame(
        [(int(c), -(-int(n) // block_rows)) for c, n in enumerate(index.sizes) if n], "cell int, _blocks int"
    )
    deals = splits.join(F.broadcast(sizes), "cell")
    rest = [c for c in members.columns if c != "cell"]
    left = asked.join(looks, id).join(deals, "cell").select(
        id, vector, F.col("cell").alias("_cell"), _bucket(id, F.col("_splits")).alias("_s"),
        _every(F.col("_blocks")).alias("_b"),
    )
    right = members.join(deals, "cell").select(
        *rest, F.col("cell").alias("_cell"), _bucket(index.id, F.col("_blocks")).alias("_b"),
        _every(F.col("_splits")).alias("_s"),
    )
    return _meet(left, right, ["_cell", "_b", "_s"], work, out)


def _best_in(
    asked: DataFrame, looks: DataFrame, index: Cells, k: int, id: str, vector: str, score: str, block_rows: int
) -> DataFrame:
    """(id, ref, score): the k best rows of the cells each query looks into, per block."""
    out = _score_schema(asked, index.members, id, index.id, score).add("rank", IntegerType())

    def keep(ids, scores, table):
        return _keep_nearest(k, "euclidean", ids, scores, table)

    work = _worker(keep, "euclidean", out, index.id, index.centres.shape[1])
    return _met(asked, looks, index, index.members, id, vector, work, out, block_rows).drop("rank")


def _ranked(found: DataFrame, index: Cells, k: int, id: str, score: str) -> DataFrame:
    return top_rows(found, [id], [_rank_key(score, "euclidean"), F.col(index.id)], k)


def _nothing(queries: DataFrame, index: Cells, id: str, score: str) -> DataFrame:
    out = _score_schema(queries, index.members, id, index.id, score).add("rank", IntegerType())
    return queries.sparkSession.createDataFrame([], out)


def _closest_with(k: int, sizes: np.ndarray):
    """Marks the closest cells until they hold ``k`` rows."""

    def choose(gaps: np.ndarray) -> np.ndarray:
        order = np.argsort(gaps, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        marked = np.zeros(gaps.shape, bool)
        np.put_along_axis(marked, order, held < k, axis=1)
        return marked & (sizes > 0)

    return choose


def visited(queries: DataFrame, index: Cells, k: int, id: str, vector: str, block_rows: int = BLOCK_ROWS):
    """The two rounds of ``search``: (asked, first looks, first found, second looks)."""
    asked = stage(_asked(queries, id, vector), "asked")
    first = stage(_looks(asked, index, id, _closest_with(k, index.sizes), []), "first-looks")
    found = stage(_best_in(asked, first, index, k, id, vector, "_score", block_rows), "first-found")
    reach = _ranked(found, index, k, id, "_score").filter(F.col("rank") == min(k, index.rows))
    # Beyond a query's reach nothing can be better; without one nothing is left out.
    limits = asked.join(reach.select(id, F.col("_score").alias("_reach")), id, "left").select(
        id, vector, F.coalesce("_reach", F.lit(float("inf"))).alias("_reach")
    )
    near = _closest_with(k, index.sizes)
    least, most, sizes = index.least, index.most, index.sizes

    def within(gaps: np.ndarray, reach: np.ndarray) -> np.ndarray:
        marks = gaps[:, : least.shape[1]]
        open_cells = ~near(gaps) & (sizes > 0)
        for p in range(marks.shape[1]):
            d = marks[:, p, None]
            gap = np.maximum(d - most[None, :, p], least[None, :, p] - d)
            open_cells &= gap <= reach[:, None] + SLACK * (1.0 + d)
        return open_cells

    second = stage(_looks(limits, index, id, within, ["_reach"]), "second-looks")
    return asked, first, found, second


def search(
    queries: DataFrame, index: Cells, k: int, id: str, vector: str, score: str = "distance",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, ref id, score, rank): the ``k`` nearest rows of the index to each query, exactly."""
    if not index.rows:
        return _nothing(_asked(queries, id, vector), index, id, score)
    asked, _, found, second = visited(queries, index, k, id, vector, block_rows)
    more = _best_in(asked, second, index, k, id, vector, "_score", block_rows)
    return _ranked(found.unionByName(more).withColumnRenamed("_score", score), index, k, id, score)


def search_probed(
    queries: DataFrame, index: Cells, k: int, id: str, vector: str, probes: int, score: str = "distance",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like ``search``, but only in the ``probes`` closest cells, and as many more as hold ``k`` rows."""
    asked = _asked(queries, id, vector)
    if not index.rows:
        return _nothing(asked, index, id, score)
    enough, sizes = _closest_with(k, index.sizes), index.sizes

    def choose(gaps: np.ndarray) -> np.ndarray:
        place = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1, kind="stable")
        return ((place < probes) & (sizes > 0)) | enough(gaps)

    asked = stage(asked, "asked")
    looks = stage(_looks(asked, index, id, choose, []), "looks")
    return _ranked(_best_in(asked, looks, index, k, id, vector, score, block_rows), index, k, id, score)


def learn_probes(
    queries: DataFrame, index: Cells, k: int, id: str, vector: str, recall: float = 0.95,
    sample_queries: int = SAMPLE_QUERIES, seed: int = 42,
) -> int:
    """The fewest cells in which a sample of queries finds ``recall`` of its exact neighbours."""
    sample = stage(_asked(queries, id, vector).orderBy(order_hash(id, seed), id).limit(sample_queries), "probe-sample")
    if not index.rows:
        return 0
    exact = search(sample, index, k, id, vector).select(F.col(id).alias("_q"), F.col(index.id).alias("_r"))
    homes = index.members.select(F.col(index.id).alias("_r"), F.col("cell").alias("_home"))
    wanted = exact.join(homes, "_r").join(sample.withColumnRenamed(id, "_q"), "_q").select("_q", vector, "_home")
    centres = queries.sparkSession.sparkContext.broadcast(index.centres)

    def place(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        """How many cells are closer to the query than the neighbour's."""
        gaps = _distances(matrix, centres.value)
        own = batch.column(2).to_numpy()
        closer = (gaps < gaps[np.arange(len(own)), own][:, None]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(closer, pa.int32())], ["closer"])

    counts = _batches(wanted, 1, index.centres.shape[1], place, "closer int").groupBy("closer").count().collect()
    found, all_found = 0, sum(r["count"] for r in counts)
    for closer, n in sorted((r["closer"], r["count"]) for r in counts):
        found += n
        if found >= recall * all_found:
            return closer + 1
    return len(index.centres)


def kernel_mass(
    queries: DataFrame, refs: DataFrame, index: Cells, id: str, group: str, vector: str, sigma: float = 1.0,
    tolerance: float = 1e-9, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, group, mass, n, error): Gaussian kernel sums over each group, right within ``error``.

    ``refs`` (ref id, group) names the group of each row of the index. The distances of a
    query to a cell lie between two bounds, and so do its kernel values. Where these differ
    by at most twice the tolerance, every row of the cell counts as their middle;
    the other cells are summed exactly. ``error`` is at most ``tolerance`` times ``n``.
    """
    asked = stage(_asked(queries, id, vector), "asked")
    kinds = (asked.schema[id], refs.schema[group])
    out = StructType([
        *kinds, StructField("mass", DoubleType()), StructField("n", LongType()),
    ])
    if not index.rows:
        return queries.sparkSession.createDataFrame([], out.add("error", DoubleType()))
    named = index.members.join(refs.select(index.id, group), index.id)
    members = stage(named.select(index.id, index.vector, group, "cell"), "grouped-members")
    centres = queries.sparkSession.sparkContext.broadcast(index.centres)
    least, most, sizes = index.least, index.most, index.sizes

    def bounds(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        gaps = _distances(matrix, centres.value)
        low, high = np.zeros(gaps.shape), np.full(gaps.shape, np.inf)
        for p in range(least.shape[1]):
            d = gaps[:, p, None]
            slack = SLACK * (1.0 + d)
            np.maximum(low, np.maximum(d - most[None, :, p], least[None, :, p] - d) - slack, out=low)
            np.minimum(high, d + most[None, :, p] + slack, out=high)
        upper, lower = np.exp(-0.5 * (low / sigma) ** 2), np.exp(-0.5 * (high / sigma) ** 2)
        row, cell = np.nonzero(np.broadcast_to(sizes > 0, gaps.shape))
        half = (upper - lower)[row, cell] / 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(cell, pa.int32()),
             pa.array((upper + lower)[row, cell] / 2), pa.array(half), pa.array(half <= tolerance)],
            [id, "cell", "middle", "half", "far"],
        )

    kind = kinds[0].dataType.simpleString()
    schema = f"`{id}` {kind}, cell int, middle double, half double, far boolean"
    looks = stage(_batches(asked, 1, index.centres.shape[1], bounds, schema), "kernel-looks")
    counts = members.groupBy("cell", group).agg(F.count("*").alias("n"))
    far = looks.filter("far").join(counts, "cell").select(
        id, group, (F.col("middle") * F.col("n")).alias("mass"), "n", (F.col("half") * F.col("n")).alias("error")
    )

    def keep(ids, scores, table):
        return _keep_kernel_mass(sigma, ids, scores, table)

    work = _worker(keep, "euclidean", out, index.id, index.centres.shape[1])
    near = _met(
        asked, looks.filter("NOT far").select(id, "cell"), index, members, id, vector, work, out, block_rows
    ).withColumn("error", F.lit(0.0))
    return far.unionByName(near).groupBy(id, group).agg(
        F.sum("mass").alias("mass"), F.sum("n").alias("n"), F.sum("error").alias("error")
    )
