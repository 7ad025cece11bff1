"""CUR factors batch by batch, and how well drawn columns and rows rebuild the whole.

Every batch, ``BATCH_ROWS`` documents by default, draws its own columns and rows with odds by
their squared weight in the batch and has its own core. Its weights come together in one
task, which the number of documents bounds; batches are independent, so finished ones can be
left out when the work is resumed.

``rebuilding_errors`` never forms the product of the factors. With C the drawn columns, R
the drawn rows and the best core between them, the part of the weights that they rebuild has
the squared norm tr(M' G_C+ M G_R+), where G_C = C'C, G_R = RR' and M = C'AR' have one row and
column per draw. Draws of a smaller rank are the first of a larger one, so one set of sums
serves all ranks.

Weights without a batch, a key or a token take no part. A batch of fewer columns or rows
than asked for draws all it has; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from themeforge.operators.ordering import group_positions
from themeforge.operators.reduce import MAX_RANK, core_matrix, weighted_draw
from themeforge.session import ship_package, stage

BATCH_ROWS = 1500


def batches_of(docs: DataFrame, key: str, group: str, rows: int = BATCH_ROWS) -> DataFrame:
    """(key, batch): each group's documents in batches of ``rows`` by key, named ``group-number``."""
    placed = group_positions(docs.select(group, key), [group], [key], "_p")
    number = F.floor(F.col("_p") / rows).cast("string")
    return placed.select(key, F.concat_ws("-", F.col(group).cast("string"), number).alias("batch"))


def _uniform(name, seed: int, salt: str) -> float:
    """The number in (0, 1) that ``hash_uniform`` gives a name."""
    return (int(hashlib.md5(f"{seed}:{salt}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / float(16**13)


def _draw(names: list, squares: np.ndarray, r: int, seed: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``r`` drawn names in the order of their draw, and their odds."""
    p = squares / squares.sum()
    keyed = sorted((-math.log(_uniform(n, seed, salt)) / q, n, i) for i, (n, q) in enumerate(zip(names, p)) if q > 0)
    drawn = np.array([i for _, _, i in keyed[:r]], np.int64)
    return drawn, p[drawn]


def cur_by_batch(
    weights: DataFrame, r: int, batch: str = "batch", key: str = "doc_id", seed: int = 42,
    max_rank: int = MAX_RANK, done: DataFrame | None = None,
) -> DataFrame:
    """(batch, part, key, token, i, j, value): the factors of each batch of (batch, key, token, weight).

    Parts: ``column`` (token, j) and ``row`` (key, i) with their odds, ``c`` (key, j), ``r`` (i,
    token), ``u`` (i, j). ``done`` holds batches to leave out. C and R are scaled by 1 / sqrt(r p).
    """
    if not 1 <= r <= max_rank:
        raise ValueError(f"r must lie between 1 and {max_rank}")
    ship_package(weights.sparkSession)
    slim = weights.select(batch, key, "token", "weight").dropna()
    if done is not None:
        slim = slim.join(done.select(batch).distinct(), batch, "left_anti")
    kinds = {c: slim.schema[c].dataType.simpleString() for c in (batch, key)}
    names = [batch, "part", key, "token", "i", "j", "value"]

    def factors(table: pa.Table) -> pa.Table:
        keys = table.column(key).combine_chunks().dictionary_encode()
        tokens = table.column("token").combine_chunks().dictionary_encode()
        row, col = keys.indices.to_numpy(), tokens.indices.to_numpy()
        weight = table.column("weight").to_numpy()
        columns, pc = _draw(tokens.dictionary.to_pylist(), np.bincount(col, weight**2), r, seed, "column")
        rows, pr = _draw(keys.dictionary.to_pylist(), np.bincount(row, weight**2), r, seed, "row")
        of_col, of_row = np.full(len(tokens.dictionary), -1), np.full(len(keys.dictionary), -1)
        of_col[columns], of_row[rows] = np.arange(len(columns)), np.arange(len(rows))
        j, i = of_col[col], of_row[row]
        w = np.zeros((len(rows), len(columns)))
        both = (i >= 0) & (j >= 0)
        w[i[both], j[both]] = weight[both]
        u = core_matrix(w)
        ui, uj = np.nonzero(u)
        in_c, in_r = np.flatnonzero(j >= 0), np.flatnonzero(i >= 0)
        parts = [
            ("column", None, columns, None, np.arange(len(columns)), pc),
            ("row", rows, None, np.arange(len(rows)), None, pr),
            ("c", row[in_c], None, None, j[in_c], weight[in_c] / np.sqrt(r * pc[j[in_c]])),
            ("r", None, col[in_r], i[in_r], None, weight[in_r] / np.sqrt(r * pr[i[in_r]])),
            ("u", None, None, ui, uj, u[ui, uj]),
        ]

        def column(values, n: int, kind, dictionary=None):
            if values is None:
                return pa.nulls(n, kind)
            return dictionary.take(pa.array(values)) if dictionary is not None else pa.array(values, kind)

        out = []
        for part, k, t, at, to, value in parts:
            n = len(value)
            out.append(pa.table([
                table.column(batch).combine_chunks().take(pa.array(np.zeros(n, np.int64))), pa.array([part] * n, pa.string()),
                column(k, n, keys.dictionary.type, keys.dictionary), column(t, n, pa.string(), tokens.dictionary),
                column(at, n, pa.int32()), column(to, n, pa.int32()), pa.array(value, pa.float64()),
            ], names=names))
        return pa.concat_tables(out)

    schema = f"`{batch}` {kinds[batch]}, part string, `{key}` {kinds[key]}, token string, i int, j int, value double"
    return slim.groupBy(batch).applyInArrow(factors, schema)


def batch_vectors(factors: DataFrame, docs: DataFrame, r: int, batch: str = "batch", key: str = "doc_id") -> DataFrame:
    """(batch, key, vector): the row of C of each document of (batch, key), ``r`` numbers long."""
    held = factors.filter("part = 'c'").groupBy(batch, key).agg(
        F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("_e")
    )
    entries = F.coalesce("_e", F.create_map().cast("map<int,double>"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda j: F.coalesce(F.try_element_at(entries, j), F.lit(0.0)))
    return docs.select(batch, key).join(held, [batch, key], "left").select(batch, key, vector.alias("vector"))


def resume_cur(weights: DataFrame, r: int, path: str, batch: str = "batch", key: str = "doc_id", **options) -> DataFrame:
    """Append the factors of batches that ``path`` does not hold yet, and read them all."""
    spark = weights.sparkSession
    schema = cur_by_batch(weights.filter("false"), r, batch, key, **options).schema
    try:
        done = spark.read.schema(schema).parquet(path).select(batch).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    cur_by_batch(weights, r, batch, key, done=done, **options).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def rebuilding_errors(
    weights: DataFrame, ranks: Sequence[int], key: str = "doc_id", seed: int = 42, max_rank: int = MAX_RANK
) -> DataFrame:
    """(rank, error): the share of the Frobenius norm that the drawn columns and rows leave out.

    Draws are those of ``cur``; between them stands the core that rebuilds most.
    """
    most = max(ranks)
    if not 1 <= min(ranks) <= most <= max_rank:
        raise ValueError(f"ranks must lie between 1 and {max_rank}")
    spark = weights.sparkSession
    a = stage(weights.select(key, "token", "weight").dropna(), "cur-weights")

    def drawn(name: str, salt: str, index: str) -> DataFrame:
        found = weighted_draw(a, name, most, seed, salt).collect()
        schema = a.select(name).schema.add(index, IntegerType())
        # At most ``max_rank`` names.
        return F.broadcast(spark.createDataFrame([(row[name], n) for n, row in enumerate(found)], schema))

    c = stage(a.join(drawn("token", "column", "j"), "token").select(key, "j", "weight"), "cur-c")
    r = stage(a.join(drawn(key, "row", "i"), key).select("i", "token", "weight"), "cur-r")

    def gram(part: DataFrame, on: str, index: str) -> np.ndarray:
        other = part.select(on, F.col(index).alias("k"), F.col("weight").alias("v"))
        return _square(part.join(other, on).groupBy(index, "k").agg(F.sum(F.col("weight") * F.col("v")).alias("x")), most)

    # A R' has one row per document that shares a token with a drawn one.
    seen = a.join(r.select("token", "i", F.col("weight").alias("v")), "token").groupBy(key, "i").agg(
        F.sum(F.col("weight") * F.col("v")).alias("v")
    )
    middle = c.join(seen, key).groupBy("j", "i").agg(F.sum(F.col("weight") * F.col("v")).alias("x"))
    g_c, g_r, m = gram(c, key, "j"), gram(r, "token", "i"), _square(middle, most)
    norm = a.agg(F.sum(F.col("weight") * F.col("weight")).alias("x")).first()["x"]
    out = []
    for n in ranks:
        inner = np.linalg.pinv(g_c[:n, :n], rcond=1e-10, hermitian=True) @ m[:n, :n]
        held = float(np.sum(inner * (m[:n, :n] @ np.linalg.pinv(g_r[:n, :n], rcond=1e-10, hermitian=True))))
        share = max(0.0, 1.0 - held / norm) if norm else None
        out.append((n, None if share is None else math.sqrt(share)))
    return spark.createDataFrame(out, "rank int, error double")


def _square(cells: DataFrame, n: int) -> np.ndarray:
    """(row, column, x) with numbers below ``n`` as a matrix."""
    table = cells.toArrow()
    out = np.zeros((n, n))
    out[table.column(0).to_numpy(), table.column(1).to_numpy()] = table.column(2).to_numpy()
    return out
