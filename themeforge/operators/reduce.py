"""Fewer dimensions: CUR factors of a sparse weight table, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from themeforge.functions.vectors import array_to_vector, vector_to_array

MAX_RANK = 1500


def hash_uniform(name: Column, seed: int, salt: str) -> Column:
    """A number in (0, 1) fixed by the seed and the name: 52 bits of an md5."""
    h = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), name.cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def weighted_draw(
    weights: DataFrame, name: str, r: int, seed: int = 42, salt: str = ""
) -> DataFrame:
    """(name, p, draw_key): ``r`` names without replacement, odds by squared weight.

    The r smallest of -ln(u) / p; each task keeps its own r candidates first.
    """
    sums = weights.groupBy(name).agg(F.sum(F.col("weight") * F.col("weight")).alias("sq"))
    sums = sums.filter(F.col("sq") > 0)
    total = sums.agg(F.sum("sq")).scalar()
    keyed = sums.select(name, (F.col("sq") / total).alias("p")).withColumn(
        "draw_key", -F.log(hash_uniform(F.col(name), seed, salt)) / F.col("p")
    )
    return keyed.orderBy("draw_key", name).limit(r)


@dataclass
class CurFactors:
    """C: (key, j, value); U: (i, j, value); R: (i, token, value); drawn columns and rows.

    ``intersection`` and ``core`` are W and U as arrays, r x r at most.
    """

    c: DataFrame
    u: DataFrame
    r: DataFrame
    columns: DataFrame
    rows: DataFrame
    rank: int
    intersection: np.ndarray
    core: np.ndarray


def core_matrix(w: np.ndarray, cutoff: float = 1e-6) -> np.ndarray:
    """Y (S+)^2 X^T of the intersection W = X S Y^T, small singular values set to zero."""
    x, s, yt = np.linalg.svd(w, full_matrices=False)
    inverse = np.where(s > cutoff, 1.0 / np.where(s > cutoff, s, 1.0), 0.0)
    return yt.T @ np.diag(inverse**2) @ x.T


def cur(
    weights: DataFrame, r: int, key: str = "doc_id", seed: int = 42, max_rank: int = MAX_RANK
) -> CurFactors:
    """CUR factors of a (key, token, weight) table with ``r`` drawn columns and rows.

    C and R are joins with the drawn names, scaled by 1 / sqrt(r p). Only the
    names (r each) and their r x r intersection visit the driver; ``max_rank`` bounds them.
    """
    if not 1 <= r <= max_rank:
        raise ValueError(f"r must lie between 1 and {max_rank}")
    spark = weights.sparkSession

    def drawn(name: str, salt: str, index: str) -> DataFrame:
        found = weighted_draw(weights, name, r, seed, salt).collect()
        schema = weights.select(name).schema.add(index, IntegerType()).add("p", DoubleType())
        return spark.createDataFrame([(row[name], i, row["p"]) for i, row in enumerate(found)], schema)

    columns, rows = drawn("token", "column", "j"), drawn(key, "row", "i")
    scale = F.sqrt(r * F.col("p"))
    # At most ``r`` <= 1,500 drawn names on the broadcast side.
    c = weights.join(F.broadcast(columns), "token").select(
        key, "j", (F.col("weight") / scale).alias("value")
    )
    rr = weights.join(F.broadcast(rows), key).select(
        "i", "token", (F.col("weight") / scale).alias("value")
    )
    cells = (
        weights.join(F.broadcast(columns.select("token", "j")), "token")
        .join(F.broadcast(rows.select(key, "i")), key)
        .select("i", "j", "weight")
        .toArrow()
    )
    w = np.zeros((rows.count(), columns.count()))
    w[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("weight").to_numpy()
    u = core_matrix(w)
    i, j = np.nonzero(u)
    entries = pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": u[i, j]})
    u_table = spark.createDataFrame(entries, "i int, j int, value double")
    return CurFactors(c, u_table, rr, columns, rows, r, w, u)


def reduced_vectors(factors: CurFactors, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, vector): each document's row of C as a dense array of length r."""
    r = factors.rank
    held = factors.c.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("j", "value"))).alias("e")
    )
    joined = docs.select(key).join(held, key, "left").withColumn(
        "e", F.coalesce(F.col("e"), F.array().cast("array<struct<j:int,value:double>>"))
    )
    # Fill the gaps between the stored positions, then the gap behind the last one.
    before = F.concat(F.array(F.lit(-1)), F.col("e.j"))
    runs = F.zip_with(
        F.col("e"), F.slice(before, F.lit(1), F.size("e")),
        lambda x, last: F.concat(
            F.array_repeat(F.lit(0.0), x["j"] - last - 1), F.array(x["value"])
        ),
    )
    last = F.coalesce(F.try_element_at(F.col("e"), F.lit(-1))["j"], F.lit(-1))
    tail = F.array_repeat(F.lit(0.0), F.lit(r - 1) - last)
    return joined.select(key, F.concat(F.flatten(runs), tail).alias("vector"))


def principal_components(
    vectors: DataFrame, key: str, vector: str, k: int = 2
) -> DataFrame:
    """(key, pc1..pck): centred projection; the largest loading of each component is positive."""
    packed = vectors.filter(F.col(vector).isNotNull()).select(
        key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v")
    )
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(packed)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    scores = model.transform(packed).select(key, vector_to_array("_pc").alias("_pc"))
    raw = scores.select(key, *[(F.col("_pc")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
    means = raw.agg(F.struct(*[F.avg(f"pc{i + 1}").alias(f"pc{i + 1}") for i in range(k)])).scalar()
    centred = raw.withColumn("_m", means)
    return centred.select(
        key, *[(F.col(f"pc{i + 1}") - F.col(f"_m.pc{i + 1}")).alias(f"pc{i + 1}") for i in range(k)]
    )
