"""Exact global positions and hash cuts without a single-task sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.session import reliable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
_PREFIX = 4  # hex digits of the hash that name one of 65,536 buckets


def row_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the zero-based position of each row in the total order of ``order``.

    A range sort spreads the rows over all tasks; the checkpoint fixes that
    layout, and only one row count per partition passes through a single task.
    Rows with equal keys follow each other in the order of a hash of the whole
    row, so repeated keys spread too, and every row gets one position.
    """
    rest = [c for c in df.columns if c not in order]
    tie = [F.xxhash64(*rest)] if rest else []
    fixed = reliable(df.orderBy(*order, *tie)).withColumn("_at", F.monotonically_increasing_id())
    place = F.shiftright("_at", _ROW_BITS)
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    located = fixed.withColumn("_part", place).withColumn("_row", within).drop("_at")
    sizes = located.groupBy("_part").agg(F.count("*").alias("_n"))
    running = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before")
    )
    # One row per shuffle partition: its size is bounded by configuration.
    return (
        located.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
        .drop("_part", "_row", "_before")
    )


def group_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the zero-based ``position`` of each row in its group and the group's ``group_rows``.

    Works for groups of any size: the position comes from the global order of
    (group, order), so no task ever holds a whole group.
    """
    placed = row_positions(df, [*group, *order], "_global")
    bounds = placed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(
        F.min("_global").alias("_first"), F.count("*").alias("group_rows")
    )
    # A null is a group like any other.
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return (
        placed.join(bounds, same)
        .withColumn(name, F.col("_global") - F.col("_first"))
        .drop("_global", "_first", *[f"_g_{g}" for g in group])
    )


def order_hash(key: Column | str, seed: int) -> Column:
    """The value rows are shuffled by: md5 of ``seed:key``."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def hash_cuts(
    df: DataFrame, key: Column | str, seed: int, ranks: Mapping[str, Column]
) -> dict[str, str]:
    """For each name in ``ranks``, the hash at that 1-based rank of the hash order.

    ``ranks`` gives each rank as an expression over the row count ``n``. Rows
    with ``order_hash(key) <= cut`` are then exactly the first ``rank`` rows, so
    a split is a comparison on each row and needs neither a sort nor a join.
    A bucket histogram finds where each rank falls, and only the rows of those
    buckets are ranked; one row per cut reaches the driver. Rows that repeat a key
    stay together: those at a cut all come before it.
    """
    hashed = df.select(order_hash(key, seed).alias("h"))
    bucket = F.substring("h", 1, _PREFIX)
    sizes = hashed.groupBy(bucket.alias("b")).agg(F.count("*").alias("m"))
    # At most 65,536 rows reach this window.
    upto = F.sum("m").over(W.orderBy("b"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = sizes.select("b", "m", upto.alias("upto"), F.sum("m").over(whole).alias("n"))
    wanted = F.array(
        *[F.struct(F.lit(name).alias("cut"), rank.cast("long").alias("k")) for name, rank in ranks.items()]
    )
    before = F.col("upto") - F.col("m")
    targets = (
        steps.withColumn("w", F.explode(wanted))
        .filter((F.col("w.k") > before) & (F.col("w.k") <= F.col("upto")))
        .select("b", "w.cut", (F.col("w.k") - before).alias("nth"))
        .collect()
    )
    cuts = dict.fromkeys(ranks, "")
    if not targets:
        return cuts
    # Each bucket holds about 1/65,536 of the rows.
    chosen = hashed.withColumn("b", bucket).filter(F.col("b").isin(*{t["b"] for t in targets}))
    placed = chosen.withColumn("nth", F.row_number().over(W.partitionBy("b").orderBy("h")))
    at = [(F.col("b") == t["b"]) & (F.col("nth") == t["nth"]) for t in targets]
    found = {(r["b"], r["nth"]): r["h"] for r in placed.filter(reduce(or_, at)).collect()}
    cuts.update({t["cut"]: found[t["b"], t["nth"]] for t in targets})
    return cuts


def hash_cuts_by_seed(
    df: DataFrame, key: Column | str, seeds: Sequence[int], rank: Column
) -> list[str]:
    """For each seed the hash at the 1-based ``rank`` of its order, found for all seeds in one pass.

    ``rank`` is an expression over the row count ``n``. See ``hash_cuts``: the bucket
    histogram has at most 65,536 rows a seed, and one row a seed reaches the driver.
    """
    hashes = F.array(*[order_hash(key, seed) for seed in seeds])
    hashed = df.select(F.posexplode(hashes).alias("run", "h"))
    bucket = F.substring("h", 1, _PREFIX)
    sizes = hashed.groupBy("run", bucket.alias("b")).agg(F.count("*").alias("m"))
    own = W.partitionBy("run")
    steps = sizes.select(
        "run", "b", "m", F.sum("m").over(own.orderBy("b")).alias("upto"), F.sum("m").over(own).alias("n")
    ).withColumn("k", rank.cast("long"))
    before = F.col("upto") - F.col("m")
    targets = steps.filter((F.col("k") > before) & (F.col("k") <= F.col("upto"))).select(
        "run", "b", (F.col("k") - before).alias("nth")
    )
    # One target a seed; each names a bucket of about 1/65,536 of the rows.
    chosen = hashed.withColumn("b", bucket).join(F.broadcast(targets), ["run", "b"])
    placed = chosen.withColumn("place", F.row_number().over(W.partitionBy("run").orderBy("h")))
    found = {r["run"]: r["h"] for r in placed.filter("place = nth").select("run", "h").collect()}
    return [found.get(i, "") for i in range(len(seeds))]


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based ``rank``.

    Spark trims every input partition to ``k`` rows per group before the
    shuffle, so a group that holds a large share of the rows stays small.
    """
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
