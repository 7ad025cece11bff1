"""Fixed-row batches, resumption, progress, and a check for unreadable files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeforge.operators.ordering import group_positions, row_positions
from themeforge.session import ship_package
from themeforge.sources.tables import list_files


def assign_batch(df: DataFrame, key: str, rows: int = 1500) -> DataFrame:
    """Add ``batch_id``: consecutive disjoint batches of ``rows`` rows in key order.

    Rows keep their number, also where a key repeats.
    """
    placed = row_positions(df, [key], "_p")
    return placed.withColumn("batch_id", F.floor(F.col("_p") / rows).cast("long")).drop("_p")


def rebatch_files(
    df: DataFrame, key: str, file: str = "source_file", rows: int = 1500
) -> DataFrame:
    """Add ``batch_id`` within each source file; the remainder forms the file's last batch."""
    placed = group_positions(df, [file], [key], "_p")
    batch = F.floor(F.col("_p") / rows).cast("long")
    return placed.withColumn("batch_id", batch).drop("_p", "group_rows")


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``todo`` whose keys are not in ``done``."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def progress(df: DataFrame, done: Column, group: str | None = None) -> DataFrame:
    """(done, total, percent) per group, or overall."""
    grouped = df.groupBy(group) if group else df.groupBy()
    finished = F.sum(F.coalesce(done, F.lit(False)).cast("long"))
    return grouped.agg(
        finished.alias("done"), F.count("*").alias("total"),
        (100 * finished / F.count("*")).alias("percent"),
    )


def _open_footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for frame in frames:
        rows = []
        for uri in frame["path"]:
            try:
                system, path = fs.FileSystem.from_uri(uri)
                n = pq.read_metadata(path, filesystem=system).num_rows
                rows.append((uri, True, n, None))
            except Exception as error:  # an unreadable file is a result here
                rows.append((uri, False, None, type(error).__name__))
        out = pd.DataFrame(rows, columns=["path", "ok", "n_rows", "error"])
        out["n_rows"] = out["n_rows"].astype("Int64")
        yield out


def check_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """(path, ok, n_rows, error): which Parquet files below ``root`` can be opened. Deletes nothing."""
    ship_package(spark)
    spread = list_files(spark, root, glob).repartition("path")
    return spread.mapInPandas(_open_footers, "path string, ok boolean, n_rows long, error string")


def readable_paths(checked: DataFrame) -> list[str]:
    """Paths that passed, for a reader; the list of files is what a reader takes anyway."""
    return [r["path"] for r in checked.filter("ok").select("path").orderBy("path").collect()]
