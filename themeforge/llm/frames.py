"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeforge.session import ship_package


def broadcast_value(spark: SparkSession, value) -> Broadcast:
    """Ship the package and a value of proven size to the Python workers."""
    ship_package(spark)
    context: SparkContext = spark.sparkContext
    return context.broadcast(value)


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def slices(texts: list[str | None], most_chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``most_chars`` characters together.

    A longer text forms a range of its own.
    """
    start = chars = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and chars + n > most_chars:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def text_parts(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text together, before they become Python strings.

    A longer text forms a part of its own.
    """
    lens = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lens.tolist()):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lens):
        yield batch.slice(start)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of the schema's types from plain columns."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def join_by_share(rows: DataFrame, table: DataFrame, on: list[str], share: str, total: int) -> DataFrame:
    """Left join of ``rows`` with a table of unique keys, where a few keys may have most rows.

    ``share`` is the column of ``table`` with the number of rows that have its key, and
    ``total`` is at least the number of rows. Keys with more than a thousandth of the rows
    are fewer than a thousand, so they are broadcast; the rows of the others are shuffled.
    """
    often = F.col(share) * 1000 > total
    hot, others = F.broadcast(table.filter(often).drop(share)), table.filter(~often).drop(share)
    spread = rows.join(hot.select(on), on, "left_anti").join(others, on, "left")
    return rows.join(hot, on).unionByName(spread)
