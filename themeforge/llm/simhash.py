"""SimHash near duplicates by meet-in-the-middle ball hashing.

The fingerprint of a text has a bit set where more than half of its shingles' XXH64
values have it set. Two fingerprints are linked at ``radius`` 3 or fewer differing bits.

Links are found without comparing all pairs. The 64 bits are cut into three blocks. Two
different fingerprints within radius 3 differ in at least one block; without that block
at most two differing bits remain, so the two meet in a value at most one bit away from
both. Every distinct fingerprint therefore emits, for each block, its other bits and all
their variants within one bit (half of what remains), 131 rows. The rows are shuffled
on the variant; fingerprints that meet are verified against the true distance. Of a
bucket's verified links a spanning forest is kept, which loses no link between
components and is never larger than the bucket. A bucket of more than
``BUCKET_MEMBERS`` fingerprints is not compared pairwise: its members emit full balls of
radius one and two instead, whose meetings prove the distance by themselves.

Defined cases: null and empty texts have fingerprint zero and are linked like others;
fewer words than a shingle form one shingle; equal fingerprints share a component;
rows repeat as they come; a null id takes part, and counts last when the smallest id
of a component is sought; very long texts are read whole; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.llm.components import components
from themeforge.llm.frames import map_batches
from themeforge.session import stage

SEED = 42
RADIUS = 3
SHINGLE_WORDS = 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
SIXTHS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
BUCKET_MEMBERS = 4096
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    width = min(words, len(tokens))
    ends = ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, len(ends)
    bits = np.zeros(64, np.int64)
    for at in range(0, total, SHINGLES_AT_ONCE):
        part = zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE])
        values = np.array([digest(joined[s:e], SEED) for s, e in part], "<u8")
        flags = np.unpackbits(values.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        bits += flags.sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """(id, fp) of each row; ``fp`` holds the 64 bits as a signed long."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["id", "fp"]
            )

    kind = slim.schema["id"].dataType.simpleString()
    return map_batches(slim, work, f"id {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _variants(fp: Column) -> Column:
    """For each block left out, the other bits and their variants within one bit.

    Keys of different blocks may coincide; what meets is verified in any case.
    """
    out = []
    for first, last in BLOCKS:
        dropped = ((1 << (last - first)) - 1) << first
        kept = fp.bitwiseAND(F.lit(_signed(~dropped & (1 << 64) - 1)))
        flips = [0] + [1 << i for i in range(64) if not dropped >> i & 1]
        out.append(F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), kept.bitwiseXOR))
    return F.concat(*out)


def shared_blocks(fp: Column) -> Column:
    """Every three of six blocks of bits: fingerprints within radius 3 have one of these 20 in common.

    Less to write than ``_variants``, but a key of 31 bits is shared by chance where there
    are billions of fingerprints.
    """
    kept = [sum(((1 << (b - a)) - 1) << a for a, b in three) for three in combinations(SIXTHS, 3)]
    return F.transform(F.array(*[F.lit(_signed(mask)) for mask in kept]), fp.bitwiseAND)


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as index pairs."""
    left, queue = np.arange(len(values)), []
    kept: list[tuple[int, int]] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        near = np.bitwise_count(values[left] ^ values[i]) <= radius
        hit = left[near].tolist()
        kept.extend((i, j) for j in hit)
        queue.extend(hit)
        left = left[~near]
    return kept


def _meetings(distinct: DataFrame, most: int, keys: Callable[[Column], Column]) -> DataFrame:
    """(a, b): links inside buckets; for each member of an oversized bucket a row with a null b."""
    # Each row becomes 131 (or 20): spread over all tasks, however small the table is.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = distinct.repartition(parts, "fp").select(F.explode(keys(F.col("fp"))).alias("key"), "fp")
    dealt = emitted.repartition("key").sortWithinPartitions("key", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int | None]] = []
        current: int | None = None
        members: list[int] = []
        large = False

        def close() -> None:
            nonlocal members, large
            if len(members) > 1 and not large:
                v = np.unique(np.array(members, np.int64))
                found.extend((int(v[i]), int(v[j])) for i, j in forest(v.view(np.uint64)))
            members, large = [], False

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(fp):
                continue
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(fp)]))
            # a bucket of one row inside the batch meets nobody
            several = np.flatnonzero(np.diff(bounds) > 1).tolist()
            for i in sorted({0, len(bounds) - 2, *several}):
                a, b = int(bounds[i]), int(bounds[i + 1])
                if key[a] != current:
                    close()
                    current = int(key[a])
                if large:
                    found.extend((int(x), None) for x in fp[a:b])
                    continue
                members.extend(fp[a:b].tolist())
                if len(members) > most:
                    found.extend((x, None) for x in members)
                    members, large = [], True
            if len(found) > 50_000:
                yield _pairs(found)
                found.clear()
        close()
        if found:
            yield _pairs(found)

    return map_batches(dealt, work, "a long, b long")


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
        ["a", "b"],
    )


def _full_balls(members: DataFrame) -> DataFrame:
    """Links among fingerprints by whole balls, without comparing pairs.

    Those within one bit of a value are within two bits of each other, and those within
    two bits of it are within three of the former. So whoever meets at a value that has
    a member within one bit is linked to that member, and any link within radius 3 has
    such a meeting.
    """
    ones = [0] + [1 << i for i in range(64)]
    twos = [1 << i | 1 << j for i in range(64) for j in range(i)]

    def ball(flips: list[int], near: bool) -> DataFrame:
        values = F.array(*[F.lit(_signed(x)) for x in flips])
        return members.select(
            "fp", F.explode(values).alias("flip"), F.lit(near).alias("near")
        ).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp", "near")

    met = ball(ones, True).union(ball(twos, False))
    hubs = met.filter("near").groupBy("key").agg(F.min("fp").alias("b"))
    return met.join(hubs, "key").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def linked_fingerprints(
    distinct: DataFrame, bucket_members: int = BUCKET_MEMBERS, keys: Callable[[Column], Column] = _variants
) -> DataFrame:
    """(node, component) for every fingerprint that is linked to another one.

    ``keys`` gives the buckets of a fingerprint; any two within the radius must share one.
    """
    met = stage(_meetings(distinct, bucket_members, keys).distinct(), "meetings")
    links = met.filter("b IS NOT NULL")
    if met.filter("b IS NULL").limit(1).count():
        members = met.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
        links = links.union(_full_balls(members))
    return components(links)


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
    bucket_members: int = BUCKET_MEMBERS,
) -> DataFrame:
    """(id, fp, component_id) of each row; ``component_id`` is the smallest id it is linked to."""
    prints = stage(fingerprints(docs, id, text, words), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = linked_fingerprints(least.select("fp"), bucket_members)
    grouped = least.join(nodes, least["fp"] == nodes["node"]).select("fp", "component", "least")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = grouped.join(smallest, "component").select("fp", F.col("component_id").alias("_linked"))
    named = least.join(linked, "fp", "left").select(
        "fp", F.coalesce("_linked", "least").alias("component_id")
    )
    # Both sides come from files, so that a fingerprint with many rows can be split.
    return prints.join(stage(named, "components"), "fp").select(
        F.col("id").alias(id), "fp", "component_id"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: the one with the smallest id.

    Rows that repeat an id count as copies of each other; rows without an id all stay.
    """
    found = near_duplicates(docs, id, text)
    kept = found.filter(F.col(id) == F.col("component_id")).select(F.col(id).alias("kept"))
    # The row travels as one value, so that no column of it can clash.
    row = F.struct(*docs.columns).alias("row")
    held = docs.select(F.col(id).alias("key"), row).join(kept, F.col("key") == F.col("kept"), "left_semi")
    order = W.partitionBy("key").orderBy(F.col("row")[text], F.xxhash64("row"))
    first = held.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row.*")
    return first.union(docs.filter(F.col(id).isNull()))
