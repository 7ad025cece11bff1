"""Near copies of texts: word-shingle sets whose Jaccard similarity is at least 0.8.

Candidates come from MinHash bands, links from the true similarity of the shingle sets.
A pair at the threshold shares none of the ``BANDS`` bands of ``BAND_ROWS`` minima with a
probability of (1 - 0.8 ** 4) ** 32 = 5e-8. With ``fingerprints``, texts whose SimHash
fingerprints link at three bits or fewer (``simhash``) are near copies too, and are joined
first; bands then look only for what the fingerprints left apart, since copies at 0.8 differ
in ten bits on average, and a ball of that radius holds too much to be written.

Texts with the same shingle set are one node. In a bucket, the values that share a band,
nodes are first compared with the bucket's smallest node, then with one drawn by hash,
each only while they are not in the same component, so a group of copies costs rows in
proportion to its size. The nodes of buckets that still hold different components are
joined by prefix filter, which is exact: shingles are ordered by the number of open nodes
that have them, two sets of n and m shingles that are alike share one of their first
n - 0.8 n + 1 (and m - 0.8 m + 1), and sizes and places in that order must leave room for
the required overlap. Texts that share a page frame or a licence header meet only in
frequent shingles, which come last, so they are no candidates.

Defined cases: words are cut at white space and lower-cased; fewer words than a shingle
form one shingle; null and empty texts are copies of each other. Rows are numbered, so
that rows which repeat an id, or have none, are rows like others; of a component the
row with the smallest id stays, null last, then the one with the smallest number. Very long
texts are compared whole; an empty table stays empty; columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.llm import simhash
from themeforge.llm.components import components
from themeforge.llm.frames import map_batches, text_parts
from themeforge.session import stage

SEED = 42
SHINGLE_WORDS = 5
BANDS = 32
BAND_ROWS = 4
#: Least similarity, as a fraction of integers: what is compared are counts.
LEAST = (4, 5)
SHINGLES_AT_ONCE = 512
#: Texts are taken up so many bytes at a time.
PART_BYTES = 1 << 20

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_FACTORS, _OFFSETS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted different XXH64 values of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends)))


def bands(values: np.ndarray) -> list[int]:
    """A signed key for each band of minima; none without shingles."""
    if not len(values):
        return []
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), SHINGLES_AT_ONCE):
        part = values[at : at + SHINGLES_AT_ONCE, None] * _FACTORS + _OFFSETS
        np.minimum(least, part.min(0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketches(numbered: DataFrame, words: int, fingerprints: bool) -> DataFrame:
    """(row, digest of the shingle set, its size n, bands, SimHash fp or null) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_parts(whole, 1, PART_BYTES)):
            found = [shingles(t.as_py(), words) for t in batch.column(1)]
            prints = [simhash.fingerprint(t.as_py()) if fingerprints else None for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([xxhash.xxh128_digest(v.tobytes()) for v in found], pa.binary()),
                    pa.array(list(map(len, found)), pa.int64()),
                    pa.array(list(map(bands, found)), pa.list_(pa.int64())),
                    pa.array(prints, pa.uint64()).view(pa.int64()),
                ],
                ["row", "digest", "n", "bands", "fp"],
            )

    schema = "row long, digest binary, n long, bands array<long>, fp long"
    return map_batches(numbered.select("row", "text"), work, schema)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_parts(whole, 1, PART_BYTES)):
            found = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return map_batches(texts, work, "node long, shingles array<long>")


def _alike(shared: Column, n: Column, m: Column) -> Column:
    """Whether ``shared`` of ``n`` and ``m`` shingles are at least ``LEAST`` of their union."""
    over, under = LEAST
    return shared * (over + under) >= (n + m) * over


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(_alike(shared, F.size("sa"), F.size("sb"))).select("a", "b")


def _in_order(pairs: DataFrame) -> DataFrame:
    """Different pairs that the sizes allow, smaller node in ``b``."""
    ends = pairs.filter(_alike(F.least("n", "m"), F.col("n"), F.col("m")))
    return ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_hub(members: DataFrame, order: Column) -> DataFrame:
    """Each member of a bucket with its first one by ``order``, if in another component."""
    hub = F.min(F.struct(order.alias("o"), "node", "n", "component"))
    hubs = stage(members.groupBy("key").agg(hub.alias("hub")), "hubs")
    met = members.join(hubs, "key").filter("component <> hub.component")
    return met.selectExpr("node AS a", "n", "hub.node AS b", "hub.n AS m")


def _by_prefix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of members in different components that a prefix filter does not exclude."""
    over, under = LEAST
    nodes = members.select("node", "n", "component").distinct()
    each = nodes.join(sets, "node").select("node", "n", "component", F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("df"))
    # Of n shingles the overlap with a set that is alike has ceil(0.8 n) at least.
    rare = F.col("n") - F.ceil(F.col("n") * over / under) + 1
    place = F.row_number().over(W.partitionBy("node").orderBy("df", "shingle"))
    first = each.join(counts, "shingle").withColumn("at", place).filter((F.col("at") <= rare) & (F.col("df") > 1))
    prefixes = stage(first.select("shingle", "node", "n", "component", "at"), "prefixes")
    other = prefixes.selectExpr("shingle", "node AS b", "n AS m", "component AS c", "at AS place")
    room = 1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
    met = prefixes.join(other, "shingle").filter(
        (F.col("node") > F.col("b")) & (F.col("component") != F.col("c"))
        & _alike(room, F.col("n"), F.col("m")) & _alike(F.least("n", "m"), F.col("n"), F.col("m"))
    )
    return met.selectExpr("node AS a", "n", "b", "m")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of (node, fp) whose fingerprints are equal or linked, one per row."""
    found = simhash.linked_fingerprints(prints.select("fp").distinct(), keys=simhash.shared_blocks)
    named = prints.join(found.withColumnsRenamed({"node": "fp", "component": "linked"}), "fp", "left")
    grouped = stage(named.select("node", F.coalesce("linked", "fp").alias("group")), "fingerprint-groups")
    hubs = stage(grouped.groupBy("group").agg(F.min("node").alias("b")), "fingerprint-hubs")
    return grouped.join(hubs, "group").filter("node <> b").select(F.col("node").alias("a"), "b")


def linked(
    nodes: DataFrame, texts: DataFrame, words: int = SHINGLE_WORDS, links: DataFrame | None = None
) -> DataFrame:
    """(node, component) of every node that has a near copy.

    ``nodes`` holds (node, n, bands) with different shingle sets, ``texts`` the (node, text).
    Nodes that the ``links`` (a, b) join are near copies without a comparison.
    """
    emitted = nodes.select(F.explode("bands").alias("key"), "node", "n")
    shared = emitted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = stage(emitted.join(stage(shared.select("key"), "buckets"), "key"), "met")
    found = sets = None
    if links is not None:
        links = stage(links, "near-links")
        found = stage(components(links), "near-components")
    for candidates in (
        lambda m: _with_hub(m, F.col("node")),
        lambda m: _with_hub(m, F.xxhash64("key", "node")),
        lambda m: _by_prefix(m, sets),
    ):
        if links is None:
            members = met.withColumn("component", F.col("node"))
        else:
            known = met.join(found, "node", "left").select(
                "key", "node", "n", F.coalesce("component", "node").alias("component")
            )
            apart = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
            open = stage(apart.filter("x < y").select("key"), "open")
            members = stage(known.join(open, "key"), "members")
        if sets is None:
            # Later rounds have fewer members, never others.
            sets = stage(_sets(texts.join(members.select("node").distinct(), "node", "left_semi"), words), "shingle-sets")
        new = _links(stage(_in_order(candidates(members)), "candidates"), sets)
        links = stage(new if links is None else links.union(new), "near-links")
        found = stage(components(links), "near-components")
    return found


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, fingerprints: bool = False
) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: the one with the smallest id.

    With ``fingerprints`` groups are joined by SimHash first, see ``fingerprint_links``.
    """
    # The row travels as one value, so that no column of it can clash.
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    held = stage(whole, "numbered")
    numbered = held.select("row", F.col("doc")[id].alias("id"), F.col("doc")[text].alias("text"))
    sketches = stage(_sketches(numbered, words, fingerprints), "sketches")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    keyed = sketches.join(numbered.select("row", "id"), "row")
    nodes = stage(
        keyed.groupBy("digest").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .select(F.col("first.row").alias("node"), "first", "n", "bands", "digest"),
        "nodes",
    )
    texts = numbered.select(F.col("row").alias("node"), "text")
    links = None
    if fingerprints:
        # Texts with the same shingle set may have several fingerprints: one counts repeats.
        prints = sketches.select("digest", "fp").distinct().join(nodes.select("digest", "node"), "digest")
        links = fingerprint_links(stage(prints.select("node", "fp"), "fingerprints"))
    group = nodes.join(linked(nodes, texts, words, links), "node", "left").select(
        F.coalesce("component", "node").alias("group"), "first"
    )
    kept = group.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return held.join(kept, "row", "left_semi").select("doc.*")
