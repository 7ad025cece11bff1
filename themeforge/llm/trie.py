"""The trie of all conversation prefixes, by truncation peeling.

A conversation is a sequence of turns. Every different sequence of its first d turns is a
node of depth d, from the textless root. The trie is found from its deepest level up:

1. Conversations with the same sequence end in the same node; they become one *tip* with
   its members, and tips are all that is peeled.
2. At depth d the nodes that survived from below meet the tips that end there and are
   grouped by their sequence. A group is a node, and its sums (members, children, leaves,
   tokens saved below) are those of what was grouped: nodes are aggregated as they are
   discovered.
3. The last turn is stripped off each node, and what is left goes on to depth d - 1.

Sequences are compared by 128-bit keys of their prefixes (two different ones agree with a
probability of 2^-128). A row carries the keys of all its prefixes, so that stripping a
turn is cutting an array. Below the depth where any two tips part, nothing is left to
group: such tails are stripped in one step (``_meeting_depth`` looks at every ``STRIDE``-th
depth). Each further depth is one written table, so the rounds are as many as the depth at
which conversations still meet, and a lost executor costs the current one.

Groups of any size are summed before they are shuffled. The list of a node's ended
conversations is sorted over all tasks and joined there into pieces; only the pieces of a
node come together, as a stream that is hashed. Parents are looked up by their key; those
with more than a thousandth of all nodes as children (at most a thousand) are broadcast.
One conversation's turns are one row, of 24 bytes a turn.

Defined cases: rows without a conversation id take no part; null roles and texts are empty
ones; turns are ordered by number (null first), equal numbers by role and then by a digest of
the text, so repeated rows are turns of their own; a conversation without turns belongs to
the root only; very long texts are hashed and counted whole; other columns, whatever their
names, are not read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import join_by_share, map_batches
from themeforge.session import fresh_path, stage

#: Every so many depths is looked at for tips that are still together.
STRIDE = 4
#: Ids joined into one piece before they are hashed in a stream.
PIECE_IDS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, said): the turns of each conversation in order, each a key of two numbers and its words."""
    rows = conversations.filter(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    one = F.struct(
        "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "text", "role").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )
    said = F.transform(
        F.sort_array(F.collect_list(one)), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["words"].alias("words"))
    )
    return rows.groupBy("conv").agg(said.alias("said"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over 64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_keys(a: np.ndarray, b: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all prefixes of the sequences that lie one after another in ``a`` and ``b``.

    The key of a prefix is the exclusive or of its turns' keys, each mixed with its depth.
    """
    depth = (np.arange(len(a)) - np.repeat(starts, lens) + 1).astype(np.uint64)
    out = []
    for turn, odd in ((a, 0x9E3779B97F4A7C15), (b, 0xD1B54A32D192ED03)):
        mixed = np.bitwise_xor.accumulate(_mix(turn.view(np.uint64) ^ _mix(depth * np.uint64(odd))))
        before = np.where(starts > 0, mixed[np.maximum(starts, 1) - 1], 0) if len(mixed) else mixed
        out.append((mixed ^ np.repeat(before, lens)).view(np.int64))
    return out[0], out[1]


def _paths(seqs: DataFrame) -> DataFrame:
    """(conv, n, a, b, upto): the keys of all prefixes, and the words up to each turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(1)
            lens = said.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = said.flatten()
            a, b, words = (
                np.array(flat.field(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in range(3)
            )
            ends = np.cumsum(lens)
            starts = ends - lens
            a, b = prefix_keys(a, b, starts, lens)
            total = np.concatenate(([0], np.cumsum(words)))
            upto = total[1:] - np.repeat(total[starts], lens)
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (a, b, upto)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lens), *lists], ["conv", "n", "a", "b", "upto"]
            )

    schema = "conv bigint, n bigint, a array<bigint>, b array<bigint>, upto array<bigint>"
    return map_batches(seqs.select("conv", "said"), work, schema)


def _at(keys: str, depth: Column | int) -> Column:
    """The entry of a prefix array at a depth; 0 at the root."""
    return F.coalesce(F.get(keys, F.lit(depth).cast("int") - 1), F.lit(0).cast("bigint"))


# ---- tips ----------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (n, a, b, conv) with one key, as pieces of at most ``PIECE_IDS`` ids."""
    for batch in batches:
        n, a, b, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(n):
            continue
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(n))
        cuts = np.concatenate([np.arange(s, s + k, PIECE_IDS) for s, k in zip(starts, sizes)])
        ends = np.append(cuts[1:], len(n))
        listed = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(cuts, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[cuts]) for x in (n, a, b, conv)] + [pa.array(ends - cuts), pa.array(listed, pa.string())],
            ["n", "a", "b", "conv", "members", "listed"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of a key as one row with the hash of their joined ids."""
    key = state = None
    first = members = 0

    def row(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["conv", "n", "members", "ends"]
        )

    for batch in batches:
        done = []
        for n, a, b, conv, count, listed in zip(*(c.to_pylist() for c in batch.columns)):
            if (n, a, b) == key:
                state.update(b"," + listed.encode())
                members += count
                continue
            if key is not None:
                done.append((first, key[0], members, state.hexdigest()))
            key, first, members, state = (n, a, b), conv, count, hashlib.sha256(listed.encode())
        if done:
            yield row(done)
    if key is not None:
        yield row([(first, key[0], members, state.hexdigest())])


def tips(paths: DataFrame) -> DataFrame:
    """(conv, n, members, ends, a, b, upto): one row per sequence that a conversation has whole."""
    order = ["n", "a", "b", "conv"]
    slim = paths.select("n", _at("a", F.col("n")).alias("a"), _at("b", F.col("n")).alias("b"), "conv")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = map_batches(spread, _pieces, "n bigint, a bigint, b bigint, conv bigint, members bigint, listed string")
    met = pieces.repartition("n", "a", "b").sortWithinPartitions(*order)
    found = map_batches(met, _hashed, "conv bigint, n bigint, members bigint, ends string")
    return found.join(paths.drop("n"), "conv")


def _meeting_depth(found: DataFrame) -> int:
    """A depth beyond which no two tips have a node in common, a multiple of ``STRIDE``."""
    last = F.floor((F.col("n") - 1) / STRIDE).cast("int")
    stems = found.filter("n > 0").select(
        F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
            k.alias("k"), F.coalesce(F.get("a", k * STRIDE - 1), F.lit(0).cast("bigint")).alias("a"),
            F.coalesce(F.get("b", k * STRIDE - 1), F.lit(0).cast("bigint")).alias("b"),
        ))).alias("stem")
    ).select("stem.*")
    shared = stems.groupBy("k", "a", "b").count().filter("count > 1").agg(F.max("k").alias("k")).first()["k"]
    return 0 if shared is None else (shared + 1) * STRIDE


# ---- peeling -------------------------------------------------------------------------------

_SUMS = ("n_convs", "n_children", "n_leaves", "saved")


def _tails(found: DataFrame, depth: int) -> DataFrame:
    """The nodes below ``depth``, where every tip is alone."""
    shift = lambda keys: F.concat(F.array(F.lit(0).cast("bigint")), F.slice(keys, 1, F.col("n").cast("int") - 1))
    turns = F.arrays_zip(
        F.col("a"), F.col("b"), shift("a").alias("pa"), shift("b").alias("pb"), shift("upto").alias("before"),
        F.sequence(F.lit(1), F.col("n").cast("int")).alias("depth"),
    )
    each = found.filter(F.col("n") > depth).select(
        "conv", "n", "members", "ends", F.element_at("upto", -1).alias("all"),
        F.explode(F.slice(turns, depth + 1, F.col("n").cast("int"))).alias("t"),
    )
    end = F.col("t.depth") == F.col("n")
    return each.select(
        F.col("t.depth").alias("depth"), "t.a", "t.b", "t.pa", "t.pb", "conv", F.col("members").alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("members") - 1) * (F.col("all") - F.col("t.before"))).alias("saved"),
        F.when(end, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends"),
    )


def _cut(depth: int) -> list[Column]:
    """Prefix arrays without the turns after ``depth``."""
    return [F.slice(c, 1, depth).alias(c) for c in ("a", "b", "upto")]


def _ended(found: DataFrame, depth: int) -> DataFrame:
    """Tips of one depth as parts of its nodes."""
    zero = F.lit(0).cast("bigint")
    return found.filter(F.col("n") == depth).select(
        "conv", F.col("members").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"),
        zero.alias("saved"), "ends", *_cut(depth),
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of the next depth as parts of their parents."""
    return nodes.select(
        "conv", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved",
        F.lit(None).cast("string").alias("ends"), *_cut(depth),
    )


def _nodes(parts: DataFrame, depth: int) -> DataFrame:
    """Parts of one depth, grouped by their sequence."""
    keyed = parts.withColumns({"ka": _at("a", depth), "kb": _at("b", depth)})
    grouped = keyed.groupBy("ka", "kb").agg(
        F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in _SUMS], F.max("ends").alias("ends"),
        *[F.first(c).alias(c) for c in ("a", "b", "upto")],
    )
    words = _at("upto", depth) - _at("upto", depth - 1)
    return grouped.withColumns({
        "n_leaves": F.greatest("n_leaves", F.lit(1).cast("bigint")),
        "saved": F.col("saved") + (F.col("n_convs") - 1) * words,
        "ends": F.coalesce("ends", F.lit(NOTHING)),
        "pa": _at("a", depth - 1), "pb": _at("b", depth - 1),
    })


def _lone(found: DataFrame, depth: int) -> DataFrame:
    """Tips that reach below ``depth``, as parts of the nodes there."""
    return found.filter(F.col("n") > depth).select(
        "conv", F.col("members").alias("n_convs"), F.lit(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("members") - 1) * (F.element_at("upto", -1) - _at("upto", depth))).alias("saved"),
        F.lit(None).cast("string").alias("ends"), *_cut(depth),
    )


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``seqs`` has (conv, said) as ``sequences`` gives them, one row per conversation.
    """
    spark = seqs.sparkSession
    found = stage(tips(stage(_paths(seqs), "trie-paths")), "trie-tips")
    depth = _meeting_depth(found)
    tails = stage(_tails(found, depth), "trie-tails")

    # The levels are folders of one table; each is read to find the next.
    base = fresh_path(spark, "trie-nodes")
    above = _lone(found, depth)
    for d in range(depth, -1, -1):
        level = _nodes(above.unionByName(_ended(found, d)), d)
        path = f"{base}/depth={d}"
        level.write.parquet(path)
        above = _stripped(spark.read.schema(level.schema).parquet(path), d - 1) if d else above
    columns = ["depth", "a", "b", "pa", "pb", "conv", *_SUMS, "ends"]
    upper = spark.read.schema(f"{_ddl(level)}, depth int").parquet(base).drop("a", "b")
    nodes = upper.withColumnsRenamed({"ka": "a", "kb": "b"}).select(columns).unionByName(tails.select(columns))

    total = nodes.count()
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
        F.col("conv").alias("parent"), "n_children",
    ).filter("n_children > 0")
    linked = join_by_share(nodes, parents, ["depth", "pa", "pb"], "n_children", total)
    return linked.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"),
        F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)


def with_heads(seqs: DataFrame, every: int = 20) -> DataFrame:
    """Each conversation with its first turns taken from the one that begins its block of ids.

    Conversation c has the first h turns of conversation c - c % every, h being the CRC-32 of
    c's digits modulo 4, and then its own turns after its first h.
    """
    own = stage(seqs, "trie-said")
    heads = own.filter(F.col("conv") % every == 0).select(
        F.col("conv").alias("base"), F.slice("said", 1, 3).alias("head")
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    begun = own.withColumns({"base": F.col("conv") - F.col("conv") % every, "h": h}).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("said", 1, 0))
    kept = F.slice("said", F.col("h") + 1, F.greatest(F.size("said"), F.lit(1)))
    return begun.select("conv", F.concat(taken, kept).alias("said"))
