r"""Chat formatting of reply trees.

Nodes reply to a parent. Pointer doubling with self-joins enumerates the nodes on the
path from every leaf to its root in a number of rounds that grows with the logarithm of
the depth; branches are ranked by the sum of their nodes' scores; each chosen path is
formatted as one conversation.

A turn is ``<|role|>text<|end|>``. Inside roles and texts every ``\``, ``<`` and ``|``
gets a ``\`` before it, so no text can contain a mark of the template, and removing it
gives the text back. The loss mask covers the texts of the assistant.

Defined cases: a null text or role is empty; a node whose parent is missing or null is a
root; a conversation of one turn is a path of one node; several rows of one turn follow
each other by role and text; repeated rows are turns of their own; rows without a
conversation id form one conversation; ties between branches go to the smaller leaf.
A cycle has no leaf that leads to a root and is left out. Very long texts are formatted
whole; an empty table has no conversations; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.llm.frames import map_batches
from themeforge.session import stage

LEARNED_ROLE = "assistant"
_ESCAPES = str.maketrans({"\\": "\\\\", "<": "\\<", "|": "\\|"})


def escape(text: str) -> str:
    return text.translate(_ESCAPES)


def unescape(text: str) -> str:
    """What ``escape`` was given: after a backslash the next character stands for itself."""
    if "\\" not in text:
        return text
    parts = text.split("\\")
    out, literal = [parts[0]], False
    for part in parts[1:]:
        if literal:  # the previous piece was an escaped backslash
            out.append(part)
            literal = False
        elif part == "":
            out.append("\\")
            literal = True
        else:
            out.append(part)
    return "".join(out)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the ranges of it that the loss covers."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role)}|>", escape(text)
        if role == LEARNED_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}<|end|>")
        at += len(out[-1])
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<|", at):
            raise ValueError(f"no turn at {at}")
        close = formatted.index("|>", at + 2)
        # an escaped "|" may stand before ">"; the mark's is not escaped
        while _escaped(formatted, close):
            close = formatted.index("|>", close + 1)
        end = formatted.index("<|end|>", close)
        turns.append((unescape(formatted[at + 2 : close]), unescape(formatted[close + 2 : end])))
        at = end + len("<|end|>")
    return turns


def _escaped(text: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before a position."""
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


# ---- trees ---------------------------------------------------------------------------------


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth): every node on the way from each leaf to its root.

    ``nodes`` has (tree, node, parent), node ids unique within their tree. Round i knows
    every node's ancestor at distance 2**i; the distances of a path are then put together
    from powers of two, so a path of depth d costs log2(d) joins, and no row twice.
    """
    slim = nodes.select("tree", "node", "parent")
    known = slim.select("tree", F.col("node").alias("up"))
    jump = slim.select("tree", "node", F.col("parent").alias("up"))
    jump = stage(jump.join(known, ["tree", "up"], "left_semi").select("tree", "node", "up"), "jump")
    jumps, distance = [], 1
    total = nodes.count()
    while jump.limit(1).count() and distance <= total:
        jumps.append(jump)
        further = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jump = stage(
            jump.join(further, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "jump"
        )
        distance *= 2
    parents = slim.select("tree", F.col("parent").alias("node"))
    found = slim.join(parents, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("height")
    )
    for i, step in reversed(list(enumerate(jumps))):
        above = found.join(step, ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("height") + 2**i).alias("height")
        )
        found = stage(found.union(above), "paths")
    return found


def best_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, branch, node, height): the paths with the greatest sums of ``score`` per tree."""
    found = paths(nodes)
    scored = found.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    sums = scored.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    order = W.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    chosen = sums.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= keep)
    return found.join(chosen.select("tree", "leaf", "branch"), ["tree", "leaf"])


def format_trees(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, branch, turns, formatted, mask) of the chosen paths of each tree.

    ``nodes`` has (tree, node, parent, role, text, score); ``mask`` lists (start, end) in
    code points of ``formatted``. One row holds one conversation, however long.
    """
    chosen = best_paths(nodes.select("tree", "node", "parent", "score"), keep)
    said = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    turn = F.struct(
        (-F.col("height")).alias("at"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    told = said.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    slim = told.select("tree", "branch", "turns.role", "turns.text")
    kind = slim.schema["tree"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [
                format_turns(list(zip(r.as_py(), t.as_py()))) for r, t in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], spans),
                ],
                ["tree", "branch", "formatted", "mask"],
            )

    return map_batches(
        slim, work,
        f"tree {kind}, branch int, formatted string, mask array<struct<start: bigint, end: bigint>>",
    )


def linear_nodes(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Nodes of conversations in which every turn replies to the one before it."""
    rows = conversations.select(
        F.col(conv).alias("tree"), F.col(turn).alias("_turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    order = W.partitionBy("tree").orderBy("_turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    return stage(
        numbered.select(
            # Joins need a key that is never null.
            F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).alias("id")).alias("tree"),
            "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"),
        ),
        "nodes",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output alone."""
    kind = formatted.schema["tree"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((
                    len(turns), digest.hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(text),
                ))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return map_batches(
        formatted.select("tree", "formatted", "mask"), work,
        f"tree {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )
