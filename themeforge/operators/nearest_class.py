"""The nearest class of sparse documents without a table of documents x classes.

With nonnegative weights the nearest centroid c of a document d has the largest score
2 d.c - |c|^2. Classes are numbered so that those with the same heaviest token are
neighbours, and form blocks of ``FANOUT``; blocks form groups of ``FANOUT``, and so on. A
node of this tree keeps, for each token, the largest value of its classes, and the least norm.
Term by term, a document's tokens add up to an upper bound of all scores below a node.

1. From the top the document follows the node of the largest bound to one block, whose
   classes it is compared with. The best score there is its mark.
2. Only nodes whose bound reaches the mark are gone into, and only blocks that remain are
   compared.

A block's classes are the columns of one row per token, so what is written is one row per
document and block looked at. Classes that share no token with a document are never met:
of them the one with the least norm is nearest, and it stands in for all.

Defined cases: a document without tokens gets the class of the least norm; distances that agree
to nine places rank by label; a null label is no class; no classes give null labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.session import stage

FANOUT = 64
#: Bounds are sums of rounded products; they give way by this share.
SLACK = 1e-9


@dataclass(frozen=True)
class ClassTree:
    """Centroids in blocks, with bounds above them."""

    wide: DataFrame  # (token, block, v_0 ...)
    members: DataFrame  # (block, classes array<struct<slot, label, sq>>)
    tops: list[DataFrame]  # by level from 1: (token, node, parent, top)
    least: list[DataFrame]  # by level from 1: (node, sq)
    width: int
    nearest_zero: DataFrame  # one row (label, sq): the class of least norm


def class_tree(
    centroids: DataFrame, classes: DataFrame, label: str = "label", value: str = "weight", fanout: int = FANOUT
) -> ClassTree:
    """Lay out the centroids (label, token, value) of ``classes`` (label)."""
    cells = centroids.select(F.col(label).alias("label"), "token", F.col(value).alias("value")).filter("value <> 0")
    facts = cells.groupBy("label").agg(F.max_by("token", "value").alias("lead"), F.sum(F.col("value") * F.col("value")).alias("sq"))
    names = classes.select(F.col(label).alias("label")).filter("label IS NOT NULL").distinct()
    # The numbering sees one row per class name, never the documents.
    place = (F.row_number().over(W.orderBy("lead", "label")) - 1).cast("long")
    numbered = stage(
        names.join(facts, "label", "left").select("label", F.coalesce("sq", F.lit(0.0)).alias("sq"), place.alias("number")),
        "numbered-classes",
    )
    total = numbered.count()
    width = max(1, min(fanout, total))
    placed = stage(cells.join(numbered.select("label", "number"), "label").drop("label"), "class-cells")
    block, slot = F.expr(f"number div {fanout}"), (F.col("number") % fanout).cast("int")
    wide = placed.groupBy("token", block.alias("block")).agg(
        *[F.max(F.when(slot == i, F.col("value"))).alias(f"v_{i}") for i in range(width)]
    )
    one = F.struct(slot.alias("slot"), "label", "sq")
    members = numbered.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(one)).alias("classes"))
    tops, least, size = [], [], fanout
    while total > size:
        node, parent = F.expr(f"number div {size}"), F.expr(f"number div {size * fanout}")
        tops.append(stage(
            placed.groupBy("token", node.alias("node"), parent.alias("parent")).agg(F.max("value").alias("top")), "class-tops"
        ))
        least.append(numbered.groupBy(node.alias("node")).agg(F.min("sq").alias("sq")))
        if -(-total // size) <= fanout:
            break
        size *= fanout
    first = numbered.orderBy("sq", "label").limit(1).select("label", "sq")
    return ClassTree(stage(wide, "class-blocks"), stage(members, "class-members"), tops, least, width, stage(first, "least-class"))


def _bounds(weights: DataFrame, tree: ClassTree, level: int, inside: DataFrame | None, key: str) -> DataFrame:
    """(key, node, bound) at a level, below the (key, parent) of ``inside`` or anywhere."""
    if inside is None:
        met = weights.join(tree.tops[level].drop("parent"), "token")
    else:
        met = weights.join(inside, key).join(tree.tops[level], ["token", "parent"])
    sums = met.groupBy(key, "node").agg(F.sum(F.col("w") * F.col("top")).alias("most"))
    return sums.join(tree.least[level], "node").select(key, "node", (2 * F.col("most") - F.col("sq")).alias("bound"))


def _in_blocks(weights: DataFrame, sizes: DataFrame, tree: ClassTree, looks: DataFrame | None, key: str) -> DataFrame:
    """(key, block, best): the nearest class of each block looked into, as (distance, label)."""
    numbers = range(tree.width)
    if looks is None:
        met = weights.join(tree.wide, "token")
    else:
        met = weights.join(looks, key).join(tree.wide, ["token", "block"])
    sums = met.groupBy(key, "block").agg(*[F.sum(F.col("w") * F.col(f"v_{i}")).alias(f"d_{i}") for i in numbers])
    known = sums.join(sizes, key).join(tree.members, "block")
    packed = known.select(
        key, "block", "sq", "classes", F.array(*[F.coalesce(f"d_{i}", F.lit(0.0)) for i in numbers]).alias("dots")
    )
    # An array of one row binds its columns once for all classes.
    row = F.array(F.struct("sq", "dots"))
    best = F.array_min(F.flatten(F.transform(row, lambda r: F.transform(
        F.col("classes"), lambda c: _ranked(r["sq"] + c["sq"] - 2 * F.get(r["dots"], c["slot"]), c["label"])
    ))))
    return packed.select(key, "block", best.alias("best"))


def _ranked(squared: Column, label: Column) -> Column:
    distance = F.sqrt(F.greatest(F.lit(0.0), squared))
    return F.struct(F.round(distance, 9).alias("rank"), label.alias("label"), distance.alias("distance"))


def nearest_class(
    docs: DataFrame, weights: DataFrame, centroids: DataFrame, classes: DataFrame, key: str = "doc_id",
    label: str = "label", value: str = "weight", fanout: int = FANOUT, tree: ClassTree | None = None,
) -> DataFrame:
    """(docs columns, label, distance): the nearest centroid of each document, by Euclidean distance.

    ``weights`` (key, token, weight) and ``centroids`` (label, token, value) must not be negative.
    """
    tree = tree or class_tree(centroids, classes, label, value, fanout)
    slim = weights.select(key, "token", F.col("weight").alias("w")).filter("w <> 0")
    if tree.tops:
        slim = stage(slim, "document-weights")
    sizes = slim.groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    if not tree.tops:
        found = _in_blocks(slim, sizes, tree, None, key).select(key, "best")
    else:
        sizes = stage(sizes, "document-norms")
        found = _by_bounds(slim, sizes, tree, key)
    # Any class without a common token is as far as this one or farther.
    lone = tree.nearest_zero.agg(F.first(F.struct("label", "sq"))).scalar()
    known = docs.join(sizes, key, "left").join(found, key, "left").withColumn("_lone", lone)
    other = F.when(
        F.col("_lone").isNotNull(), _ranked(F.coalesce("sq", F.lit(0.0)) + F.col("_lone.sq"), F.col("_lone.label"))
    )
    best = F.array_min(F.array_compact(F.array("best", other)))
    return known.select(*docs.columns, best.alias("best")).select(
        *docs.columns, F.col("best.label").alias(label), F.col("best.distance").alias("distance")
    )


def looked_into(weights: DataFrame, sizes: DataFrame, tree: ClassTree, key: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of the two rounds: (key, block, best) of the first, (key, block) of the second."""
    top = len(tree.tops) - 1
    whole = stage(_bounds(weights, tree, top, None, key), "class-bounds")
    level, bounds = top, whole
    while True:
        first = bounds.groupBy(key).agg(F.max_by("node", "bound").alias("parent"))
        if not level:
            break
        level -= 1
        bounds = _bounds(weights, tree, level, stage(first, "class-path"), key)
    looks = stage(first.withColumnRenamed("parent", "block"), "first-blocks")
    found = stage(_in_blocks(weights, sizes, tree, looks, key), "first-best")
    # A score is the document's squared norm less the squared distance.
    squared = F.col("best.distance") * F.col("best.distance")
    marks = found.join(sizes, key).select(
        key, (F.col("sq") - squared - SLACK * (F.col("sq") + squared + 1)).alias("mark")
    )
    open_nodes = whole
    for level in range(top, -1, -1):
        if level < top:
            open_nodes = _bounds(weights, tree, level, stage(open_nodes, "open-nodes"), key)
        kept = open_nodes.join(marks, key).filter(F.col("bound") >= F.col("mark"))
        open_nodes = kept.select(key, F.col("node").alias("parent"))
    second = open_nodes.withColumnRenamed("parent", "block").join(looks, [key, "block"], "left_anti")
    return found, second


def _by_bounds(weights: DataFrame, sizes: DataFrame, tree: ClassTree, key: str) -> DataFrame:
    found, second = looked_into(weights, sizes, tree, key)
    more = _in_blocks(weights, sizes, tree, stage(second, "second-blocks"), key)
    return found.unionByName(more).groupBy(key).agg(F.min("best").alias("best"))
