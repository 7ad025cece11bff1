"""Distances between sparse documents and centroids, by joining on tokens."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.operators.postings import is_packed, posting_dots

BLOCK_CLASSES = 64


@dataclass
class ClassBlocks:
    """Centroids as one row per (token, block), with a column per class of the block.

    ``members`` has (block, labels): the classes of each block in the order of the columns.
    """

    wide: DataFrame
    members: DataFrame
    width: int
    blocks: int


def class_blocks(
    centroids: DataFrame, classes: DataFrame, values: Mapping[str, str], label: str = "label",
    block_classes: int = BLOCK_CLASSES,
) -> ClassBlocks:
    """Number the classes and lay their centroids out in blocks; ``values`` maps a name to a column.

    Any number of classes takes the same path. Null is no class. The numbering sees one
    row per class name, never the documents.
    """
    names = classes.select(label).filter(F.col(label).isNotNull()).distinct()
    place = F.row_number().over(W.orderBy(label)) - 1
    numbered = names.select(
        F.col(label).alias("_label"), F.floor(place / block_classes).cast("int").alias("_block"),
        (place % block_classes).cast("int").alias("_slot"),
    )
    total = numbered.count()
    width = max(1, min(block_classes, total))
    slim = centroids.select(
        F.col(label).alias("_label"), "token", *[F.col(c).alias(f"_c_{n}") for n, c in values.items()]
    )
    wide = slim.join(numbered, "_label").groupBy("token", "_block").agg(
        *[
            F.max(F.when(F.col("_slot") == i, F.col(f"_c_{n}"))).alias(f"_{n}_{i}")
            for n in values for i in range(width)
        ]
    )
    # A block names at most ``block_classes`` classes.
    members = numbered.groupBy("_block").agg(
        F.array_sort(F.collect_list(F.struct("_slot", "_label"))).alias("_members")
    )
    return ClassBlocks(wide, members, width, max(1, -(-total // block_classes)))


def sparse_dots(
    docs: DataFrame,
    weights: DataFrame,
    centroids: DataFrame,
    classes: DataFrame,
    pairs: Mapping[str, tuple[str, str]],
    key: str = "doc_id",
    label: str = "label",
    complete: bool = True,
    block_classes: int = BLOCK_CLASSES,
    blocks: ClassBlocks | None = None,
) -> DataFrame:
    """(docs columns, label, ``dot_<name>``, ``sq_<name>``) of documents and classes.

    ``pairs`` maps a name to (document value column, centroid value column);
    ``sq_<name>`` is the squared norm of the document's values. With ``complete``
    every document meets every class, and pairs without a common token get 0;
    otherwise only pairs with a common token are returned.

    The token join keeps one row per (document, token, block of classes), with the
    classes of a block as columns. Pass ``blocks`` to use a layout made before.
    """
    blocks = blocks or class_blocks(
        centroids, classes, {n: c for n, (_, c) in pairs.items()}, label, block_classes
    )
    if is_packed(weights):
        if not complete:
            raise ValueError("packed weights meet all classes")
        kinds = {n: d for n, (d, _) in pairs.items()}
        sums = posting_dots(weights, blocks.wide, blocks.blocks, kinds, blocks.width, key, docs.schema[key].dataType)
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks.blocks - 1)))
        full = docs.withColumn("_block", every).join(sums, [key, "_block"], "left")
        return _by_class(docs, full, blocks, pairs, label, complete)
    slim = weights.select(
        key, "token", *[F.col(d).alias(f"_d_{n}") for n, (d, _) in pairs.items()]
    )
    cells = [(n, i) for n in pairs for i in range(blocks.width)]
    squares = [F.sum(F.col(f"_d_{n}") * F.col(f"_d_{n}")).alias(f"sq_{n}") for n in pairs]
    products = [F.sum(F.col(f"_d_{n}") * F.col(f"_{n}_{i}")).alias(f"_{n}_{i}") for n, i in cells]
    if blocks.blocks == 1:
        # One block only: norms come out of the same sums.
        sums = slim.join(blocks.wide.drop("_block"), "token", "left").groupBy(key).agg(*squares, *products)
        full = docs.join(sums, key, "left").withColumn("_block", F.lit(0))
    else:
        norms = slim.groupBy(key).agg(*squares)
        sums = slim.join(blocks.wide, "token").groupBy(key, "_block").agg(*products)
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks.blocks - 1)))
        known = docs.join(norms, key, "left")
        if complete:
            full = known.withColumn("_block", every).join(sums, [key, "_block"], "left")
        else:
            full = known.join(sums, key)
    return _by_class(docs, full, blocks, pairs, label, complete)


def _by_class(
    docs: DataFrame, full: DataFrame, blocks: ClassBlocks, pairs: Mapping[str, tuple[str, str]],
    label: str, complete: bool,
) -> DataFrame:
    """One row per document and class from one row per document and block."""
    spread = full.join(blocks.members, "_block").select(
        *docs.columns, *[F.coalesce(f"sq_{n}", F.lit(0.0)).alias(f"sq_{n}") for n in pairs],
        *[F.array(*[F.col(f"_{n}_{i}") for i in range(blocks.width)]).alias(f"_{n}") for n in pairs],
        F.explode("_members").alias("_m"),
    )
    out = spread.select(
        *docs.columns, F.col("_m._label").alias(label),
        *[
            c for n in pairs
            for c in (F.get(f"_{n}", F.col("_m._slot")).alias(f"dot_{n}"), F.col(f"sq_{n}"))
        ],
    )
    if not complete:
        return out.filter(reduce(or_, [F.col(f"dot_{n}").isNotNull() for n in pairs])).na.fill(
            0.0, [f"dot_{n}" for n in pairs]
        )
    return out.na.fill(0.0, [f"dot_{n}" for n in pairs])


def euclidean_from_dot(dot: Column, doc_sq: Column, centroid_sq: Column) -> Column:
    """Euclidean distance from a dot product and two squared norms."""
    return F.sqrt(F.greatest(F.lit(0.0), doc_sq - 2 * dot + centroid_sq))


def cosine_from_dot(dot: Column, doc_sq: Column, centroid_sq: Column) -> Column:
    """Cosine similarity from a dot product and two squared norms; null for a zero norm."""
    size = F.sqrt(doc_sq) * F.sqrt(centroid_sq)
    return F.when(size > 0, dot / size)


def own_distances(
    weights: DataFrame,
    labelled: DataFrame,
    centroids: DataFrame,
    key: str = "doc_id",
    label: str = "category",
    categories: str = "categories",
) -> DataFrame:
    """(key, label, distance) of each document to the centroids of its own labels only.

    ``weights`` carry their document's label list, ``labelled`` has one row per
    (document, label). A document's squared norm comes out of the same sums as
    its dot product.
    """
    w, v = F.col("weight"), F.col("_cv")
    sizes = centroids.groupBy(label).agg(F.sum(w * w).alias("_csq"))
    spread = weights.select(key, F.explode(categories).alias(label), "token", "weight")
    values = centroids.select(label, "token", w.alias("_cv"))
    sums = spread.join(values, [label, "token"], "left").groupBy(key, label).agg(
        F.sum(w * v).alias("_dot"), F.sum(w * w).alias("_dsq")
    )
    full = labelled.select(key, label).join(sums, [key, label], "left").join(sizes, label)
    zero = F.lit(0.0)
    distance = euclidean_from_dot(
        F.coalesce("_dot", zero), F.coalesce("_dsq", zero), F.col("_csq")
    )
    return full.select(key, label, distance.alias("distance"))
