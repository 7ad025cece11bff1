"""Holdout evaluation of centroid classifiers on labelled documents.

Documents carry ``doc_id``, ``class`` and ``text``. Two spaces are scored: raw
weights with Euclidean distance, unit-length weights with 1 / cosine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.functions.scores import exponential, gaussian
from themeforge.functions.vectors import inverse_cosine
from themeforge.operators.centroids import (
    centroid_norms,
    class_centroids,
    class_table,
    variance_by_class,
)
from themeforge.operators.nearest_class import nearest_class
from themeforge.operators.postings import (
    chunk_vocabularies,
    is_packed,
    postings_stats,
    term_postings,
    token_weights,
    weighed_postings,
)
from themeforge.operators.scoring import highest, lowest
from themeforge.operators.similarity import (
    BLOCK_CLASSES,
    ClassBlocks,
    class_blocks,
    cosine_from_dot,
    euclidean_from_dot,
    sparse_dots,
)
from themeforge.operators.splits import folds, holdout_part, train_runs
from themeforge.operators.vocab import term_counts, token_stats
from themeforge.operators.weights import (
    class_sums,
    count_profile,
    fit_idf,
    profile_stats,
    profile_sums,
    row_total,
    tf_idf,
)
from themeforge.session import stage, unstage

SPACES = ("raw", "unit")
SCORERS = tuple(f"{scorer}_{space}" for space in SPACES for scorer in ("distance", "gauss", "expo"))
_VALUE = {"raw": "weight", "unit": "unit"}


@dataclass
class Split:
    """Documents with their part, and their term counts (rows or packed)."""

    docs: DataFrame
    counts: DataFrame

    def only(self, part: str) -> Split:
        here = F.col("part") == part
        return Split(self.docs.filter(here), self.counts.filter(here))


def split_documents(
    docs: DataFrame, seed: int = 42, ratio: float = 0.7, ngram_range: tuple[int, int] = (1, 2),
    packed: bool = True,
) -> Split:
    """Split, and count the terms of all documents once: fitting and weighing read the same files.

    The counts are packed, or one row per (document, token) if not ``packed``.
    """
    parted = docs.withColumn("part", holdout_part(docs, "doc_id", seed, ratio))
    keys = ("doc_id", "class", "part")
    if packed:
        counts = term_postings(parted, keys[1:], keys[0], ngram_range=ngram_range)
    else:
        counts = term_counts(parted, keys, ngram_range=ngram_range)
    return Split(parted.select(*keys), stage(counts, "counts"))


def weigh(split: Split, fit_on: str = "train", min_df: int = 5) -> DataFrame:
    """``weight`` (TF-IDF) and ``unit`` (its L2-normalised form) of all documents.

    The vocabulary is fitted on the ``train`` part or on ``all`` documents. Packed counts
    give packed weights.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on: {fit_on}")
    fit = split.only("train") if fit_on == "train" else split
    if is_packed(split.counts):
        # Each step is written, so that its shuffle goes before the next one fills the disk.
        vocabulary = stage(fit_idf(postings_stats(fit.counts), row_total(fit.docs), min_df), "vocabulary")
        known = stage(chunk_vocabularies(split.counts, vocabulary), "chunk-vocabularies")
        weights = stage(weighed_postings(split.counts, known), "weights")
        unstage(vocabulary, known)
        return weights
    vocabulary = fit_idf(token_stats(fit.counts), row_total(fit.docs), min_df)
    # Norms are one number per document, summed before they are shuffled; written first,
    # the weights are neither computed twice nor sorted by document.
    weights = stage(tf_idf(split.counts, vocabulary), "weights")
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_size"))
    unit = F.when(F.col("_size") > 0, F.col("weight") / F.col("_size"))
    return weights.join(stage(norms, "norms"), "doc_id").withColumn("unit", unit).drop("_size")


def class_distances(
    docs: DataFrame, weights: DataFrame, spaces: Sequence[str] = SPACES
) -> DataFrame:
    """(doc_id, class, part, label, <space>_distance): every document to every train centroid."""
    train = F.col("part") == "train"
    classes = class_table(docs.filter(train))
    values = tuple(_VALUE[s] for s in spaces)
    # Norms and blocks both read the sums.
    rows = token_weights(weights.filter(train)) if is_packed(weights) else weights.filter(train)
    sums = stage(class_sums(rows, "class", values), "class-sums")
    centroids = class_centroids(sums, classes, values=values).withColumnRenamed("class", "label")
    return centroid_distances(docs, weights, centroids, classes, spaces)


@dataclass
class CentroidModel:
    """Centroids laid out for scoring: their norms (label, csq_<space>) and their blocks."""

    norms: DataFrame
    blocks: ClassBlocks


def centroid_model(
    centroids: DataFrame, classes: DataFrame, spaces: Sequence[str] = SPACES, staged: bool = False
) -> CentroidModel:
    """Lay centroids out; ``staged`` writes the layout once, for use by many batches."""
    values = {s: _VALUE[s] for s in spaces}
    norms = centroid_norms(centroids, "label", tuple(values.values())).select(
        "label", *[F.col(f"sq_{v}").alias(f"csq_{s}") for s, v in values.items()]
    )
    blocks = class_blocks(centroids, classes.select(F.col("class").alias("label")), values)
    if staged:
        norms = stage(norms, "norms")
        blocks = replace(blocks, wide=stage(blocks.wide, "blocks"), members=stage(blocks.members, "members"))
    return CentroidModel(norms, blocks)


def centroid_distances(
    docs: DataFrame,
    weights: DataFrame,
    centroids: DataFrame,
    classes: DataFrame,
    spaces: Sequence[str] = SPACES,
    model: CentroidModel | None = None,
) -> DataFrame:
    """(docs columns, label, <space>_distance) from ready centroids (label, token, values)."""
    model = model or centroid_model(centroids, classes, spaces)
    dots = sparse_dots(
        docs, weights, centroids, classes, {s: (_VALUE[s], _VALUE[s]) for s in spaces},
        blocks=model.blocks,
    ).join(model.norms, "label")
    measured = {}
    if "raw" in spaces:
        measured["raw_distance"] = euclidean_from_dot(
            F.col("dot_raw"), F.col("sq_raw"), F.col("csq_raw")
        )
    if "unit" in spaces:
        measured["unit_distance"] = inverse_cosine(
            cosine_from_dot(F.col("dot_unit"), F.col("sq_unit"), F.col("csq_unit"))
        )
    return dots.select(*docs.columns, "label", *[c.alias(n) for n, c in measured.items()])


def class_scores(
    distances: DataFrame, spaces: Sequence[str] = SPACES, alpha: float = 1e-3, by: Sequence[str] = ()
) -> DataFrame:
    """Add <space>_gauss and <space>_expo, spreads taken from the train part's own classes.

    ``by`` names columns, such as the run of an evaluation, that have spreads of their own.

    The distances are staged: spreads and scores both read them, and they are a
    few numbers per document where the weights they come from are hundreds.
    """
    distances = stage(distances, "distances")
    own = (F.col("part") == "train") & (F.col("class") == F.col("label"))
    keys = [*by, "label"]
    variances = variance_by_class(distances, own, keys, tuple(f"{s}_distance" for s in spaces))
    joined = distances.join(variances, keys, "left")
    columns = [F.col(c) for c in distances.columns]
    for s in spaces:
        d, v = F.col(f"{s}_distance"), F.col(f"var_{s}_distance")
        columns += [gaussian(d, v).alias(f"{s}_gauss"), exponential(d, alpha).alias(f"{s}_expo")]
    return joined.select(*columns)


def predictions(
    scores: DataFrame, spaces: Sequence[str] = SPACES, by: Sequence[str] = ()
) -> DataFrame:
    """(by, doc_id, class, part, <scorer>_<space>): the class each scorer picks for each document."""
    picks = []
    for s in spaces:
        picks += [
            lowest(F.col(f"{s}_distance"), F.col("label")).alias(f"distance_{s}"),
            highest(F.col(f"{s}_gauss"), F.col("label")).alias(f"gauss_{s}"),
            highest(F.col(f"{s}_expo"), F.col("label")).alias(f"expo_{s}"),
        ]
    return scores.groupBy(*by, "doc_id", "class", "part").agg(*picks)


def accuracies(
    predicted: DataFrame, scorers: Sequence[str] = SCORERS, by: Sequence[str] = ()
) -> DataFrame:
    """(by, scorer, n, accuracy) over the test part."""
    test = predicted.filter(F.col("part") == "test")
    wide = test.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(F.coalesce(F.col(s) == F.col("class"), F.lit(False)).cast("int")).alias(s)
          for s in scorers],
    )
    return wide.unpivot([*by, "n"], list(scorers), "scorer", "accuracy")


def evaluate_holdout(
    docs: DataFrame, seed: int = 42, ratio: float = 0.7, fit_on: str = "train", min_df: int = 5
) -> DataFrame:
    """Accuracy of the three scorers in both spaces."""
    split = split_documents(docs, seed, ratio)
    weights = weigh(split, fit_on, min_df)
    unstage(split.counts)
    scores = class_scores(class_distances(split.docs, weights))
    return accuracies(predictions(scores))


def nearest_centroid_by_class(
    docs: DataFrame, seed: int = 42, ratio: float = 0.7, min_df: int = 5
) -> DataFrame:
    """(class, n, accuracy) of the nearest raw centroid on the test part.

    Two passes over the text: the train part is summed up into a count profile
    that yields vocabulary and centroids, the test part is scored against them.
    """
    split = split_documents(docs, seed, ratio, packed=False)
    train, test = split.only("train"), split.only("test")
    classes = class_table(train.docs)
    profile = count_profile(train.counts, "class")
    vocabulary = fit_idf(profile_stats(profile), row_total(train.docs), min_df)
    model = stage(profile_sums(profile, vocabulary, "class"), "centroids")
    idf = model.groupBy("token").agg(F.first("idf").alias("idf"))
    centroids = class_centroids(model, classes).withColumnRenamed("class", "label")
    picked = nearest_class(test.docs, tf_idf(test.counts, idf), centroids, classes.withColumnRenamed("class", "label"))
    picked = picked.withColumnRenamed("label", "predicted")
    hit = F.coalesce(F.col("predicted") == F.col("class"), F.lit(False)).cast("int")
    return picked.groupBy("class").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def run_accuracies(docs: DataFrame, weights: DataFrame, runs: int) -> DataFrame:
    """(run, scorer, n, accuracy) of several splits at once, from one pass over the weights.

    ``docs`` (doc_id, class, train_in) carry the numbers of the runs in which the document trains;
    packed ``weights`` (class, times, copies, ...) how often it does in each run, and how many rows of
    ``docs`` have its id. Centroids of all runs are columns of one row per (class, token), so each
    document meets them in one pass.
    """
    numbers = range(runs)
    inside = [F.array_contains("train_in", i) for i in numbers]
    times = [F.split("times", ",")[i].cast("double") for i in numbers]
    cells = [(s, i) for s in SPACES for i in numbers]
    sizes = docs.groupBy("class").agg(*[F.count_if(inside[i]).alias(f"n_{i}") for i in numbers])
    sums = token_weights(weights).groupBy("class", "token").agg(
        *[F.sum(F.when(times[i] > 0, times[i] * F.col(_VALUE[s]))).alias(f"{s}_{i}") for s, i in cells]
    )
    centroids = sums.join(sizes, "class").select(
        F.col("class").alias("label"), "token",
        *[F.when(F.col(f"n_{i}") > 0, F.col(f"{s}_{i}") / F.col(f"n_{i}")).alias(f"{s}_{i}") for s, i in cells],
    )
    centroids = stage(centroids, "run-centroids")
    norms = centroid_norms(centroids, "label", tuple(f"{s}_{i}" for s, i in cells))
    labels = sizes.withColumnRenamed("class", "label")
    dots = sparse_dots(
        docs, weights, centroids, labels, {f"{s}_{i}": (_VALUE[s], f"{s}_{i}") for s, i in cells},
        block_classes=max(1, BLOCK_CLASSES // runs),
    ).join(labels, "label").join(norms.withColumnsRenamed({f"sq_{s}_{i}": f"csq_{s}_{i}" for s, i in cells}), "label", "left")

    def measured(i: int) -> Column:
        name = lambda kind, s: F.coalesce(f"{kind}_{s}_{i}", F.lit(0.0))
        raw = euclidean_from_dot(name("dot", "raw"), name("sq", "raw"), name("csq", "raw"))
        cosine = cosine_from_dot(name("dot", "unit"), name("sq", "unit"), name("csq", "unit"))
        # A class without a document in the run's train part is no candidate there.
        return F.when(F.col(f"n_{i}") > 0, F.struct(
            F.lit(i).alias("run"), F.when(inside[i], "train").otherwise("test").alias("part"),
            raw.alias("raw_distance"), inverse_cosine(cosine).alias("unit_distance"),
        ))

    each = F.explode(F.array_compact(F.array(*[measured(i) for i in numbers])))
    distances = dots.select("doc_id", "class", "label", each.alias("m")).select("doc_id", "class", "label", "m.*")
    scores = class_scores(distances, by=["run"]).filter("part = 'test'")
    return accuracies(predictions(scores, by=["run"]), by=["run"])


def _weighed_once(docs: DataFrame, min_df: int) -> DataFrame:
    """Packed weights of all documents (and times, copies), fitted on all of them."""
    counts = stage(term_postings(docs, ("class", "times", "copies"), ngram_range=(1, 2)), "counts")
    weights = weigh(Split(docs.select("doc_id", "class"), counts), "all", min_df)
    unstage(counts)
    return weights


def _listed(numbers: Sequence[Column]) -> Column:
    """Whole numbers as one text, which rows of packed counts can share."""
    return F.concat_ws(",", *[n.cast("string") for n in numbers])


def repeated_holdout(
    docs: DataFrame, seeds: Sequence[int], ratio: float = 0.7, min_df: int = 5
) -> DataFrame:
    """(seed, scorer, n, accuracy): weights fitted once on all rows, one split per seed.

    All seeds are evaluated together: one pass finds their cuts, one their sums, one join
    their distances.
    """
    base = docs.select("doc_id", "class")
    train_in = train_runs(base, "doc_id", seeds, ratio)
    times = _listed([F.array_contains(train_in, i).cast("int") for i in range(len(seeds))])
    weights = _weighed_once(docs.withColumns({"times": times, "copies": F.lit(1)}), min_df)
    found = run_accuracies(base.withColumn("train_in", train_in), weights, len(seeds))
    names = F.array(*[F.lit(s) for s in seeds])
    return found.select(F.get(names, F.col("run")).alias("seed"), "scorer", "n", "accuracy")


def fold_accuracy(docs: DataFrame, k: int = 5, seed: int = 42, min_df: int = 5) -> DataFrame:
    """(fold, scorer, n, accuracy): every fold once as test part, weights fitted on all rows.

    A document trains in every run but that of its own fold; all runs are one pass.
    """
    placed = folds(docs.select("doc_id", "class"), k, "doc_id", seed)
    others = F.array_remove(F.array(*[F.lit(i) for i in range(k)]), F.col("fold"))
    members = stage(placed.select("doc_id", "class", others.alias("train_in")), "folds")
    # Rows that repeat an id may lie in different folds; each of them has the weights of all.
    times = _listed([F.count_if(F.array_contains("train_in", i)) for i in range(k)])
    by_id = members.groupBy("doc_id").agg(times.alias("times"), F.count("*").cast("int").alias("copies"))
    known = docs.select("doc_id", "class", "text").join(by_id.hint("shuffle_hash"), "doc_id", "left")
    found = run_accuracies(members, _weighed_once(known, min_df), k)
    return found.withColumnRenamed("run", "fold")
