"""Licence scans: a trained paragraph classifier, with templates to confirm it.

A paragraph is a line of a text; notices that are wrapped over lines, or that share one
with others, are found by windows of words. A window a quarter longer than a template slides
over each run of non-blank lines; where it holds enough of the template, it runs from the
first to the last word pair of it. Every family so confirmed is reported, once for each
place, and without asking the classifier; what a line already reported is not repeated.

The features of a paragraph are the word pairs and triples that occur
in the licence templates, present or not; a multinomial logistic regression (Spark ML)
tells the families apart, and from paragraphs that are no licence. It is trained on the
templates, whole and with words left out, and on a bounded sample of ``NEGATIVES``
different paragraphs of the corpus that share less than a fifth of any template. Every fourth row
is held out to calibrate the probabilities by one temperature; a paragraph whose likeliest
family stays below ``LEAST`` is unknown. A prediction counts when a template of the
family confirms it: enough of its word pairs stand in the paragraph.

Defined cases: null and empty texts have no paragraphs; blank lines are none; repeated
rows are scanned each time; without any paragraph in the corpus the templates alone
train the model; ties go to the family that sorts first; very long texts are read whole;
other columns, whatever their names, are not read; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import broadcast_value, map_batches

NEGATIVES = 4000
LEAST = 0.5
CONFIRM = 0.6
#: Rows by which the classifier learns a short template.
REPEATED = 14
UNKNOWN = "unknown"

# Sentences by which a licence is granted or named.
TEMPLATES = {
    "agpl": (
        "This program is free software under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License which accompanies this distribution",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction",
        "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_WORD_IN_TEXT = re.compile(_WORD.pattern, re.IGNORECASE | re.ASCII)


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams_of(words: list[str]) -> set[str]:
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
    return pairs | {f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])}


@cache
def _template_grams() -> tuple[tuple[str, frozenset[str]], ...]:
    return tuple((f, frozenset(grams_of(words_of(t)))) for f, texts in TEMPLATES.items() for t in texts)


@cache
def _features() -> dict[str, int]:
    """Number of each word pair and triple of the templates."""
    names = sorted({g for _, grams in _template_grams() for g in grams})
    return {g: i for i, g in enumerate(names)}


@cache
def _feature_words() -> frozenset[str]:
    return frozenset(w for g in _features() for w in g.split())


def features_of(paragraph: str) -> list[int]:
    """Sorted numbers of the template n-grams in a paragraph."""
    words = words_of(paragraph)
    known = _feature_words()
    if sum(w in known for w in words) < 2:
        return []
    number = _features().get
    return sorted({n for g in grams_of(words) if (n := number(g)) is not None})


def confirmed(features: list[int], family: str) -> float:
    """The greatest share of a family's template that the features hold."""
    held = set(features)
    number = _features()
    return max(
        sum(number[g] in held for g in grams) / len(grams) for f, grams in _template_grams() if f == family
    )


@cache
def _windows() -> dict[str, tuple[tuple[str, frozenset[str], int], ...]]:
    """By n-gram, the templates that hold it: family, n-grams and number of words."""
    by_gram: dict[str, list] = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            words = words_of(t)
            entry = (family, frozenset(grams_of(words)), len(words))
            for g in entry[1]:
                by_gram.setdefault(g, []).append(entry)
    return {g: tuple(v) for g, v in by_gram.items()}


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Places of the runs of consecutive lines that are not blank."""
    start = end = None
    for a, b in paragraphs(text):
        if end is not None and a == end + 1:
            end = b
            continue
        if start is not None:
            yield start, end
        start, end = a, b
    if start is not None:
        yield start, end


def notices(text: str, start: int, end: int, confirm: float) -> list[tuple[int, int, str, float]]:
    """(start, end, family, share) of the templates held by windows of words of a block.

    Where windows of one family overlap, the one with the greatest share counts; a family
    whose notice lies inside a better one of another family is not reported.
    """
    known = _feature_words()
    spots = [(m.start(), m.end(), m.group().lower()) for m in _WORD_IN_TEXT.finditer(text, start, end)]
    words = [w for _, _, w in spots]
    if sum(w in known for w in words) < 2:
        return []
    places: dict[tuple, list[tuple[int, int, str]]] = {}
    by_gram = _windows()
    for size in (2, 3):
        for i in range(len(words) - size + 1):
            g = " ".join(words[i : i + size])
            for entry in by_gram.get(g, ()):
                places.setdefault(entry, []).append((i, i + size, g))
    found = []
    for (family, grams, length), hits in places.items():
        hits.sort()
        low = 0
        counts: dict[str, int] = {}
        for at, (_, last, g) in enumerate(hits):
            counts[g] = counts.get(g, 0) + 1
            # a window of a quarter more words than the template has
            while hits[low][0] < last - length - length // 4:
                gone = hits[low][2]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                low += 1
            share = len(counts) / len(grams)
            if share >= confirm:
                ends = max(h[1] for h in hits[low : at + 1])
                found.append((share, spots[hits[low][0]][0], spots[ends - 1][1], family))
    kept: list[tuple[int, int, str, float]] = []
    for share, a, b, family in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1], x[3])):
        if all(b <= c or d <= a for c, d, _, _ in kept):
            kept.append((a, b, family, share))
    return sorted(kept)


def paragraphs(text: str | None) -> Iterator[tuple[int, int]]:
    """Places of the lines of a text that are not blank."""
    at = 0
    for line in (text or "").split("\n"):
        if line and not line.isspace():
            yield at, at + len(line)
        at += len(line) + 1


def _positives() -> Iterator[tuple[str, list[int]]]:
    """Templates whole, with each word left out, and their first and last halves.

    A variant that is as much like another family's template teaches neither. A short
    template, which has hardly any variants, is repeated as often as a long one varies.
    """
    for family, texts in TEMPLATES.items():
        for template in texts:
            words = words_of(template)
            half = (len(words) + 1) // 2
            whole = [words] * max(1, REPEATED - len(words))
            for w in (*whole, words[:half], words[half:], *(words[:i] + words[i + 1 :] for i in range(len(words)))):
                features = features_of(" ".join(w))
                own = confirmed(features, family)
                if all(confirmed(features, other) < own for other in TEMPLATES if other != family):
                    yield family, features


def _negative_sample(docs: DataFrame, text: str, n: int) -> DataFrame:
    """The features of up to ``n`` different paragraphs, lowest hashes first, that are like no template.

    All lines are counted first. Only those in the share of the hash range that holds about
    ``2 * n`` of them go on, each different line once, so what is sorted does not grow.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    total = docs.agg(F.sum(F.size(lines))).first()[0] or 0
    spread = docs.select(F.explode(lines).alias("line")).filter(F.length(F.trim("line")) > 0)
    hashed = spread.select(F.xxhash64("line").alias("h"), "line")
    if total > 2 * n:
        hashed = hashed.filter(F.shiftrightunsigned("h", 1) < int(2 * n / total * 2**63))
    chosen = hashed.distinct().orderBy("h", "line").limit(n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _features()
        for batch in batches:
            found = [features_of(t) for t in batch.column(1).to_pylist()]
            kept = [
                f for f in found
                if all(len(grams) * 0.2 > sum(number[g] in set(f) for g in grams) for _, grams in _template_grams())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int64()))], ["features"])

    return map_batches(chosen, work, "features array<bigint>")


def train(docs: DataFrame, text: str = "text", negatives: int = NEGATIVES, least: float = LEAST) -> dict:
    """Weights, intercepts, temperature and threshold of the classifier."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    spark = docs.sparkSession
    families = [UNKNOWN, *TEMPLATES]
    size = len(_features())
    negative = [(0, r["features"]) for r in _negative_sample(docs, text, negatives).toArrow().to_pylist()]
    positive = [(families.index(f), x) for f, x in _positives()]
    # many paragraphs without any feature teach no more than a few do
    rows = [(float(y), x) for y, x in [*positive, *negative, *([(0, [])] * 50)]]
    data = [(y, Vectors.sparse(size, x, [1.0] * len(x)), i % 4 == 3) for i, (y, x) in enumerate(rows)]
    frame = spark.createDataFrame(data, ["label", "features", "held_out"]).coalesce(1)
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60).fit(
        frame.filter("NOT held_out")
    )
    weights = np.zeros((len(families), size))
    intercepts = np.full(len(families), -30.0)
    matrix = fitted.coefficientMatrix.toArray()
    weights[: len(matrix)], intercepts[: len(matrix)] = matrix, fitted.interceptVector.toArray()
    held = [(int(y), x) for i, (y, x) in enumerate(rows) if i % 4 == 3]

    def loss(temperature: float) -> float:
        p = [_softmax((weights[:, x].sum(1) + intercepts) / temperature)[y] for y, x in held]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return {
        "families": families, "weights": weights, "intercepts": intercepts,
        "temperature": temperature, "least": least,
    }


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def classify(features: list[int], model: dict) -> tuple[str, float]:
    """(family, its calibrated probability); below the threshold the family is unknown."""
    p = _softmax((model["weights"][:, features].sum(1) + model["intercepts"]) / model["temperature"])
    best = int(p.argmax())
    if best == 0 or p[best] < model["least"]:
        return UNKNOWN, float(p[0])
    return model["families"][best], float(p[best])


def find_licenses(
    docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text", confirm: float = CONFIRM
) -> DataFrame:
    """(id, n_paragraphs, n_predicted, licenses) of each row.

    ``licenses`` lists the confirmed paragraphs as (start, end, family, probability,
    template share); ``n_predicted`` counts those predicted before confirmation.
    """
    shared = broadcast_value(docs.sparkSession, model)
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()),
        ("probability", pa.float64()), ("template_share", pa.float64()),
    ]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        empty = classify([], model)[0] != UNKNOWN
        for batch in batches:
            counts, predicted, licenses = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n = hits = 0
                found = []
                for a, b in paragraphs(text):
                    n += 1
                    features = features_of(text[a:b])
                    if not features and not empty:
                        continue
                    family, probability = classify(features, model)
                    if family == UNKNOWN:
                        continue
                    hits += 1
                    share = confirmed(features, family)
                    if share >= confirm:
                        found.append({
                            "start": a, "end": b, "family": family, "probability": probability,
                            "template_share": share,
                        })
                lines = list(found)
                for start, end in blocks(text):
                    for a, b, family, _ in notices(text, start, end, confirm):
                        if any(x["family"] == family and x["start"] < b and a < x["end"] for x in lines):
                            continue
                        features = features_of(text[a:b])
                        family, probability = classify(features, model)
                        if family == UNKNOWN:
                            continue
                        share = confirmed(features, family)
                        if share < confirm or any(
                            x["family"] == family and x["start"] < b and a < x["end"] for x in found
                        ):
                            continue
                        found.append({
                            "start": a, "end": b, "family": family, "probability": probability,
                            "template_share": share,
                        })
                found.sort(key=lambda x: (x["start"], x["end"], x["family"]))
                counts.append(n)
                predicted.append(hits)
                licenses.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(predicted, pa.int64()),
                 pa.array(licenses, found_type)],
                ["id", "n_paragraphs", "n_predicted", "licenses"],
            )

    return map_batches(
        slim, work,
        f"id {kind}, n_paragraphs bigint, n_predicted bigint, licenses array<struct<start: bigint, "
        "end: bigint, family: string, probability: double, template_share: double>>",
    ).withColumnRenamed("id", id)
