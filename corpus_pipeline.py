"""From raw documents to token digests: the stages a training corpus goes through.

Every stage reads what its predecessor kept and returns a DataFrame. All but the last
return the columns of ``documents``; rows leave only by a stage's own decision.

Defined cases, for every stage: a null text is an empty one; it has no letters, so the
first stage drops it. Very long texts are read whole. Rows that repeat an id, or have none,
are rows like others; exact copies are near copies. An empty table stays empty, and columns
besides those of ``documents``, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from themeforge.llm import bpe, decontaminate, langid, near_copies, secrets
from themeforge.session import stage as written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, or without a language that holds a third of them."""
    model = langid.train(docs.filter(~langid.in_fold("doc_id")))
    return langid.keep_identified(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Documents are near copies if their SimHash fingerprints link at three bits or fewer. The
    groups that gives are then joined by what such fingerprints miss: a Jaccard similarity
    of 0.8 on five-word shingles.
    """
    return near_copies.keep_one(docs, fingerprints=True)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text, one mask for those that overlap; every document stays."""
    return secrets.redact(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL can express neither the language model nor the near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = written(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
