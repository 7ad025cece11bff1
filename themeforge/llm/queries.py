"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeforge.llm import (
    bpe, chat, decontaminate, langid, licenses, merkle, pieces, pii, secrets, shards, simhash, topk, trie,
)
from themeforge.llm.sql import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of what they decode to."""
    return bpe.encode_and_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document as spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed(*base), 256).alias("base_sha256"),
        secrets.listed(*base, "entropy").alias("spans"),
    )


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document as spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{name}")
        for k, name in enumerate(pii.KINDS[:-1])
    ]
    listed = F.concat("base", "found")
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(listed).alias("spans"),
    )


def _of_kind(k: int):
    return lambda span: span["kind"] == k


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    shown = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    )
    return F.array_join(shown, ",")


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed licences of each document."""
    docs = table(spark, sf_dir, "documents")
    found = licenses.find_licenses(docs, licenses.train(docs))
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["family"], s["start"], s["end"]))
    return found.select(
        "doc_id", "n_paragraphs", "n_predicted", F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.family")), ",").alias("families"),
        F.array_join(spans, ",").alias("spans"),
        F.coalesce(F.array_min("licenses.probability"), F.lit(0.0)).alias("least_probability"),
    )


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the formatted text."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", marks), (-7, 1, "assistant", marks)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    nodes = chat.linear_nodes(said.unionByName(added))
    found = chat.read_back(chat.format_trees(nodes))
    conv = F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id")
    return found.select(conv, *found.columns[1:])


@query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    found = shards.byte_shards(table(spark, sf_dir, "documents"), 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and the components of their links."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.in_fold("doc_id")
    model = langid.train(docs.filter(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and which of them fail after line ends were deleted."""
    text = F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.manifest(table(spark, sf_dir, "documents"), fields, {"text": tampered})


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the conversations, each rebuilt with the first turns of its block."""
    return trie.prefix_trie(trie.with_heads(trie.sequences(table(spark, sf_dir, "conversations"))))


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids of each document and of what they decode to."""
    return pieces.encode_and_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(sorted(QUERIES.items()))


def oracles() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
