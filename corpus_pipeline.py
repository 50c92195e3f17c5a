"""From raw documents to packed batches: language, lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from binloom.llm import decontaminate, language, lines, minhash, packing, tables


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is plain; those without text or letters, or with a narrow lead, go.

    Learns from the stage's own labelled documents; without any there is no language, and nothing stays.
    """
    judged = language.identify(docs, *language.learn(docs))
    return _columns(judged.where(~F.col("__rejected")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, ``n_chars`` counted anew; a document with no word left goes."""
    out = lines.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _columns(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8), the one with the smallest id."""
    return _columns(minhash.keep_first(docs), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.decontaminate(docs, tables.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch plan: ``doc_id, n_tokens, bucket, padded_length, batch, slot`` of every document."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", clean),
          ("pack", pack)]

#: Compression, edit distance and the dynamic program are beyond SQL; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
