"""A training-corpus pipeline: each stage works on all that the one before it kept.

language: every text gets a language; texts that fit none are dropped and ``lang`` becomes the language found.
lines: of equal or similar lines anywhere in the corpus one stays; documents left without text go.
near_duplicates: of each group of documents with similar word 5-grams one stays.
mixing: documents are sampled so that tokens of sources, languages and topics come to their target shares.
encoding: texts become byte-level BPE ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import byte_bpe, lang_id, line_dedup, mixing, ngram_join
from siftwell.llm.shared import staged, table


def _beside_text(docs: DataFrame) -> DataFrame:
    """(doc, text): all columns but the text as one struct, so that none can clash with those that an operator adds."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("doc"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` but for the texts that the models reject, ``lang`` being the language found; all columns stay, whatever their names.

    The models learn from two thirds of the labelled documents, as the query of this operator does, and score all. Null
    and empty texts and those without a letter have no language, so they go, as does every text where no label teaches
    one. Null ids and repeated rows are scored like others; an empty table gives an empty one.
    """
    models = lang_id.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "text", "lang"))
    found = lang_id.identify(_beside_text(docs), models).filter(~F.col("rejected"))
    own = {"text": F.col("text"), "lang": F.col("lang_pred")}
    return found.select(*(own.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without lines that repeat an earlier one, equal or similar; n_chars is counted anew.

    Documents that lose lines and have no other text go. Null texts, and those of white space only, stay as they are;
    rows with equal id and text are one document and stay or lose lines together. All columns stay.
    """
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: the least id, on ties the least hash of its text.

    Rows with equal id and text are one document. Texts without a word, null ones too, are in no group. All columns stay.
    """
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows of ``docs``. The choice depends on the id alone, so rows with equal ids stay or go together.

    Null sources and languages are values of their own, a null or empty text weighs one token. All columns stay.
    """
    return mixing.sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with n_tokens, ids and decoded_sha256 in place of the text (and of columns of these names).

    Null and empty texts give no ids. Every row stays, repeated ones too.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    added = {"n_tokens": F.col("n_tokens"), "ids": F.col("ids"), "decoded_sha256": F.sha2("decoded", 256)}
    found = byte_bpe.token_counts(byte_bpe.encode(_beside_text(docs), path, public_tokenizers.PATTERN, keep_text=False))
    kept = [c for c in docs.columns if c != "text" and c not in added]
    return found.select(*(F.col("doc")[c].alias(c) for c in kept), *(v.alias(c) for c, v in added.items()))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("encoding", encoding)]

#: Neither language models nor similarity joins can be put in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
