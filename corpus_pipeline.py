"""From raw documents to packed training sequences, in stages that each work on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import langid, line_dedup, packing, simhash
from loamworks.llm.shared import materialize
from loamworks.session import table

#: SQL can't express the stages' models and hashes; tests hold them against brute-force versions.
ORACLE_SQL = None


#: Texts without a language whose nearest profile scores less are in none of the learned ones: on average, their n-grams are three quarters of a profile out of place, or not
#: in it. Of the 10,000 prose texts of the sf0.1 table the lowest scores 0.45; a text of one repeated letter scores under 0.1.
LEAST_SCORE = 0.25


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = LEAST_SCORE) -> DataFrame:
    """Drops documents that language identification rejects: null texts, those without letters, and those without a given language whose best score is below ``least_score``.

    A document that stays without a language gets the predicted one; a given language stays, and keeps its document, whatever the prediction.
    """
    found = langid.predict(docs, keep=True, names=("_lang", "_score")).filter((F.col("_lang") != langid.UNKNOWN) & (F.col("lang").isNotNull() | (F.col("_score") >= least_score)))
    return found.select(*[F.coalesce("lang", "_lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that five or more documents share, but for one copy; n_chars follows the text."""
    kept = line_dedup.drop_common_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, keeps the document with the least doc_id; rows with a null doc_id that have no named copy stay."""
    found = simhash.classes(docs, width=5, similarity=0.8)
    lose = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(lose, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table of documents; each stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
