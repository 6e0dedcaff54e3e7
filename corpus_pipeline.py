"""A corpus pipeline of four stages over documents: language, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import langid, packing, pii, simhash
from saltmarsh.llm.common import free_name, written


#: Different letter trigrams from which on a text must resemble a learned language.
CLEAR = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language, and fills in a lang that is null by the prediction.

    Rejected are those without any letter or text, and those of at least CLEAR different trigrams that resemble no
    learned language more than chance would (another script, or no language at all). Learns from all rows with a text
    and a lang. Where nothing can be learned (no labelled row), nothing is known against a document, and those with
    a letter are kept. All columns of the input stay, whatever their names; a lang that is given stays too.
    """
    names, table = langid.profiles(docs)
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = (free_name(f"language_{x}", docs.columns) for x in ("pred", "score"))
    found = langid.identify(docs, names, table, pred_col=pred, score_col=score, clear=CLEAR).where(F.col(pred) != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", pred)).drop(pred, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of the group's smallest doc_id (null ids
    come last, and of equal ids one row stays). Columns stay.

    Near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such
    pairs connect. Pairs are pruned by SimHash fingerprints of 256 bits (op1_simhash's own rule, 2 of 64 bits, finds
    few of them: at 0.8 some 10 of 64 differ) and decided by the sets."""
    return simhash.one_each(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind; n_chars follows the new text. All rows stay."""
    clean = pii.redact(docs, pii.trained(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: No stage can be expressed in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
