"""A corpus pipeline: quality filter, near-duplicate removal, decontamination, PII surrogates, byte-level BPE.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame. What a stage
returns is written as Parquet and read again as the next one's ``docs``. All stages but the last return the columns of
``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eocube.llm import byte_bpe, decontaminate, golay_dedup, pii, quality_classifier
from eocube.llm.common import read
from eocube.session import stage as stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, Jaccard 0.8) stays: the one of the smallest doc_id.

    SimHash and Golay keys give the links at up to 3 bits, MinHash those beyond; each is confirmed on full sets.
    """
    return golay_dedup.keep_one(docs, size=5, similarity=0.8)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark (10 words) go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII is replaced; n_chars follows the text."""
    out = pii.replace(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``: ids as packed little-endian uint32; they decode to the text's bytes."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality), ("simhash_dedup", dedup), ("decontamination", clean_benchmark), ("pii", surrogates), ("byte_bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stored(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the surrogates and the encoder; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None
