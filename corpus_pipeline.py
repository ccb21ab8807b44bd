"""A training corpus from ``documents``: quality rules, line dedup, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's documents; all but the last keep the columns of ``documents``, whatever further ones it has and whatever their names.
An empty table goes through all stages; null ids, sources and languages are values like any other; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, jaccard, linededup, mixing, quality
from lectern.llm.common import cut, n_words, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null and wordless texts, fewer than 10 words, over 20 repeated words in 100, or a score below the threshold.  Repeated rows fare alike."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs go; so do documents of which nothing is left.  The first copy is that of the smallest (doc_id, null first; text hash; line); rows equal in both stay alike."""
    left = linededup.delete_lines(docs)
    return left.where(F.col("__line_gone").isNull() | (n_words(F.col("text")) > 0)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the smallest doc_id, null last, then the smallest text hash; of equal rows one."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; those without a word are never taken.  Reruns take the same."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned 32-bit)."""
    return bpe.encode(docs, with_decoded=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]
#: Trees, shingle regions and BPE are beyond SQL; tests/llm/test_pipeline.py holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
