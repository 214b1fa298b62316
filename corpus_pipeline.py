"""The corpus pipeline: five stages over the documents, each written and read again by the next.

Every stage takes null ids and texts, empty and very long texts, repeated rows,
further columns and empty tables: rows with a null text are kept by all stages
but are one group of near copies with other wordless ones, of which one stays;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.llm import decontaminate, linededup, packing, simhash, toxicity
from segflow.llm.shared import crc32_mod, new_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from their labels, does not call toxic; without usable labels none is dropped."""
    labels = table(spark, sf_dir, "labels").where(crc32_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` follows the text."""
    kept = linededup.drop_common_lines(docs, min_docs=10)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash as in op3 (four-word shingles, 4 bits) or by exact similarity (five-word shingles, 0.8).

    Rows are told by id and text, repeated rows are one.
    """
    grouped = simhash.similar_documents(docs, words=5, similarity=0.8, fingerprint_words=4, radius=4)
    return simhash.keep_one(docs, grouped).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item; null texts and items have no words."""
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    return decontaminate.remove_documents(marked).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences of 2048 tokens; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]
#: A trained classifier, SimHash and subword ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
