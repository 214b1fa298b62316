"""The corpus operators' queries, each over its whole table.

Null and repeated ids, null, empty and very long texts, ties, repeated rows,
empty tables and further columns are treated as each operator's docstring
says: every row of ``documents`` gives its rows (op7: those with passages), and
an empty table gives none. Labels, benchmark items and texts that are null are
left out of what is learnt or looked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.llm import clustering, decontaminate, importance, linededup, lm, media, mixing, packing, secrets, sharding, simhash, sql, substring, toxicity
from segflow.llm.shared import crc32_mod, cut, new_folder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=16, map_path=new_folder(spark, "shard-maps"))
    return dealt.withColumn("grown_shard", F.lit(None).cast("int"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[secrets.count_kind("base", k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"), min_words=50, similarity=0.8).drop("copied", "text_key")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_mod(F.col("doc_id"), 7) == 2
    return lm.score(docs, lm.fit(docs.where(~held_out)), held_out)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    return mixing.mix(sized, size_col="words", weights=(3, 1, 2), share=1.5, cap=2).drop("source", "words")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_line_dedup": op2_line_dedup, "op3_simhash": op3_simhash, "op4_sharding": op4_sharding, "op5_media": op5_media, "op6_secrets": op6_secrets, "op7_substring_dedup": op7_substring_dedup, "op8_lm_scoring": op8_lm_scoring, "op9_decontamination": op9_decontamination, "op10_toxicity": op10_toxicity, "op11_mixing": op11_mixing, "op12_clustering": op12_clustering, "op13_importance": op13_importance}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": sql.OP2, "op6_secrets": sql.OP6, "op9_decontamination": sql.OP9, "op12_clustering": sql.OP12}
