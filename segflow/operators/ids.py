"""Anonymous ids and the split of private from public tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.storage import cut


def ranked_ids(keys: DataFrame, key: str, order: list, prefix: str, digits: int, name: str = "anon_id", parts: int = 64) -> DataFrame:
    """``prefix`` and a number for every distinct key, in ``order``.

    Keys are range-partitioned and numbered in each part; a part's first number
    is the count of those before it (one row for each part), so no task sees
    all keys.
    """
    ranged = cut(keys.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))  # stored: ranges are sampled anew wherever they are computed
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = ranged.withColumn("__inside", inside).join(F.broadcast(firsts), "__part")
    number = F.lpad((F.col("__first") + F.col("__inside")).cast("string"), digits, "0")
    return numbered.select(key, F.concat(F.lit(prefix), number).alias(name))


def dense_ids(df: DataFrame, key: str, prefix: str = "P", digits: int = 3, name: str = "anon_id") -> DataFrame:
    """(key, id): trimmed distinct keys in order; null keys have none."""
    keys = df.select(F.trim(F.col(key).cast("string")).alias(key)).where(F.col(key).isNotNull()).distinct()
    return ranked_ids(keys, key, [key], prefix, digits, name)


def first_seen_ids(df: DataFrame, key: str, order: list[str], prefix: str = "P", digits: int = 6, name: str = "participant_id") -> DataFrame:
    """(key, id): keys numbered by the first of their rows in ``order``, nulls last."""
    ranks = [F.struct(F.col(c).isNull().alias(f"n_{c}"), F.col(c)) for c in order]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[r.alias(f"o{i}") for i, r in enumerate(ranks)])).alias("__o"))
    return ranked_ids(first, key, ["__o", key], prefix, digits, name)


def segment_index(df: DataFrame, by: list[str], start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    return df.withColumn("segment_index", F.row_number().over(Window.partitionBy(*by).orderBy(start, end)) - 1)


def private_split(df: DataFrame, lookup: DataFrame, private: str, public: str) -> tuple[DataFrame, DataFrame]:
    """(private lookup, public table): the table with the public id in place of the private one."""
    joined = df.withColumn(private, F.trim(F.col(private).cast("string"))).join(lookup, private, "left")
    return lookup.select(public, private), joined.select(public, *[c for c in df.columns if c != private])


def crosswalk(df: DataFrame, participant: str, ids: list[str]) -> DataFrame:
    return df.select(participant, *ids)
