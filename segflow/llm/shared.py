"""What several corpus operators need: shared storage, sizes, text expressions."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segflow.storage import cut, shared_dir

#: ASCII white space: blank, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Broadcasts are refused above this many rows of a table whose bound was not proven.
BROADCAST_ROWS = 2_000_000


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checked_broadcast(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffles behind tables that are stored by now: it does so when the driver collects what refers to them.

    The query that ended last is referred to until Spark has told its listeners of another one,
    which it does a little later; so small queries without a shuffle end in between, with time to tell of them.
    """
    for _ in range(3):
        spark.range(1).collect()
        time.sleep(0.2)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``, gapless from 0 in ``order``: ranges of rows are numbered apart and start at the count of those before (a row for each range)."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__inside", inside).join(F.broadcast(firsts), "__range").withColumn(name, F.col("__first") + F.col("__inside")).drop("__range", "__first", "__inside")


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that begin as the operators' own do (``__``) under other names, and the names to give back; ``used`` stay."""
    away: dict[str, str] = {}
    for c in docs.columns:
        if c.startswith("__") and c not in used:
            name = f"kept{c}"
            while name in docs.columns or name in away.values():
                name = f"kept_{name}"
            away[c] = name
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def crc32_mod(value: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; null counts as empty text."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
