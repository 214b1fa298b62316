"""Predicted against manual labels, and samples to label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _labels(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"{name}_rank int, {name} string")


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """(truth, predicted, n) for every pair of listed labels, 0 where none; other labels are left out."""
    spark_rows = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = _labels(df, labels, "truth").crossJoin(_labels(df, labels, "predicted"))
    return grid.join(spark_rows, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(matrix: DataFrame, labels: list[str]) -> DataFrame:
    return matrix.groupBy("truth").pivot("predicted", labels).agg(F.sum("n"))


def classwise_metrics(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, tn, precision, recall, f1) from a long confusion matrix; 0 where undefined."""
    zero, n = F.lit(0).cast("long"), F.col("n").cast("long")
    side = lambda label, rows, cols, hit: F.struct(F.col(label).alias("label"), rows.alias("rows"), cols.alias("cols"), hit.alias("hit"))
    each = matrix.select(F.inline(F.array(side("truth", n, zero, F.when(F.expr("truth = predicted"), n).otherwise(zero)), side("predicted", zero, n, zero))))
    sums = each.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("cols").alias("cols"), F.sum("rows").alias("rows"))
    total = matrix.agg(F.sum("n").alias("total"))
    counts = sums.crossJoin(F.broadcast(total)).select("label", "tp", (F.col("cols") - F.col("tp")).alias("fp"), (F.col("rows") - F.col("tp")).alias("fn"), (F.col("total") - F.col("rows") - F.col("cols") + F.col("tp")).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rated = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Share of labelled rows that agree, 0 without any; ``n_rows`` counts all."""
    labelled = F.col(truth).isNotNull() & (F.trim(truth) != "")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.coalesce(F.avg(F.when(labelled, (F.col(truth) == F.col(predicted)).cast("double"))), F.lit(0.0)).alias("accuracy"))


def macro_metrics(classwise: DataFrame) -> DataFrame:
    return classwise.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def evaluate(df: DataFrame, truth: str, predicted: str, labels: list[str], by: str) -> DataFrame:
    """Per group and over all (null group): rows, accuracy, macro precision, recall and F1 in one pass of grouping sets."""
    ok, listed = (F.col(truth).isNotNull() & (F.trim(truth) != "")), F.col(truth).isin(labels) & F.col(predicted).isin(labels)
    sums = [F.count("*").alias("n_rows"), F.coalesce(F.avg(F.when(ok, (F.col(truth) == F.col(predicted)).cast("double"))), F.lit(0.0)).alias("accuracy")]
    for i, x in enumerate(labels):
        t, p = listed & (F.col(truth) == x), listed & (F.col(predicted) == x)
        sums += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(p).alias(f"p{i}"), F.count_if(t).alias(f"t{i}")]
    counted = df.rollup(by).agg(*sums)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    mean = lambda f: sum((f(i) for i in range(len(labels))), F.lit(0.0)) / len(labels)
    precision, recall = (lambda i: share(c(f"tp{i}"), c(f"p{i}"))), (lambda i: share(c(f"tp{i}"), c(f"t{i}")))
    return counted.select(by, "n_rows", "accuracy", mean(precision).alias("macro_precision"), mean(recall).alias("macro_recall"), mean(lambda i: share(2.0 * c(f"tp{i}"), c(f"p{i}") + c(f"t{i}"))).alias("macro_f1"))


def sample_n(df: DataFrame, by: list[str], n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows of each group, the same for the same seed: those with the least hash of seed and key."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def argmax_accuracy(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """Share of rows whose most probable class is the true one."""
    from segflow.functions.samples import best_class

    best, _ = best_class({k: F.col(c) for k, c in probabilities.items()})
    return df.agg(F.avg((best == F.col(truth)).cast("double")).alias("accuracy"))
