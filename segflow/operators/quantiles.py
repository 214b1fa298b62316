"""Exact quantiles without a map of all values in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.storage import cut

#: Rank error of the first pass as a share of the rows, inverted; a bracket holds at most six such shares.
ACCURACY = 100_000
#: The same of the sketches, whose memory grows with it; and shares beyond which all values are ranked, as brackets would hold most of them.
SKETCH, MANY = 10_000, 16
#: Rows up to which a table of groups is told to all tasks.
FEW = 10_000


def of_groups(df: DataFrame) -> DataFrame:
    """A table of a row for each group, stored; told to all tasks if it is small, so that a join with it does not deal rows to few groups."""
    stored = cut(df)
    return F.broadcast(stored) if stored.limit(FEW + 1).count() <= FEW else stored


def small_groups(df: DataFrame, by: list[str], accuracy: int = ACCURACY) -> bool:
    """Whether no group has more than ``accuracy`` rows (one count, one number to the driver): then ``percentile`` holds no more values than that."""
    return (df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= accuracy


def with_quantiles(found: DataFrame, df: DataFrame, by: list[str], column: str, shares: tuple[float, ...], name: str) -> DataFrame:
    """``found``, a row for each group, with the quantiles of a column by group (null groups are groups) as the array ``name``."""
    own = exact_quantiles(df, by, [column], shares).select(*[F.col(b).alias(f"__of{i}") for i, b in enumerate(by)], F.col("q").alias(name))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"__of{i}")) for i, b in enumerate(by)], F.lit(True))
    return found.join(own, same, "left").drop(*[f"__of{i}" for i in range(len(by))])


def ranked_values(rows: DataFrame, keys: list[str], columns: int, shares: tuple[float, ...]) -> DataFrame:
    """(*keys, i, v, lump, n, c, upto): the distinct values of each column and group at the ranks that shares ask for, their counts, and how many values are up to them.

    Distinct values are dealt to ranges; a range is summed up by itself and
    starts at the sum of those before it, so no task sorts a whole group, and
    only ranges with a wanted rank are looked at.
    """
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__v{i}").alias("v")) for i in range(columns)]))).where("v IS NOT NULL")
    counts = long.groupBy(*keys, "i", "v").agg(F.count("*").alias("c"))
    ranged = cut(counts.repartitionByRange(*keys, "i", "v").withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "i")
    before = F.sum("held").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy(*keys, "i", "range").agg(F.sum("c").alias("held")).withColumns({"first": F.coalesce(before, F.lit(0)), "n": F.sum("held").over(own)})
    exact = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: s * (F.col("n") - 1))
    wanted = F.array_distinct(F.concat(F.transform(exact, lambda r: F.floor(r)), F.transform(exact, lambda r: F.ceil(r))))
    here = F.filter(wanted, lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("held")))
    told = sizes.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("i").alias("i_of"), F.col("range").alias("range_of"), "first", "n", here.alias("ranks")).where(F.size("ranks") > 0)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys], (F.col("i") == F.col("i_of")) & (F.col("range") == F.col("range_of")))
    inside = F.sum("c").over(Window.partitionBy(*keys, "i", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.join(told, same).withColumn("upto", inside + F.col("first"))
    asked = F.exists("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))
    return summed.where(asked).select(*keys, "i", "v", F.lit(False).alias("lump"), "n", "c", "upto")


def bracketed_values(rows: DataFrame, keys: list[str], columns: int, shares: tuple[float, ...], sketch: int) -> DataFrame:
    """As ``ranked_values``, but values outside the brackets of all shares are one ``lump`` for each bracket that they follow."""
    margin = 2.0 / sketch
    ends = sorted({min(max(s + m, 0.0), 1.0) for s in shares for m in (-margin, margin)})
    found = [F.struct(F.count(f"__v{i}").alias("n"), F.percentile_approx(f"__v{i}", ends, sketch).alias("at")).alias(f"__b{i}") for i in range(columns)]
    bounds = of_groups(rows.groupBy(*keys).agg(*found))
    if keys:
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
        joined = rows.join(bounds.withColumnsRenamed({k: f"{k}_of" for k in keys}), same)
    else:
        joined = rows.crossJoin(bounds)

    def placed(i: int):
        v, at, n = F.col(f"__v{i}"), F.col(f"__b{i}.at"), F.col(f"__b{i}.n")
        place = {e: at[j] for j, e in enumerate(ends)}
        low = lambda s: place[min(max(s - margin, 0.0), 1.0)]
        high = lambda s: place[min(max(s + margin, 0.0), 1.0)]
        inside = (n <= sketch) | reduce(or_, [v.between(low(s), high(s)) for s in shares])
        before = F.coalesce(F.greatest(F.lit(None).cast("double"), *[F.when(b < v, b) for b in place.values()]), F.lit(float("-inf")))
        return F.struct(F.lit(i).alias("i"), F.when(inside, v).otherwise(before).alias("v"), (~inside).alias("lump"), n.alias("n"), v.isNotNull().alias("there"))

    long = joined.select(*keys, F.inline(F.array(*[placed(i) for i in range(columns)]))).where("there")
    counts = long.groupBy(*keys, "i", "v", "lump", "n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v", "lump").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("upto", upto)


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], shares: tuple[float, ...], accuracy: int = ACCURACY) -> DataFrame:
    """(*by, variable, n, q): each column's quantiles by group, interpolated between neighbours, nulls left out.

    Where no group has more than ``accuracy`` rows, one aggregate holds their
    values. Else a first aggregate brackets every quantile between two approximate ones,
    whose rank error is bounded. The second keeps the values inside the
    brackets as they are and counts the others by the bracket they follow, so
    a group's window sorts about ``6 / SKETCH`` of its rows for each share,
    and may spill; groups of up to ``SKETCH`` rows are bracketed as a whole.
    For more than ``MANY`` shares distinct values are counted and ranked in
    ranges (``ranked_values``) instead. A group without values has no row for that column.
    """
    sketch = min(accuracy, SKETCH)
    keys = [f"__by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[F.col(c).try_cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    if small_groups(df, by, accuracy):
        told = F.array(*[F.lit(float(s)) for s in shares])
        held = rows.groupBy(*keys).agg(*[F.struct(F.lit(c).alias("variable"), F.count(f"__v{i}").alias("n"), F.percentile(f"__v{i}", told).alias("q")).alias(f"__b{i}") for i, c in enumerate(columns)])
        return held.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], F.inline(F.array(*[F.col(f"__b{i}") for i in range(len(columns))]))).where("n > 0")
    ranked = ranked_values(rows, keys, len(columns), shares) if len(shares) > MANY else bracketed_values(rows, keys, len(columns), shares, sketch)
    value = F.when(F.col("lump"), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(F.col("v"))
    picks = []
    for j, s in enumerate(shares):
        for name, rank in (("a", F.floor(s * (F.col("n") - 1))), ("b", F.ceil(s * (F.col("n") - 1)))):
            picks.append(F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")), value)).alias(f"{name}{j}"))
    one = ranked.groupBy(*keys, "i", "n").agg(*picks)

    def between(j: int, s: float):
        a, b, at = F.col(f"a{j}"), F.col(f"b{j}"), s * (F.col("n") - 1)
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    names = F.array(*[F.lit(c) for c in columns])
    return one.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], names[F.col("i")].alias("variable"), "n", F.array(*[between(j, s) for j, s in enumerate(shares)]).alias("q"))
