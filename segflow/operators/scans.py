"""Order-dependent scans in which one long recording is many tasks.

A scan looks at the rows before a row: the last one, their sum, maximum or
number. A window by recording would sort each recording in one task. Here a
recording with many rows is cut into ranges of its order; every range is
scanned by itself, and what it carries to the next ones (its last row, sum,
maximum and number of rows) is a single row, scanned in turn and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflow.storage import cut

#: Rows of a key that one task scans; keys with more are cut into ranges.
ROWS_PER_RANGE = 1_000_000
#: Most ranges of a key; beyond ROWS_PER_RANGE * MOST_RANGES rows the ranges grow.
MOST_RANGES = 512
#: Hot keys up to which their ranges are broadcast (512 doubles each, 16 MB); more are joined by a shuffle.
BROADCAST_KEYS = 4_096
PART = "__range"


def _position(df: DataFrame, name: str) -> Column:
    """A double that never falls as the column rises: numbers and times themselves, the first six bytes of texts."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys; nulls are one key, as in a window."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _few(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def in_ranges(df: DataFrame, keys: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, bool]:
    """Add ``__range``: -1 for the rows of usual keys, from 0 the number of a range of ``order[0]`` for those of hot ones; and whether there are hot ones.

    Rows are counted by key; only keys beyond ``rows_per_range`` rows get
    ranges, cut at approximate quantiles that are stored, so that every later
    use of them agrees. Rows that tie in ``order[0]`` share a range, and so do
    texts that agree in their first six bytes.
    """
    hot = cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_per_range))
    if hot.isEmpty():
        return df.withColumn(PART, F.lit(-1)), False
    steps = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    rows = df.select(*keys, _position(df, order[0]).alias("__at")).alias("d").join(_few(hot, BROADCAST_KEYS).alias("h"), _same("d", "h", keys))
    edges = rows.groupBy(*[F.col(f"d.{k}").alias(k) for k in keys], "__n").agg(F.percentile_approx("__at", steps, 10_000).alias("__edges"))
    stride = F.greatest(F.lit(1.0), MOST_RANGES * rows_per_range / F.col("__n")).cast("int")
    cuts = cut(edges.select(*keys, F.array_distinct(F.filter("__edges", lambda e, i: (i + 1) % stride == 0)).alias("__edges")))
    joined = df.withColumn("__at", _position(df, order[0])).alias("d").join(_few(cuts, BROADCAST_KEYS).alias("h"), _same("d", "h", keys), "left")
    part = F.when(F.col("__edges").isNull(), -1).when(F.col("__at").isNull(), 0).otherwise(F.size(F.filter("__edges", lambda e: e <= F.col("__at"))))
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in df.columns], part.alias(PART)), True


def carried(df: DataFrame, split: bool, keys: list[str], order: list[str], last: dict[str, str] | None = None, total: dict[str, Column] | None = None, most: dict[str, str] | None = None, count: str | None = None) -> DataFrame:
    """What lies before each row of a key in ``order`` (nulls first), for rows with a ``__range``; ``split`` says whether any key has several.

    ``last`` names columns for the values of the row before, ``total`` for sums
    of the rows before (0 at first; nulls count as 0), ``most`` for their
    maximum (null at first), ``count`` for their number. Rows that tie in all of
    ``order`` follow each other in any order.
    """
    last, total, most = last or {}, {n: F.coalesce(c, F.lit(0)) for n, c in (total or {}).items()}, most or {}
    rows = df.withColumns({f"__in_{n}": c for n, c in total.items()})
    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {"__number": F.row_number().over(inside) - 1, **{f"__last_{n}": F.lag(c).over(inside) for n, c in last.items()}, **{f"__sum_{n}": F.sum(f"__in_{n}").over(before) for n in total}, **{f"__max_{n}": F.max(c).over(before) for n, c in most.items()}}
    scanned = rows.withColumns(local)
    if not split:
        found = [F.col(f"__last_{n}").alias(n) for n in last] + [F.coalesce(F.col(f"__sum_{n}"), F.lit(0)).alias(n) for n in total] + [F.col(f"__max_{n}").alias(n) for n in most]
        return scanned.select(*df.columns, *found, *([F.col("__number").alias(count)] if count else []))
    # One row for each range of a hot key; usual keys carry nothing.
    ends = [F.count("*").alias("__n"), *[F.max_by(c, F.struct(*order)).alias(f"__l_{n}") for n, c in last.items()], *[F.sum(f"__in_{n}").alias(f"__s_{n}") for n in total], *[F.max(c).alias(f"__m_{n}") for n, c in most.items()]]
    ranges = rows.where(F.col(PART) >= 0).groupBy(*keys, PART).agg(*ends)
    along = Window.partitionBy(*keys).orderBy(PART)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"__before": F.sum("__n").over(earlier), **{f"__cl_{n}": F.lag(f"__l_{n}").over(along) for n in last}, **{f"__cs_{n}": F.sum(f"__s_{n}").over(earlier) for n in total}, **{f"__cm_{n}": F.max(f"__m_{n}").over(earlier) for n in most}}
    handed = ranges.withColumns(carry).where(F.col(PART) > 0)
    joined = scanned.alias("r").join(handed.select(*keys, PART, *carry).alias("c"), _same("r", "c", [*keys, PART]), "left")
    first = F.col("r.__number") == 0
    found = [F.when(first, F.col(f"c.__cl_{n}")).otherwise(F.col(f"r.__last_{n}")).alias(n) for n in last]
    found += [(F.coalesce(F.col(f"r.__sum_{n}"), F.lit(0)) + F.coalesce(F.col(f"c.__cs_{n}"), F.lit(0))).alias(n) for n in total]
    found += [F.greatest(F.col(f"r.__max_{n}"), F.col(f"c.__cm_{n}")).alias(n) for n in most]
    if count:
        found.append((F.col("r.__number") + F.coalesce(F.col("c.__before"), F.lit(0))).alias(count))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], *found)


def scan(df: DataFrame, keys: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE, **what: dict | str) -> DataFrame:
    """``carried`` over ``in_ranges``, for a single scan."""
    ranged, split = in_ranges(df, keys, order, rows_per_range)
    return carried(ranged, split, keys, order, **what).drop(PART)
