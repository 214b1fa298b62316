"""Labelled time intervals: joins, merges, tiers, windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.scans import ROWS_PER_RANGE, carried, in_ranges, scan


def valid_intervals(df: DataFrame, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    return df.where(F.col(end) > F.col(start))


def clamp_intervals(df: DataFrame, low: float, high: float, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    clamped = df.withColumns({start: F.greatest(F.col(start), F.lit(low)), end: F.least(F.col(end), F.lit(high))})
    return valid_intervals(clamped, start, end)


#: An interval's level is the least power of this base that is no shorter; coarser steps mean fewer rows for each and more pairs to test.
LEVEL_BASE = 4.0


def _level(start: Column, end: Column) -> Column:
    return F.greatest(F.ceil(F.log(end - start) / math.log(LEVEL_BASE)), F.lit(-20)).cast("int")


def _cells(rows: DataFrame, side: str, start: str, end: str, raised_to: Column, own_kind: str, raised_kind: str) -> DataFrame:
    """The rows with every (kind, level, bin) in which they look for partners: their own level's, and those of ``raised_to``."""
    width = lambda level: F.pow(F.lit(LEVEL_BASE), level)
    bins = lambda level: F.sequence(F.floor(F.col(f"{side}.{start}") / width(level)), F.floor(F.col(f"{side}.{end}") / width(level)))
    cells = lambda kind, level: F.transform(bins(level), lambda b: F.struct(F.lit(kind).alias("kind"), level.alias("level"), b.alias("bin")))
    raised = F.flatten(F.transform(raised_to, lambda level: cells(raised_kind, level)))
    return rows.withColumn("__cell", F.explode(F.concat(cells(own_kind, F.col("__level")), raised)))


def overlap_pairs(left: DataFrame, right: DataFrame, by: list[str], least: float, start: str, end: str) -> DataFrame:
    """Pairs of overlapping intervals as (by..., l struct, r struct, start, end).

    An interval belongs to the level of its own length, whose bins are at least
    as wide, so it meets two of them at most. A pair meets at the longer one's
    level: the longer interval looks there under its own bins, the shorter one
    is raised to the levels that occur on the other side (one short list for a
    side, a scalar subquery). Neither a bin width is asked for, nor does a
    day-long interval become a row for each minute; an interval makes at most
    two rows a level. A pair is kept only in the bin of its later start, so no
    ``distinct`` follows. Empty and null intervals have no partners.
    """
    level = _level(F.col(start), F.col(end))
    valid = {"l": left.where(F.col(end) > F.col(start)), "r": right.where(F.col(end) > F.col(start))}
    levels = {s: df.agg(F.array_sort(F.collect_set(level))).scalar() for s, df in valid.items()}
    sides = {s: df.select(*by, F.struct(*df.columns).alias(s), level.alias("__level"), levels["lr".replace(s, "")].alias("__others")) for s, df in valid.items()}
    # "down": the right one is longer or as long; "up": the left one is longer.
    a = _cells(sides["l"], "l", start, end, F.filter("__others", lambda x: x >= F.col("__level")), "up", "down").drop("__level", "__others")
    b = _cells(sides["r"], "r", start, end, F.filter("__others", lambda x: x > F.col("__level")), "down", "up").drop("__level", "__others")
    first, last = F.greatest(f"l.{start}", f"r.{start}"), F.least(f"l.{end}", f"r.{end}")
    here = F.floor(first / F.pow(F.lit(LEVEL_BASE), F.col("__cell.level")))
    joined = a.join(b, [*by, "__cell"]).where((F.col("__cell.bin") == here) & (first < last) & (last - first >= least))
    return joined.select(*by, "l", "r", first.alias("start"), last.alias("end"))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], least: float = 0.0, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """The left rows' intersections with the right intervals of at least ``least`` seconds.

    All overlapping pairs are found, also where left intervals overlap each
    other. Left columns stay; start and end are those of the intersection.
    """
    kept = [c for c in left.columns if c not in (*by, start, end)]
    return overlap_pairs(left, right, by, least, start, end).select(*by, *[F.col(f"l.{c}").alias(c) for c in kept], F.col("start").alias(start), F.col("end").alias(end))


def pairwise_overlaps(df: DataFrame, by: list[str], speaker: str, row_id: str, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Overlaps of two intervals with different speakers, the earlier one first: both ids and speakers, start, end and duration."""
    one = df.select(*by, speaker, row_id, start, end)
    pairs = overlap_pairs(one, one, by, 0.0, start, end)
    order = lambda s: F.struct(f"{s}.{start}", f"{s}.{end}", f"{s}.{row_id}")
    kept = pairs.where((order("l") < order("r")) & (F.col(f"l.{speaker}") != F.col(f"r.{speaker}")))
    return kept.select(*by, F.col(f"l.{row_id}").alias("first_id"), F.col(f"r.{row_id}").alias("second_id"), F.col(f"l.{speaker}").alias("first_speaker"), F.col(f"r.{speaker}").alias("second_speaker"), F.col("start").alias("overlap_start"), F.col("end").alias("overlap_end"), (F.col("end") - F.col("start")).alias("overlap_sec"))


def overlap_coverage(segments: DataFrame, main: DataFrame, by: list[str], row_id: str, share: float = 0.5, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Segments of which the main intervals cover at least ``share``; all segments of a group where none is."""
    covered = overlap_pairs(segments.select(*by, row_id, start, end), main.select(*by, start, end), by, 0.0, start, end).groupBy(*by, F.col(f"l.{row_id}").alias(row_id)).agg(F.sum(F.col("end") - F.col("start")).alias("covered_sec"))
    joined = segments.join(covered, [*by, row_id], "left").withColumn("covered_sec", F.coalesce("covered_sec", F.lit(0.0)))
    flagged = joined.withColumn("__kept", F.col("covered_sec") >= share * (F.col(end) - F.col(start)))
    any_kept = flagged.groupBy(*by).agg(F.bool_or("__kept").alias("__any"))
    return flagged.join(any_kept, by).where("__kept OR NOT __any").drop("__kept", "__any")


def merge_groups(df: DataFrame, keys: list[str], group: str, start: str = "start_sec", end: str = "end_sec", row_id: str | None = None) -> DataFrame:
    """One interval for each group, with the number of its rows and, if asked for, their sorted ids."""
    listed = [F.array_sort(F.collect_list(row_id)).alias("orig_rows")] if row_id else []
    merged = df.groupBy(*keys, group).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"), *listed)
    return merged.withColumn("duration_sec", F.col(end) - F.col(start))


def merge_close(df: DataFrame, keys: list[str], gap: float = 0.5, start: str = "start_sec", end: str = "end_sec", row_id: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Merge rows of a key that follow the row before them by 0 to ``gap`` seconds; rows that overlap it stay apart.

    Two carried scans in the order of start and end: the end of the row before,
    then the number of groups begun so far.
    """
    ranged, split = in_ranges(df, keys, [start, end], rows_per_range)
    flagged = carried(ranged, split, keys, [start, end], last={"__end": end}).withColumn("__new", F.when((F.col(start) - F.col("__end")).between(0, gap), 0).otherwise(1))
    grouped = carried(flagged, split, keys, [start, end], total={"__begun": F.col("__new")}).withColumn("group_id", F.col("__begun") + F.col("__new"))
    return merge_groups(grouped, keys, "group_id", start, end, row_id)


def flags_to_regions(frames: DataFrame, by: list[str], frame: str, flag: str, frame_length: int, rate: int, least_ms: float = 0.0, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Runs of true frames as regions in seconds, those shorter than ``least_ms`` left out."""
    numbered = scan(frames.where(F.col(flag)).select(*by, frame), by, [frame], rows_per_range, count="__number")
    runs = numbered.groupBy(*by, (F.col(frame) - F.col("__number")).alias("__island")).agg(F.min(frame).alias("first"), F.max(frame).alias("last"))
    step = frame_length / rate
    regions = runs.select(*by, (F.col("first") * step).alias("start_sec"), ((F.col("last") + 1) * step).alias("end_sec"))
    return regions.where((F.col("end_sec") - F.col("start_sec")) * 1000 >= least_ms)


def combined_offsets(df: DataFrame, by: list[str], order: list[str], duration: str, gap: float = 0.0, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Place parts one after the other: ``source_index`` from 0, start and end in the joined recording."""
    placed = scan(df, by, order, rows_per_range, total={"combined_start": (F.col(duration) + gap).cast("double")}, count="source_index")
    return placed.withColumn("combined_end", F.col("combined_start") + F.col(duration))


def class_stream_offsets(df: DataFrame, by: list[str], label: str, gap: float = 0.15, rate: int = 16000, start: str = "start_sec", end: str = "end_sec", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each class's segments as one stream: where a segment lies in it, in whole samples; empty ones are left out."""
    length = (F.bround(F.col(end) * rate) - F.bround(F.col(start) * rate)) / rate
    rows = df.withColumn("__length", length).where("__length > 0")
    placed = combined_offsets(rows, [*by, label], [start, end], "__length", gap, rows_per_range)
    return placed.withColumnsRenamed({"combined_start": "stream_start", "combined_end": "stream_end"}).drop("__length", "source_index")


def non_overlap(df: DataFrame, by: list[str], start: str = "start_sec", end: str = "end_sec", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """A tier without overlaps: a row starts no earlier than those before it end; what is left empty is dropped."""
    scanned = scan(df, by, [start, end], rows_per_range, most={"__before": end})
    return valid_intervals(scanned.withColumn(start, F.greatest(start, "__before")).drop("__before"), start, end)


def chunks(df: DataFrame, duration: str, chunk: float = 900.0, overlap: float = 10.0) -> DataFrame:
    """Overlapping chunks of each recording; the last one ends with it."""
    if chunk <= overlap:
        raise ValueError("a chunk must be longer than the overlap")
    step, long = chunk - overlap, F.col(duration)
    n = F.lit(1) + F.greatest(F.lit(0), F.ceil((long - chunk) / step))
    each = df.where(long > 0).withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return each.withColumn("chunk_start", F.col("chunk_id") * step).withColumn("chunk_end", F.least(F.col("chunk_start") + chunk, long))


def sliding_windows(df: DataFrame, window: float, hop: float, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Windows every ``hop`` seconds, one more at the end where they stop short of it; a short segment has one."""
    length = F.col(end) - F.col(start)
    last = F.floor((length - window) / hop + 1e-9)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda i: F.col(start) + i * hop)
    tail = F.when((length > window) & (last * hop + window < length - 1e-9), F.array(F.col(end) - window)).otherwise(F.array().cast("array<double>"))
    each = df.withColumn("window_start", F.explode(F.concat(starts, tail)))
    return each.withColumn("window_end", F.col("window_start") + window).withColumn("weight", F.lit(window))


def cap_total(df: DataFrame, by: list[str], most: float, gap: float = 0.0, start: str = "start_sec", end: str = "end_sec", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Segments in time order until their lengths and gaps pass ``most`` seconds for the first time."""
    length = F.col(end) - F.col(start)
    scanned = scan(df, by, [start, end], rows_per_range, total={"__before": (length + gap).cast("double")})
    return scanned.withColumn("cumulative_sec", F.col("__before") + length).drop("__before").where(F.col("cumulative_sec") <= most)
