"""Packing documents into fixed-length training sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.shared import cut
from segflow.llm.tokens import TokenCache, tokenizer_path

#: Rows that one window partition ranks; longer groups of equal lengths are split by hash.
RANK_ROWS = 200_000


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, max_len: int, with_ids: bool) -> DataFrame:
    """Cut every document's ids into pieces of ``max_len`` and one shorter rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = TokenCache.open(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, starts, lengths, sums, totals, held = [], [], [], [], [], []
                for row, raw in enumerate(cache.encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, max_len):
                        ids = raw[4 * start : 4 * (start + max_len)]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(ids) // 4)
                        sums.append(zlib.crc32(ids))
                        totals.append(n)
                        if with_ids:
                            held.append(ids)
                columns = [part.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * with_ids, names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack a histogram of lengths; returns patterns ``(packs, [(length, copies), ...])``.

    Lengths are placed longest first, each into the packs that are shortest so
    far; packs of one pattern are counted, not listed, so the work depends on
    ``max_len`` and not on the number of documents. Where no pack has room, as
    many new packs as needed are opened.
    """
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # filled, tie, packs, pattern
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= max_len:
                filled, _, n, pattern = heapq.heappop(packs)
                used = min(n, left)
                grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
                tie += 1
                heapq.heappush(packs, (filled + length, tie, used, grown))
                if n > used:
                    tie += 1
                    heapq.heappush(packs, (filled, tie, n - used, pattern))
                left -= used
            else:
                each = max_len // length
                for n, copies in ((left // each, each), (1, left % each)):
                    if n and copies:
                        tie += 1
                        heapq.heappush(packs, (length * copies, tie, n, [(length, copies)]))
                left = 0
    return [(n, pattern) for _, _, n, pattern in sorted(packs, key=lambda p: p[:2])]


def pattern_ranges(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where the pieces of each length go, by rank: (length, first rank, end rank, first sequence, copies, offset, filled)."""
    used: dict[int, int] = {}
    ranges, sequence = [], 0
    for n, pattern in patterns:
        offset, filled = 0, sum(length * copies for length, copies in pattern)
        for length, copies in pattern:
            first = used.get(length, 0)
            used[length] = first + n * copies
            ranges.append((length, first, used[length], sequence, copies, offset, filled))
            offset += length * copies
        sequence += n
    return ranges


def ranked(pieces: DataFrame, histogram: dict[int, int], by: list[str]) -> DataFrame:
    """Add ``rank``, gapless from 0 among the pieces of a length; frequent lengths are ranked in several parts."""
    parts = pieces.sparkSession.createDataFrame([(k, 1 + n // RANK_ROWS) for k, n in histogram.items()] or [(0, 1)], "length long, parts long")
    spread = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(*by), "parts"))
    sizes = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(*by)) - 1
    return spread.withColumn("inside", inside).join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("inside")).drop("parts", "part", "inside", "first")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, max_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``max_len`` tokens.

    A document's ids are the tokenizer's, then ``end_id``. Documents beyond
    ``max_len`` are cut into full pieces and a rest. Shortest-pack-first works
    on the histogram of piece lengths (at most ``max_len`` rows, all that the
    driver sees); its patterns are joined back to the pieces by rank.

    Returns a row per piece: the id, ``start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens, padded_tokens`` and, if asked for,
    ``ids`` (little-endian 32-bit). A sequence is padded to ``max_len`` unless
    its tokens are a power of two.

    Null and empty texts give one piece with the end id alone; a null id stays
    null; repeated rows are packed as often as they occur; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, id_col, text_col, tokenizer or tokenizer_path(), end_id, max_len, with_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranges = pattern_ranges(shortest_pack_first(histogram, max_len))
    slots = spark.createDataFrame(ranges or [(0,) * 7], "length long, first long, end long, sequence long, copies long, at long, sequence_tokens long")
    # Ranges: under 2 patterns and 2 * sqrt(max_len) lengths for each length, whatever the input.
    found = ranked(pieces, histogram, [id_col, "start", "ids_crc32"]).join(F.broadcast(slots), "length").where("rank >= first AND rank < end")
    power = F.expr("(sequence_tokens & (sequence_tokens - 1)) = 0")
    return found.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens",
        F.expr("sequence + (rank - first) div copies").alias("sequence_id"),
        F.expr("at + (rank - first) % copies * length").alias("offset"),
        "sequence_tokens", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(max_len).cast("long")).alias("padded_tokens"),
        *["ids"] * with_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., with_ids=True)``; a group is at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id", "sequence_tokens", "padded_tokens").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
