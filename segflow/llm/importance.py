"""Importance resampling towards a target corpus, over hashed word n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.shared import cut, number_rows

#: Bytes of text whose words are held at a time; longer texts are cut between words and carried on.
BLOCK = 1 << 21
#: What every byte becomes before words are split: A-Z in lower case, digits, letters and bytes beyond ASCII as they are, all else a blank.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
ONES = np.uint32(0xFFFFFFFF)


def _byte_steps() -> np.ndarray:
    """What a CRC-32 register becomes of a byte over eight bits of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


STEP = _byte_steps()


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), given by its images of the four bytes, of each value."""
    return matrix[0][values & 0xFF] ^ matrix[1][(values >> 8) & 0xFF] ^ matrix[2][(values >> 16) & 0xFF] ^ matrix[3][values >> 24]


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """The maps of a register over 0 to 63 zero bytes, and over 64 * 2^i of them."""
    maps = [np.stack([np.arange(256, dtype=np.uint32) << (8 * i) for i in range(4)])]
    for _ in range(64):
        maps.append(STEP[maps[-1] & 0xFF] ^ (maps[-1] >> 8))
    large = [maps.pop()]
    for _ in range(24):
        large.append(_times(large[-1], large[-1]))
    return np.stack(maps), np.stack(large)


SMALL, LARGE = _shifts()


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The share of each CRC in that of a text which goes on for ``lengths`` bytes."""
    low = lengths & 63
    found = SMALL[low, 0, crcs & 0xFF] ^ SMALL[low, 1, (crcs >> 8) & 0xFF] ^ SMALL[low, 2, (crcs >> 16) & 0xFF] ^ SMALL[low, 3, crcs >> 24]
    high, bit = lengths >> 6, 0
    while high.any():
        odd = np.nonzero(high & 1)[0]
        found[odd] = _times(LARGE[bit], found[odd])
        high, bit = high >> 1, bit + 1
    return found


def _pieces(normal: bytes) -> Iterator[bytes]:
    """Parts of a normalised text that end at blanks."""
    at = 0
    while at < len(normal):
        end = normal.find(b" ", at + BLOCK)
        end = len(normal) if end < 0 else end
        yield normal[at:end]
        at = end


class Scan:
    """Running CRCs of texts' words, and from them the CRC of every run of 1 to ``n`` words.

    Texts are scanned once, one after the other, as `` word word ...``; the
    running CRC and the byte at the end of each word are stored. The CRC of
    words i to j is the running one at the end of j without that before i,
    shifted over the bytes between; runs across two texts are left out.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        self.own, self.ends, self.crcs, self.lengths = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint32, np.int64))

    def texts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, CRC-32) of the runs, a block at a time."""
        words: list[bytes] = []
        owners, counts, held = [], [], 0
        for number, text in enumerate(texts):
            for piece in _pieces(text.translate(NORMAL)):
                found = piece.split()
                words += found
                owners.append(number)
                counts.append(len(found))
                held += len(piece)
                if held >= BLOCK:
                    yield self.block(words, np.repeat(owners, counts))
                    words, owners, counts, held = [], [], [], 0
        if words:
            yield self.block(words, np.repeat(owners, counts))

    def block(self, words: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs that end in these words; the last ``n`` words are kept for runs that begin in them."""
        crc32, carried = zlib.crc32, len(self.own)
        spaced = [b" " + w for w in words]
        crc, at = (int(self.crcs[-1]), int(self.ends[-1])) if carried else (0, 0)
        new_crcs = np.fromiter(accumulate(spaced, lambda c, w: crc32(w, c), initial=crc), dtype=np.uint32, count=len(spaced) + 1)
        new_lengths = np.fromiter(map(len, spaced), dtype=np.int64, count=len(spaced))
        own, lengths = np.append(self.own, owners), np.append(self.lengths, new_lengths - 1)
        ends, run = np.append(self.ends, at + np.cumsum(new_lengths)), np.append(self.crcs, new_crcs[1:])
        register = np.append(np.uint32(0), run[:-1]) ^ ONES
        before = STEP[(register ^ np.uint32(0x20)) & 0xFF] ^ (register >> 8) ^ ONES  # one blank on
        starts, numbers, found = ends - lengths, [], []
        for size in range(1, self.n + 1):
            j = np.arange(max(carried, size - 1), len(own))
            same = own[j - (size - 1)] == own[j]
            j = j[same]
            i = j - (size - 1)
            numbers.append(own[j])
            found.append(run[j] ^ shift(before[i], ends[j] - starts[i]))
        keep = slice(-self.n, None)  # the first of them only gives the CRC before the next one
        self.own, self.ends, self.crcs, self.lengths = own[keep], ends[keep], run[keep], lengths[keep]
        return np.concatenate(numbers), np.concatenate(found)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, n: int) -> DataFrame:
    """(bucket, count) over all features; a task sends at most a row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, crcs in Scan(n).texts(_texts(batch.column(0))):
                held += np.bincount(crcs % buckets, minlength=buckets)
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "count"])

    each = docs.select(text_col).mapInArrow(count, "bucket long, count long")
    return each.groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, target_text: str, buckets: int, n: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in ``target`` over that in ``docs``: ``buckets`` numbers."""
    ours, theirs = bucket_counts(docs, text_col, buckets, n).withColumnRenamed("count", "s"), bucket_counts(target, target_text, buckets, n).withColumnRenamed("count", "t")
    counts = cut(docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(ours, "bucket", "left").join(theirs, "bucket", "left").na.fill(0, ["s", "t"]))
    d = lambda name: F.col(name).cast("double")
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    gains = np.zeros(buckets, dtype=np.int64)
    for r in counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():  # totals: one row
        gains[r["bucket"]] = r["gain"]
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str, n: int) -> DataFrame:
    """Add ``n_features`` and ``weight``, the sum of the gains of all features; the text is dropped."""
    rest, buckets = [c for c in docs.columns if c != text_col], len(gains)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            features, weight = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            for own, crcs in Scan(n).texts(_texts(batch.column(len(rest)))):
                gained = gains[crcs % buckets]
                features += np.bincount(own, minlength=size)
                np.add.at(weight, own, gained)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(features), pa.array(weight)], names=[*rest, "n_features", "weight"])

    types = ", ".join(f"`{c}` {t}" for c, t in docs.select(rest).dtypes)
    return docs.select(*rest, text_col).mapInArrow(add, f"{types}, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, min_words: int = 20, buckets: int = 10_000, n: int = 3, seed: int = 42
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, by importance weight, without replacement.

    Features are runs of 1 to ``n`` words (``Scan``), hashed into ``buckets`` by
    their CRC-32. A document's weight is the sum of its features' gains, the
    log-ratios of the bucket's share in ``target`` and in ``docs``; Gumbel noise
    from a hash of the id makes the highest scores a draw. Counts are at most
    ``buckets`` rows a task, and all that the driver holds are the gains.

    Returns (id, n_features, weight, score, rank): rank from 1 by falling score,
    equal ones by id, null for documents that are not drawn. Null and empty
    texts have no features and weight 0; a null id hashes as empty text and
    comes last among equals; repeated rows are drawn each for itself; other
    columns are ignored; an empty table gives none, an empty target leaves
    smoothed shares.
    """
    gains = bucket_gains(docs, target, text_col, target_text, buckets, n)
    weighed = weigh(docs.select(id_col, F.col(text_col).alias("__text")), gains, "__text", n)
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = cut(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(noise)))))
    # A text of w words has, of each length up to n that is at most w, w + 1 - length features.
    long_enough = F.col("n_features") >= sum(max(min_words + 1 - length, 0) for length in range(1, n + 1))
    drawn = scored.where(long_enough).count() * percent // 100
    ranked = number_rows(scored.where(long_enough), [F.desc("score"), F.asc_nulls_last(id_col)], "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    columns = [id_col, "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank")))
