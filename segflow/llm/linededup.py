"""Removing lines that many documents share."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflow.llm.shared import WHITE, cut, shielded

_WHITE = WHITE.encode()
#: Distinct lines in the arrays of one shard.
SHARD_KEYS = 50_000
#: Lines in at least so many documents are told to every task instead of being looked up by each.
HEAVY_DOCS = 100_000
#: At most so many of them; there are never more than all lines / HEAVY_DOCS.
HEAVY_KEYS = 1_000_000


def split_lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_digest(line: bytes) -> bytes:
    """128-bit hash of a line's key (stripped of white space, A-Z lower-cased); b"" for an empty key."""
    key = line.strip(_WHITE).lower()
    return xxhash.xxh3_128_digest(key) if key else b""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(high + _mix(low + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash in levels: a key takes the first level where no other key wants its bit.

    A key's index is the number of bits before its own, over all levels. Bit
    tables are twice as long as the keys that reach them.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - bits + total)
            total += int(bits.sum())

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high):
            size = 2 * len(high) + 1
            at = _place(high, low, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            high, low = high[rest], low[rest]
        return cls(levels)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys that were never added (others get any index)."""
        found = np.full(len(high), -1, np.int64)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            open_ = np.flatnonzero(found < 0)
            at = _place(high[open_], low[open_], level, len(bits))
            hit = bits[at]
            found[open_[hit]] = ranks[at[hit]]
        return found

    def to_bytes(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def from_bytes(cls, stored: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(s, np.uint8, offset=8), count=int.from_bytes(s[:8], "little")).astype(bool) for s in stored])


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(high, low, n): in how many rows each line key occurs; summed in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update({d for d in map(line_digest, split_lines(text.as_py())) if d})
                if len(seen) >= 300_000:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    def rows(seen: Counter[bytes]) -> pa.RecordBatch:
        high, low = _longs(list(seen))
        return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(seen.values(), pa.int64())], ["high", "low", "n"])

    return docs.select(text_col).mapInArrow(count, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def count_arrays(counts: DataFrame, shards: int, top: int) -> DataFrame:
    """A row per shard: the perfect hash of its line keys, a 16-bit fingerprint and a count (at most ``top``) by index."""

    def build(part: pa.Table) -> pa.Table:
        high, low = (part.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        index = (hashed := PerfectHash.build(high, low)).index(high, low)
        prints, numbers = np.empty(len(high), "<u2"), np.empty(len(high), "<u2")
        prints[index] = low & np.uint64(0xFFFF)
        numbers[index] = np.minimum(part.column("n").to_numpy(), top)
        return pa.table({"shard": part.column("shard")[:1], "levels": pa.array([hashed.to_bytes()], pa.list_(pa.binary())), "prints": pa.array([prints.tobytes()], pa.binary()), "numbers": pa.array([numbers.tobytes()], pa.binary())})

    return counts.withColumn("shard", F.pmod("high", F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, levels array<binary>, prints binary, numbers binary")


def probes(docs: DataFrame, key_col: str, text_col: str, shards: int, heavy: frozenset[bytes]) -> DataFrame:
    """(shard, high, low, keys): the lines to look up; a batch names each line once, with all rows that hold it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part, held = batch.slice(at, 2000), defaultdict(list)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                    for digest in {d for d in map(line_digest, split_lines(text.as_py())) if d and d not in heavy}:
                        held[digest].append(key)
                if held:
                    high, low = _longs(list(held))
                    yield pa.RecordBatch.from_arrays([pa.array(high % shards), pa.array(high), pa.array(low), pa.array(held.values(), pa.list_(pa.int64()))], ["shard", "high", "low", "keys"])

    return docs.select(key_col, text_col).mapInArrow(ask, "shard long, high long, low long, keys array<long>")


def look_up(asked: DataFrame, arrays: DataFrame, least: int) -> DataFrame:
    """(row_key, digest): the asked lines whose count reaches ``least``."""

    def answer(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        if not asked.num_rows or not arrays.num_rows:
            return pa.table({"row_key": pa.array([], pa.int64()), "digest": pa.array([], pa.binary())})
        stored = {c: arrays.column(c)[0].as_py() for c in ("levels", "prints", "numbers")}
        high, low = (asked.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        index = PerfectHash.from_bytes(stored["levels"]).index(high, low)
        prints, numbers = (np.frombuffer(stored[c], "<u2") for c in ("prints", "numbers"))
        same = (index >= 0) & (prints[index] == (low & np.uint64(0xFFFF)).astype(np.uint16))
        rows = np.flatnonzero(same & (numbers[index] >= least))
        keys = asked.column("keys").take(pa.array(rows)).to_pylist()
        digests = [h.tobytes() + l.tobytes() for h, l in zip(high[rows], low[rows])]
        return pa.table({"row_key": pa.array([k for ks in keys for k in ks], pa.int64()), "digest": pa.array([d for d, ks in zip(digests, keys) for _ in ks], pa.binary())})

    return asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(answer, "row_key long, digest binary")


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Remove every line whose key occurs in at least ``min_docs`` rows.

    A line's key is the line stripped of ASCII white space with A-Z
    lower-cased; empty keys are never removed. Distinct line hashes are counted
    after a partial count in each batch. Each shard of them becomes a minimal
    perfect hash with arrays of fingerprints and counts; the documents' hashes
    (never their lines) are sent to the shards and looked up there. Every line
    looked up was counted before, so the arrays give exact answers; two lines
    are confused only if their 128-bit hashes are equal. Lines in very many
    rows (at most ``HEAVY_KEYS``, as their counts sum to the number of lines)
    are told to all tasks, so no shard gets a row for each such line.

    Returns the table with the remaining lines as ``text_col``, and ``n_lines``
    (before removal) and ``n_dropped``, which replace input columns of these
    names. A null text has one empty line and stays null; null ids are allowed;
    repeated rows count as often as they occur; an empty table gives none.
    """
    if not 1 <= min_docs <= 65535:
        raise ValueError("min_docs must be from 1 to 65535")
    docs, back = shielded(docs, id_col, text_col)
    counts = cut(line_counts(docs, text_col))
    total = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("lines")).first()
    shards, least = 1 + total["keys"] // SHARD_KEYS, max(HEAVY_DOCS, min_docs, (total["lines"] or 0) // HEAVY_KEYS)
    heavy = frozenset(int(r["high"]).to_bytes(8, "little", signed=True) + int(r["low"]).to_bytes(8, "little", signed=True) for r in counts.where(F.col("n") >= least).collect())
    key = "__row_key"
    keyed = docs.drop("n_lines", "n_dropped").withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    hits = look_up(probes(keyed, key, text_col, shards, heavy), count_arrays(counts, shards, max(min_docs, 1)), min_docs)
    dropped = hits.groupBy(F.col("row_key").alias(key)).agg(F.collect_set("digest").alias("__dropped"))
    joined = keyed.join(dropped, key, "left").drop(key)
    kept = [f for f in joined.schema if f.name != "__dropped"]
    schema = T.StructType([*kept, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in kept]
    at_text = names.index(text_col)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                columns = {n: part.column(part.schema.get_field_index(n)) for n in [*names, "__dropped"]}
                texts, lines, lost = [], [], []
                for text, gone in zip(columns[text_col].cast(pa.binary()).to_pylist(), columns["__dropped"].to_pylist()):
                    split = split_lines(text)
                    gone = set(gone or ())
                    keep = [x for x in split if not (d := line_digest(x)) or d not in gone and d not in heavy] if gone or heavy else split
                    texts.append(None if text is None else b"\n".join(keep))
                    lines.append(len(split))
                    lost.append(len(split) - len(keep))
                out = [columns[n] for n in names] + [pa.array(lines, pa.int64()), pa.array(lost, pa.int64())]
                out[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(out, [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(strip, schema).withColumnsRenamed(back)
