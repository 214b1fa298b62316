"""A linear classifier of toxic texts on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflow.llm import tokens
from segflow.llm.shared import cut

SIZES = (3, 4, 5)
#: Buckets that n-grams are hashed to.
BITS = 20
#: Labelled rows to learn from, chosen by a hash of their ids; the bound of what the driver gathers.
SAMPLE_ROWS = 20_000
#: Least deviations of a log-count ratio from zero; the level that ranks left-out rows best is chosen, on so many folds of the sample.
LEVELS, FOLDS = (1.5, 2.0, 3.0, 4.0), 3
#: Toxic rows from which on an n-gram of a single text needs the second level.
ENOUGH = 50
#: Places that are looked up at once when runs are summed: small enough to stay in a core's cache.
CHUNK = 1 << 14
#: Rounds of the regression, and of those that only compare levels.
ROUNDS, TRIAL_ROUNDS = 300, 100


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every character n-gram of the whole text, in lower case, white space as one blank."""
    codes = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found, grown = [], codes * np.uint32(0x9E3779B1)
    for size in range(2, max(SIZES) + 1):
        grown = (grown[:-1] ^ (grown[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[size - 1 :] * np.uint32(0xC2B2AE3D)
        if not len(grown):
            break
        if size in SIZES:
            found.append(((grown ^ (grown >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """``weights`` by bucket (0: not used) and the bias."""

    weights: np.ndarray
    bias: float

    def logit(self, text: str | None) -> float:
        at = buckets(text)
        at = at[self.weights[at] != 0]
        return float(self.bias + self.weights[np.unique(at)].sum())


def gram_counts(labelled: DataFrame, text_col: str, label_col: str, fold_col: str) -> np.ndarray:
    """(fold, label, bucket): in how many labelled texts of each kind, of each fold, a bucket occurs.

    A task sends a row for each fold and bucket that it meets; a row's two
    counts, each within the sample's bound, travel as one number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        both = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                both[fold, label, np.unique(buckets(text))] += 1
        fold, at = np.nonzero(both.any(1))
        yield pa.RecordBatch.from_arrays([pa.array((fold << BITS) + at), pa.array((both[fold, 1, at].astype(np.int64) << 32) + both[fold, 0, at])], ["at", "both"])

    some = labelled.select(text_col, F.col(label_col).cast("int"), fold_col)
    told = some.mapInArrow(count, "at long, both long").groupBy("at").agg(F.sum("both").alias("both")).toArrow()  # FOLDS * 2^BITS numbers at most
    at, both = (told.column(c).to_numpy() for c in ("at", "both"))
    counts = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
    counts[at >> BITS, 1, at & (1 << BITS) - 1], counts[at >> BITS, 0, at & (1 << BITS) - 1] = both >> 32, both & 0xFFFFFFFF
    return counts


def gram_ratios(counts: np.ndarray, sizes: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, z) of every bucket without the fold ``left_out`` (FOLDS: of all): its log-count ratio, and how many deviations that is from 0.

    A count of each kind is raised by the share of its kind, so a bucket that
    neither holds has ratio 0. ``sizes`` has the rows of each (fold, label).
    Where toxic rows are many, n-grams of one text are not evidence of the
    first level: nearly all that reach it are of that kind.
    """
    kept = np.arange(FOLDS) != left_out
    (all_clean, all_toxic), (clean, toxic) = sizes[kept].sum(0), counts[kept].sum(0)
    share = all_toxic / (all_toxic + all_clean)
    ratio = np.log((toxic + share) / all_toxic) - np.log((clean + 1 - share) / all_clean)
    z = np.where(toxic + clean > 0, np.abs(ratio) / np.sqrt(1 / (toxic + share) + 1 / (clean + 1 - share)), 0.0)
    alone = (toxic + clean == 1) & (z < LEVELS[1]) & (all_toxic >= ENOUGH)
    return np.where(toxic + clean > 0, ratio, 0.0), np.where(alone, 0.0, z)


@dataclass
class Grams:
    """The buckets to learn from without a fold, in the order of falling evidence: ``place`` of each bucket in it (-1: none), their ratios, and how many reach each level."""

    buckets: np.ndarray
    ratios: np.ndarray
    firsts: list[int]
    place: np.ndarray


def gram_order(ratio: np.ndarray, z: np.ndarray) -> Grams:
    chosen = np.flatnonzero(z >= LEVELS[0])
    chosen = chosen[np.lexsort((chosen, -z[chosen]))]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    return Grams(chosen, ratio[chosen], [int((z >= level).sum()) for level in LEVELS], place)


def ranking(logits: np.ndarray, labels: np.ndarray) -> float:
    """The share of pairs of a toxic and a clean row that are in order, ties by half."""
    order = np.sort(logits)
    ranks = (np.searchsorted(order, logits) + np.searchsorted(order, logits, "right") + 1) / 2
    toxic = labels.sum()
    return float((ranks[labels == 1].sum() - toxic * (toxic + 1) / 2) / (toxic * (len(labels) - toxic)))


#: Whole rows whose features are looked up at once: the features one after the other, and where each row ends.
Block = tuple[np.ndarray, np.ndarray]


def blocks(features: np.ndarray, ends: np.ndarray) -> list[Block]:
    """Rows in blocks of CHUNK features, or of one longer row; nothing is copied."""
    found, first = [], 0
    while first < len(ends):
        start = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        found.append((features[start : int(ends[last - 1])], ends[first:last] - start))
        first = last
    return found


def run_sums(table: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of ``table[at]`` over each run, given where the runs end; CHUNK places or one run are looked up at once."""
    found, first = np.zeros(len(ends), table.dtype), 0
    for held, own in blocks(at, ends):
        sizes = np.diff(own, prepend=0)
        some = np.flatnonzero(sizes)
        if len(some):
            found[first + some] = np.add.reduceat(table.take(held), (own - sizes)[some])
        first += len(own)
    return found


def sorted_pairs(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of numbers from 0 on, sorted by both; in place, as one column of 64 bits."""
    bits = int(minor.max(initial=0)).bit_length()
    joined = major.astype(np.int64)
    joined <<= bits
    joined |= minor
    joined.sort()
    second = (joined & ((1 << bits) - 1)).astype(np.int32)
    joined >>= bits
    return joined.astype(np.int32), second


def below(block: Block, most: int) -> Block:
    """A block without the features from ``most`` on, where it lies."""
    features, ends = block
    inside = features < most
    kept = features[: np.count_nonzero(inside)]
    kept[:] = features[inside]
    return kept, np.append(0, np.cumsum(inside))[ends]


def row_sums(parts: list[Block], table: np.ndarray) -> np.ndarray:
    """The sum of ``table`` over each row's features."""
    return np.concatenate([np.zeros(0), *[run_sums(table, features, ends) for features, ends in parts]])


def feature_sums(parts: list[Block], by_row: np.ndarray, features: int) -> np.ndarray:
    """The sum of ``by_row`` over the rows that have each feature."""
    found, at = np.zeros(features), 0
    for held, ends in parts:
        np.add.at(found, held, np.repeat(by_row[at : at + len(ends)], np.diff(ends, prepend=0)))
        at += len(ends)
    return found


def fit_blocks(parts: list[Block], labels: np.ndarray, ratios: np.ndarray, rounds: int = ROUNDS, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled presence of features, by full-batch Adam; returns weight times ratio, and the bias.

    Every round reads the blocks where they lie, so beside them it holds a few numbers for each row, each feature and one block's places.
    """
    rows, total = len(labels), max(len(ratios), 1)
    weights = np.append(np.zeros(len(ratios)), np.log((labels.sum() + 0.5) / (rows - labels.sum() + 0.5)))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        logits = row_sums(parts, weights[:-1] * ratios) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / rows
        slope = np.append(ratios * feature_sums(parts, error, len(ratios)) + penalty / total**0.5 * weights[:-1], error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:-1] * ratios, float(weights[-1])


def fit_weights(features: np.ndarray, ends: np.ndarray, labels: np.ndarray, ratios: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """``fit_blocks`` of rows whose features lie one after the other; ``ends``: where each row ends."""
    return fit_blocks(blocks(features, ends), labels, ratios, rounds)


def packed(rows: list[np.ndarray]) -> list[bytes]:
    """Each row's rising places as bytes: the steps from one to the next, 255 for each 255 in a step, then what is left of it."""
    found = []
    for places in rows:
        step = np.diff(places, prepend=0)
        ends = np.cumsum(step // 255 + 1)
        told = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
        told[ends - 1] = step % 255
        found.append(told.tobytes())
    return found


def unpacked(rows: pa.BinaryArray) -> list[Block]:
    """The places of ``packed`` rows, as blocks of one array: many small ones would not go back to the system when they are done with."""
    parts = [rows.slice(at, 200) for at in range(0, len(rows), 200)]
    told_of = lambda some: np.frombuffer(b"".join(some.to_pylist()), np.uint8)
    every, at, found = np.empty(sum(int(np.count_nonzero(told_of(p) != 255)) for p in parts), np.int32), 0, []
    for some in parts:
        told, ends = told_of(some), np.cumsum(pc.binary_length(some).to_numpy(), dtype=np.int64)
        whole, last = np.append(0, np.cumsum(told, dtype=np.int64)), np.flatnonzero(told != 255)
        row_ends = np.searchsorted(last, ends)
        places = whole[last + 1] - np.repeat(whole[np.append(0, ends[:-1])], np.diff(row_ends, prepend=0))
        own = every[at : at + len(places)]
        own[:] = places
        found += blocks(own, row_ends)
        at += len(places)
    return found


def _features(sample: DataFrame, grams: dict[int, Grams]) -> DataFrame:
    """(left_out, id, features, label, fold): every row's places in the order of each fold's buckets, ``packed``."""
    orders = {k: g.place for k, g in grams.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            own = [np.unique(buckets(t)) for t in batch.column(1).to_pylist()]
            for k, place in orders.items():
                held = pa.array(packed([np.sort((x := place[g])[x >= 0]) for g in own]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int64)), batch.column(0), held, batch.column(2), batch.column(3)], ["left_out", "id", "features", "label", "fold"])

    kind = sample.schema["__id"].dataType.simpleString()
    return sample.select("__id", "__text", F.col("__label").cast("int"), "__fold").mapInArrow(find, f"left_out long, id {kind}, features binary, label int, fold int")


def regressions(sample: DataFrame, grams: dict[int, Grams], levels: list[int], rounds: int) -> pd.DataFrame:
    """(left_out, level, kind, at, value) of the models without each fold: the left-out rows' labels (kind 0) and logits (1), or, of all rows, weights (2, by place) and bias (3).

    A task has the sample's rows once, with the places of one fold's buckets, in
    the order of their ids, left-out rows last.
    """
    told = {k: (g.firsts, g.ratios) for k, g in grams.items()}

    def run(key: tuple, part: pa.Table) -> pa.Table:
        tokens.forget()
        left_out = key[0].as_py()
        firsts, ratios = told[left_out]
        labels = part.column("label").to_numpy().astype(float)
        learnt = int((part.column("fold").to_numpy() != left_out).sum())
        parts: tuple[list[Block], list[Block]] = [], []
        for kind, rows in enumerate((part.slice(0, learnt), part.slice(learnt))):
            for chunk in rows.column("features").chunks:
                parts[kind].extend(unpacked(chunk))
        learn, own = parts
        found = []
        for level in levels:
            most = firsts[level]
            for held in parts if most < len(ratios) else ():
                for i, block in enumerate(held):
                    held[i] = below(block, most)  # levels rise, so what a level leaves out the next one does too
            weights, bias = fit_blocks(learn, labels[:learnt], ratios[:most], rounds)
            if left_out < FOLDS:
                kinds = [(0, labels[learnt:]), (1, row_sums(own, weights) + bias)]
            else:
                kinds = [(2, weights), (3, np.array([bias]))]
            found += [pa.table({"left_out": np.full(len(v), left_out), "level": np.full(len(v), level), "kind": np.full(len(v), k), "at": np.arange(len(v)), "value": v.astype(float)}) for k, v in kinds]
        return pa.concat_tables(found)

    ordered = _features(sample, grams).repartition("left_out").sortWithinPartitions("left_out", F.col("fold") == F.col("left_out"), "id", F.xxhash64("features"))
    return ordered.groupBy("left_out").applyInArrow(run, "left_out long, level long, kind long, at long, value double").toPandas()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows, chosen by a hash of their ids.

    N-gram counts and their log-count ratios are Spark aggregates over these
    rows. How firm a ratio must be is not fixed, as that would leave no n-grams
    where labels are few: for every level and fold, counts, ratios and the
    regression are made without the fold, and the level that ranks the left-out
    rows best (a mean over folds; the lowest one that is worse by no more than
    half a toxic row's share, which folds cannot tell apart) makes the model of
    all rows. Each regression is one task over the bounded rows; the driver
    holds numbers by bucket and a logit for each row and level. Rows without a
    label or an id are left out; several labels of an id count as toxic if one
    is. Without both kinds of labels, the score is the share of toxic labels for
    every text.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = given.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "__id")), "__id")
    bounded = rows.orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text")).limit(sample_rows)  # an id may have several rows
    fold = F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).cast("int")
    sample = cut(bounded.withColumn("__fold", fold).repartitionByRange(32, "__fold", F.xxhash64("__id")))
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("__fold", "__label").count().collect():
        sizes[r["__fold"], int(r["__label"])] = r["count"]
    clean, toxic = sizes.sum(0)
    weights = np.zeros(1 << BITS)
    if not toxic or not clean:
        share = min(max(toxic / max(toxic + clean, 1), 1e-6), 1 - 1e-6)
        return Model(weights, float(np.log(share / (1 - share))))
    counts = gram_counts(sample, "__text", "__label", "__fold")
    # Folds without both kinds of labels on both sides say nothing about a level.
    fair = [k for k in range(FOLDS) if sizes[k].min() > 0 and (sizes.sum(0) - sizes[k]).min() > 0]
    best = 0
    if fair:
        tried = regressions(sample, {k: gram_order(*gram_ratios(counts, sizes, k)) for k in fair}, list(range(len(LEVELS))), TRIAL_ROUNDS)
        reached: dict[int, list[float]] = {}
        for (level, _), own in tried.groupby(["level", "left_out"]):
            by_kind = {k: v.sort_values("at")["value"].to_numpy() for k, v in own.groupby("kind")}
            reached.setdefault(level, []).append(ranking(by_kind[1], by_kind[0]))
        mean = {level: float(np.mean(r)) for level, r in reached.items()}
        best = min(level for level, m in mean.items() if m >= max(mean.values()) - 0.5 / toxic)
    every = gram_order(*gram_ratios(counts, sizes, FOLDS))
    whole = regressions(sample, {FOLDS: every}, [best], ROUNDS)
    scaled = whole[whole.kind == 2].sort_values("at")["value"].to_numpy()
    weights[every.buckets[: len(scaled)]] = scaled
    return Model(weights, float(whole[whole.kind == 3]["value"].iloc[0]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); they replace input columns of these names.

    Only whole texts decide. Null and empty texts get the bias's score; other
    columns, null ids and repeated rows pass through.
    """
    kept = docs.drop("score", "predicted")
    names = kept.columns
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rated = 1 / (1 + np.exp(-np.clip([model.logit(t) for t in part.column(names.index(text_col)).to_pylist()], -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rated), pa.array((rated >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(rate, schema)
