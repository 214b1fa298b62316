"""Near-duplicate documents by SimHash, found in a space of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.llm.components import components, fold
from segflow.llm.shared import checked_broadcast, cut, shielded

SEED = 42
#: Bits of a segment; its bit count is 0, 1 or 2.
SEGMENT = 2
_LOW = 0x5555555555555555
#: Rows that one task compares in a bucket of grid cells; larger cells are split into pairs of parts.
BUCKET_ROWS = 100_000
CELL_ROWS = 4_000
#: Grid cells are made finer until a fingerprint meets at most so many others by chance.
CHANCE_PARTNERS = 1_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included; of all words if there are fewer; none without words."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(split) <= words:
        return np.array([hashed(b" ".join(split), SEED)], np.uint64)
    whole = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts, ends = [0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist()
    return np.array([hashed(whole[a:z], SEED) for a, z in zip(starts, ends)], np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """64 bits: those set in over half of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed 64-bit number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(read, f"`{id_col}` {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of all segments in one number, a count of 0, 1 or 2 written as 00, 01 or 11.

    In this form the differing bits of two embeddings are the Manhattan
    distance of the counts, which is at most the fingerprints' distance.
    """
    shifted = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(shifted).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(shifted).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(blocks: int, radius: int) -> list[int]:
    """Projections of the counts: a pair within ``radius`` spoils at most ``radius`` blocks of segments, so it agrees on all blocks of one of them."""
    segments = 64 // SEGMENT
    edges = [segments * b // blocks * SEGMENT for b in range(blocks + 1)]
    bits = [sum(1 << i for i in range(a, z)) for a, z in zip(edges, edges[1:])]
    masks = [sum(bits[b] for b in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, radius: int) -> int:
    """Blocks whose cells hold few fingerprints by chance: two random counts of a segment agree with probability 3/8."""
    for blocks in range(radius + 2, radius + 7):
        if comb(blocks, radius) * rows * 0.375 ** (32 * (blocks - radius) / blocks) <= CHANCE_PARTNERS:
            return blocks
    return radius + 7


def linked(fps: np.ndarray, counts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within a cell (rows are sorted by cell, ``ends`` has the end of each row's cell) that differ in at most ``radius`` bits."""
    at = np.arange(len(fps))
    step = 0
    while len(at := at[at + step + 1 < ends[at]]):
        step += 1
        near = at[np.bitwise_count(counts[at] ^ counts[at + step]) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        if len(near):
            yield near, near + step


def dealt(placed: DataFrame, kept: list[str], rows: int, cell_rows: int) -> DataFrame:
    """(kept..., cell, bucket): rows by cell, dealt to buckets of cells of about BUCKET_ROWS.

    A cell of over ``cell_rows`` is dealt as pairs of parts, each a cell of its
    own, so no task holds all of it and every two of its rows still meet. Its
    rows are repeated for that, and the number of buckets grows with them.
    ``rows`` is the number of rows of ``placed``.
    """
    counted = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    crowded = cut(counted.withColumn("parts", F.ceil(F.col("n") / (cell_rows / 2))))
    repeated = rows + (crowded.agg(F.sum(F.col("n") * (F.col("parts") - 1))).first()[0] or 0)
    parts = checked_broadcast(crowded.select("cell", "parts"))
    split = placed.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("point"), "parts"))
    paired = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    group = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return paired.select(*kept, group.alias("cell")).withColumn("bucket", F.pmod("cell", F.lit(1 + repeated // BUCKET_ROWS)))


def forest(point: np.ndarray, cell: np.ndarray, fps: np.ndarray, radius: int) -> pa.Table:
    """(a, b): links of each point to the least of its group, after comparing the rows of every cell (rows are sorted by cell)."""
    _, starts, sizes = np.unique(cell, return_index=True, return_counts=True)
    ends = np.repeat(starts + sizes, sizes)
    half = np.uint64(_LOW)
    counts = ((fps | fps >> np.uint64(1)) & half) | ((fps & fps >> np.uint64(1) & half) << np.uint64(1))
    nodes, place = np.unique(point, return_inverse=True)
    root, held, n = np.arange(len(nodes)), [], 0
    for a, b in linked(fps, counts, ends, radius):
        held.append((place[a], place[b]))
        n += len(a)
        if n > 500_000:
            root, held, n = fold(root, held), [], 0
    root = fold(root, held)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[moved]), "b": pa.array(nodes[root[moved]])})


def close_pairs(points: DataFrame, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, as few as keep each cell's linked groups together.

    A grid range join: every fingerprint is put into the cells of all
    projections, cells are compared under the Manhattan distance, and what
    passes is verified bit by bit.
    """
    rows = points.count()
    masks = grid_masks(blocks_for(rows, radius), radius)
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    placed = points.select("fp", embedding(F.col("fp")).alias("counts")).select(F.col("fp").alias("point"), F.explode(cells).alias("cell"))

    def compare(part: pa.Table) -> pa.Table:
        cell, point = part.column("cell").to_numpy(), part.column("point").to_numpy()
        order = np.argsort(cell, kind="stable")
        return forest(point[order], cell[order], point[order].view(np.uint64), radius)

    return dealt(placed, ["point"], rows * len(masks), cell_rows).groupBy("bucket").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked through at most ``radius`` differing bits.

    Returns a row per document: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that links reach, its own included.

    Equal fingerprints are one point; points are compared in a grid of segment
    bit counts (see ``close_pairs``), links are folded to components by
    repeated joins, and the driver sees none of them. Null, empty and blank
    texts have the fingerprint 0; null ids never name a group unless all of its
    ids are null; repeated rows stay; an empty table gives none; other columns
    are ignored.
    """
    printed = cut(fingerprints(docs, id_col, text_col, words))
    points = cut(printed.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(close_pairs(points, radius))
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = rooted.join(named, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return printed.join(of_point, "fp").select(id_col, digits.alias("fingerprint"), "component_id")


#: Anchors of a text: its least shingle hashes. Texts of similarity s share none with probability about (1 - s) ** ANCHORS.
ANCHORS = 6
#: Bins of the sketch that filters pairs before their shingles are compared.
BINS = 128
#: Bits in which fingerprints of similar texts may differ: 0.8 makes about 10 of 64, 12 in the shortest texts, with a deviation of 3.
SIMILAR_BITS = 26
#: How far a sketch (deviation 0.035 near 0.8) may fall short of the similarity asked for.
SLACK = 0.2
#: Bytes of shingle hashes that one task holds.
BUCKET_BYTES = 32 << 20


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprint, anchors, bins): a bin has one byte of the least hash that falls into it, 0 for none."""
    if not len(hashes):
        return 0, np.zeros(1, np.int64), np.zeros(BINS, np.uint8)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])
    own = np.unique(hashes)
    bins, first = np.unique(own >> np.uint64(57), return_index=True)
    held = np.zeros(BINS, np.uint8)
    held[bins] = own[first] % np.uint64(255) + np.uint64(1)
    return fp, own[:ANCHORS].view(np.int64), held


def text_key(text: str | None) -> int:
    """A signed 64-bit number for the text's words; 0 without words."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(split))).view(np.int64)) if split else 0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def sketch_pairs(fps: np.ndarray, bins: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within a cell whose fingerprints and sketches allow a similarity; ``least`` is the sketch's bound."""
    half = np.uint64(_LOW)
    counts = ((fps | fps >> np.uint64(1)) & half) | ((fps & fps >> np.uint64(1) & half) << np.uint64(1))
    for a, b in linked(fps, counts, ends, SIMILAR_BITS):
        told = np.zeros(len(a), bool)
        for at in range(0, len(a), 50_000):
            x, y = bins[a[at : at + 50_000]], bins[b[at : at + 50_000]]
            told[at : at + 50_000] = ((x == y) & (x != 0)).sum(1) >= least * ((x | y) != 0).sum(1)
        if told.any():
            yield a[told], b[told]


def cell_ends(cell: np.ndarray) -> np.ndarray:
    """The end of each row's cell; rows are sorted by cell."""
    _, starts, sizes = np.unique(cell, return_index=True, return_counts=True)
    return np.repeat(starts + sizes, sizes)


def fingerprint_links(keyed: DataFrame, sketched: DataFrame, text_col: str, words: int, radius: int) -> DataFrame:
    """(a, b): texts (points) that ``near_duplicates`` puts into one group, each linked to the group's first."""
    grouped = near_duplicates(keyed.select("raw", text_col), "raw", text_col, words, radius).select("raw", "component_id").distinct()
    point_of = sketched.select("raw", "point").distinct()
    first = point_of.select(F.col("raw").alias("component_id"), F.col("point").alias("b"))
    return grouped.join(point_of, "raw").join(first, "component_id").select(F.col("point").alias("a"), "b").where("a <> b").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, fingerprint_words: int = 4, radius: int | None = None) -> DataFrame:
    """Groups of documents linked by a shingle similarity (Jaccard) of at least ``similarity``.

    With a ``radius``, documents whose SimHash fingerprints are linked through
    at most so many bits (``near_duplicates``, shingles of
    ``fingerprint_words``) are linked as well.

    At that similarity fingerprints differ in up to a third of their bits, more
    than a grid can bound, so cells are anchors (shared least shingles) here.
    Fingerprints and sketches only choose candidates, with room for their
    errors; a pair is a candidate in the cell of its least shared anchor. The
    shingle hashes of candidates are then brought to these cells, and a link
    needs their exact similarity. Pairs that links already join are passed
    over, so a cell of n copies takes about n comparisons.

    Returns the id, ``component_id``, ``text_key`` (a hash of the text) and
    ``kept`` for every row: the row of the group's least id, and of its least
    text key if the id has several texts, is kept. The cases of
    ``near_duplicates`` are treated alike, texts without words are one group, and
    null ids come after all others.
    """
    least = similarity - SLACK

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                found = [sketch(shingle_hashes(t, words)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([f for f, _, _ in found], pa.int64()), pa.array([a.tolist() for _, a, _ in found], pa.list_(pa.int64())), pa.array([b.tobytes() for _, _, b in found], pa.binary())], [id_col, "raw", "point", "fp", "anchors", "bins"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col)).alias("raw"))
    sketched = cut(keyed.mapInArrow(read, f"`{id_col}` {kind}, raw long, point long, fp long, anchors array<long>, bins binary"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "raw"))
    points = cut(sketched.groupBy("point").agg(first.alias("first"), F.any_value("fp").alias("fp"), F.any_value("anchors").alias("anchors"), F.any_value("bins").alias("bins")))
    placed = points.select("point", "fp", "bins", "anchors", F.explode("anchors").alias("cell")).withColumn("anchor", F.col("cell"))

    def candidates(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("cell").to_numpy(), kind="stable")
        cell, point, anchor, fps = (part.column(c).to_numpy()[order] for c in ("cell", "point", "anchor", "fp"))
        bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)[order]
        # Anchors before the cell's own, which are shared by no pair that is a candidate here.
        before = np.zeros((len(order), ANCHORS), np.uint64)
        for i, own in enumerate(part.column("anchors").take(pa.array(order)).to_pylist()):
            own = np.array(own, np.int64).view(np.uint64)
            own = own[own < np.uint64(int(anchor[i]) & (1 << 64) - 1)]
            before[i, : len(own)] = own
        active = np.zeros(len(order), bool)
        for a, b in sketch_pairs(fps.view(np.uint64), bins, cell_ends(cell), least):
            for at in range(0, len(a), 50_000):
                i, j = a[at : at + 50_000], b[at : at + 50_000]
                fresh = (anchor[i] == anchor[j]) & ~((before[i][:, :, None] == before[j][:, None, :]) & (before[i] != 0)[:, :, None]).any((1, 2))
                active[i[fresh]] = active[j[fresh]] = True
        return pa.table({"point": pa.array(point[active]), "cell": pa.array(cell[active])})

    met = dealt(placed, ["point", "fp", "bins", "anchors", "anchor"], ANCHORS * points.count(), CELL_ROWS)
    active = cut(met.groupBy("bucket").applyInArrow(candidates, "point long, cell long"))
    asked = active.groupBy("point").agg(F.collect_set("cell").alias("cells")).join(points.select("point", F.col("first.id").alias("__id"), F.col("first.raw").alias("raw")), "point")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                whole = [shingle_hashes(t, words) for t in part.column(2).to_pylist()]
                found = [sketch(h) for h in whole]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f for f, _, _ in found], pa.int64()), pa.array([b.tobytes() for _, _, b in found], pa.binary()), pa.array([np.unique(h).tobytes() for h in whole], pa.binary())], ["point", "cells", "fp", "bins", "hashes"])

    chosen = keyed.join(checked_broadcast(asked), "raw").where(F.col(id_col).eqNullSafe(F.col("__id"))).select("point", "cells", F.col(text_col).alias("text"))
    held = cut(chosen.mapInArrow(hashes, "point long, cells array<long>, fp long, bins binary, hashes binary"))
    size = held.agg(F.sum(F.size("cells") * (F.octet_length("hashes") + BINS))).first()[0] or 0
    dealt_cells = held.select("point", "fp", "bins", "hashes", F.explode("cells").alias("cell")).withColumn("bucket", F.pmod("cell", F.lit(1 + size // BUCKET_BYTES)))

    def compare(part: pa.Table) -> pa.Table:
        cell, point = part.column("cell").to_numpy(), part.column("point").to_numpy()
        order = np.lexsort((point, cell))
        order = order[np.append(True, (np.diff(cell[order]) != 0) | (np.diff(point[order]) != 0))[: len(order)]]
        cell, point, fps = cell[order], point[order], part.column("fp").to_numpy()[order].view(np.uint64)
        bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)[order]
        column = part.column("hashes").combine_chunks()
        own = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in order]
        sizes = np.array([len(h) for h in own])
        nodes, place = np.unique(point, return_inverse=True)
        root = list(range(len(nodes)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for a, b in sketch_pairs(fps, bins, cell_ends(cell), least):
            fits = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-6
            for i, j in zip(a[fits].tolist(), b[fits].tolist()):
                x, y = top(place[i]), top(place[j])
                if x != y and jaccard(own[i], own[j]) >= similarity:
                    root[max(x, y)] = min(x, y)
        roots = np.array([top(i) for i in range(len(nodes))], np.int64)
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[moved]), "b": pa.array(nodes[roots[moved]])})

    links = dealt_cells.groupBy("bucket").applyInArrow(compare, "a long, b long")
    if radius is not None:
        links = links.union(fingerprint_links(keyed, sketched, text_col, fingerprint_words, radius))
    roots = components(links)
    rooted = points.select("point", "first").join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    named = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of_point = rooted.join(named, "root").select("point", "least")
    kept = F.col(id_col).eqNullSafe(F.col("least.id")) & F.col("raw").eqNullSafe(F.col("least.raw"))
    return sketched.select(id_col, "raw", "point").join(of_point, "point").select(id_col, F.col("least.id").alias("component_id"), F.col("raw").alias("text_key"), kept.alias("kept"))


def keep_one(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``similar_documents``: rows are told by id and text, so another text of an id is judged by its own group.

    Of rows that repeat an id and its text one stays; null ids are treated as one id.
    """
    losers = grouped.where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.col("text_key").alias("__text")).distinct()
    docs, back = shielded(docs, id_col, text_col)
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    left = keyed.join(losers, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), "left_anti")
    return left.dropDuplicates([id_col, "__key"]).drop("__key").withColumnsRenamed(back)
