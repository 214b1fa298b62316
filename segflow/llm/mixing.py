"""Mixing sources to target sizes by entropy balancing, in DataFrame expressions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflow.llm.shared import checked_broadcast, cut, number_rows

#: Rows of a (source, size) that one task ranks; larger ones are ranked in several parts.
RANK_ROWS = 1_000
#: Rounds after which the bracket of a tilt is narrower than a double tells apart.
ROUNDS = 80
#: Sizes of each power of two that may take the words that rounding left over.
CHOICES = 16
ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """A string that sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def share_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(key, source_size) with ``target``: ``share`` of all sizes dealt by weight; what exceeds ``cap`` times a source's size is dealt again.

    Sources in the order of their keys take ``weights`` in turn. Each round
    fixes the sources that would exceed their cap and deals the rest among the
    others, until no further one exceeds it; only two sums a round reach the
    driver. Sources without words get 0.
    """
    numbered = number_rows(totals, ["key"], "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = cut(numbered.select("key", "source_size", weight.alias("weight"), (cap * F.col("source_size")).cast("double").alias("most")))
    budget, level, before = share * (weighed.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most")
        free, used, n = weighed.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most"))), F.count_if(full)).first()
        if n == before or not free:
            return weighed.select("key", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * level).alias("target"))
        level, before = max(budget - (used or 0.0), 0.0) / free, n


def rate_at(tilt: Column, size: Column, cap: int) -> Column:
    """exp(tilt * size), at most ``cap``."""
    return F.when(tilt * size >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(tilt * size))


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: int = 2) -> DataFrame:
    """(key, source_size, target, tilt): rates exp(tilt * size), at most ``cap``, give each source its target of words.

    These rates have the least relative entropy to rate 1 among all rates in
    [0, cap] that meet the target. Its dual is convex with one variable for
    each source; every Newton round is one aggregate of the cells (key, size,
    n) for its gradient and curvature, on the logarithm of the words, inside a
    bracket that bisects where a step would leave it. Sums are decimals, so the
    order of the rows does not matter.
    """
    top = math.log(cap)
    fixed = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(top)).when(F.col("target") <= 0, F.lit(-1e300))
    state = cut(targets.select("key", "source_size", "target", F.coalesce(fixed, F.lit(0.0)).alias("tilt"), F.lit(-1e300).alias("low"), F.lit(top).alias("high"), fixed.isNotNull().alias("done")))
    rate, exact = rate_at(F.col("tilt"), F.col("size"), cap), lambda words: F.sum(words.cast("decimal(38,3)")).cast("double")
    for _ in range(ROUNDS):
        if state.where(~F.col("done")).isEmpty():
            break
        words = F.col("n") * F.col("size") * rate
        sums = cells.join(checked_broadcast(state.where(~F.col("done")).select("key", "tilt")), "key").groupBy("key").agg(exact(words).alias("words"), exact(F.when(rate < cap, words * F.col("size")).otherwise(0)).alias("curve"))
        found = state.join(sums, "key", "left")
        short = F.col("words") < F.col("target")
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("curve")
        middle = F.when(low > -1e299, (low + high) / 2).otherwise(2 * F.least(high, F.lit(-1e-9)))
        met = F.col("done") | (F.abs(F.col("words") - F.col("target")) <= F.greatest(F.lit(0.01), 1e-12 * F.col("target")))
        moved = F.when((F.col("words") > 0) & (F.col("curve") > 0) & (step > low) & (step < high), step).otherwise(middle)
        state = cut(found.select("key", "source_size", "target", F.when(met, F.col("tilt")).otherwise(moved).alias("tilt"), F.when(met, F.col("low")).otherwise(low).alias("low"), F.when(met, F.col("high")).otherwise(high).alias("high"), met.alias("done")))
    return state.select("key", "source_size", "target", "tilt")


def round_cells(cells: DataFrame, tilts: DataFrame, cap: int = 2) -> DataFrame:
    """(key, size, n) with the source's columns, ``rate`` and ``copies``, the whole copies that the cell's documents get together.

    Copies are rounded so that running sums over ascending sizes, in each power
    of two, are off by half a copy at most. The words still left over or taken
    too much by a source then go to sizes that fit, larger ones first: of each
    power of two ``CHOICES`` sizes are offered, so a source's list is short
    however large the source is.
    """
    octave = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")))
    rated = cells.join(checked_broadcast(tilts), "key").withColumn("rate", rate_at(F.col("tilt"), F.col("size"), cap)).withColumn("octave", octave)
    upto = Window.partitionBy("key", "octave").orderBy("size")
    running = F.sum(F.col("n") * F.col("rate")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.floor(running + 0.5) - F.floor(before + 0.5)
    first = cut(rated.withColumn("copies", F.least(F.greatest(whole, F.lit(0)), cap * F.col("n"))))
    left = first.groupBy("key", "target").agg((F.round("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("left")).where("left <> 0").select("key", "left")
    room = F.when(F.col("left") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    open_ = first.join(checked_broadcast(left), "key").where((F.col("size") > 0) & (F.col("size") <= F.abs("left"))).withColumn("room", room).where("room > 0")
    offered = open_.withColumn("choice", F.row_number().over(Window.partitionBy("key", "octave").orderBy(F.xxhash64("size"), "size"))).where(F.col("choice") <= CHOICES)
    listed = offered.groupBy("key", "left").agg(F.sort_array(F.collect_list(F.struct("size", "room")), asc=False).alias("offers"))
    start = F.struct(F.abs("left").alias("left"), F.expr("cast(array() as array<struct<size: bigint, moved: bigint>>)").alias("picks"))

    def take(state: Column, offer: Column) -> Column:
        moved = F.least(offer["room"], F.floor(state["left"] / offer["size"]))
        picks = F.when(moved > 0, F.array_append(state["picks"], F.struct(offer["size"].alias("size"), moved.alias("moved")))).otherwise(state["picks"])
        return F.struct((state["left"] - moved * offer["size"]).alias("left"), picks.alias("picks"))

    picked = listed.select("key", F.signum("left").cast("long").alias("sign"), F.explode(F.aggregate("offers", start, take)["picks"]).alias("pick"))
    moves = picked.select("key", F.col("pick.size").alias("size"), (F.col("sign") * F.col("pick.moved")).alias("moved"))
    return first.join(moves, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("moved", F.lit(0))).drop("moved", "octave", "tilt")


def deal_copies(rows: DataFrame, cells: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with key and size, and their cell's columns, ``copies`` dealt as evenly as whole copies go.

    The first rows by a hash get the copies that do not come out even. Cells of
    more than ``RANK_ROWS`` rows are cut into parts by that hash, which take
    their share of the copies by running counts, so no task ranks a hot cell.
    """
    parts = (1 + F.floor(F.col("n") / RANK_ROWS)).cast("long")
    ordered = rows.select("*", *[c.alias(f"o{i}") for i, c in enumerate(order)])
    by = [f"o{i}" for i in range(len(order))]
    spread = ordered.join(checked_broadcast(cells.withColumn("parts", parts), 200_000), ["key", "size"]).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(*by), "parts")).otherwise(F.lit(0).cast("long")))
    sizes = spread.where("parts > 1").groupBy("key", "size", "part", "n", "copies").agg(F.count("*").alias("in_part"))
    upto = F.sum("in_part").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda rows_: F.floor(rows_.cast("decimal(38,0)") * F.col("copies") / F.col("n"))
    shared = sizes.withColumn("upto", upto).select("key", "size", "part", "in_part", (share(F.col("upto")) - share(F.col("upto") - F.col("in_part"))).cast("long").alias("of_part"))
    dealt = spread.join(shared, ["key", "size", "part"], "left").withColumn("in_part", F.coalesce("in_part", "n")).withColumn("of_part", F.coalesce("of_part", "copies"))
    inside = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(*by))
    return dealt.withColumn("copies", F.floor(F.col("of_part") / F.col("in_part")) + (inside <= F.col("of_part") % F.col("in_part")).cast("long"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """How often to take each document so that the sources' words meet their targets.

    Sources in the order of code points, null last, weigh ``weights`` in turn
    and share ``share`` times all words; a target stops at ``cap`` times its
    source's words (``share_targets``). Rates are tilted exponentially by the
    document's size (``solve_tilts``) and rounded into 0 to ``cap`` whole copies.

    Adds ``size`` (words of the text, or ``size_col``), ``source_size``,
    ``target``, ``rate``, ``copies`` and ``taken`` (copies * size), which
    replace input columns of these names. Null and empty texts have size 0 and
    one copy of no words; a null source is a source of its own; null ids and
    repeated rows count as further documents; an empty table gives none. A
    source of few documents meets its target only as nearly as whole copies
    allow. Equal tables give equal results, however their rows are stored.
    """
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)) if size_col else word_count(F.col(text_col))
    kept = [c for c in docs.columns if c not in ADDED]
    plain = [F.col(f.name) for f in docs.schema if f.name in kept and f.name != text_col and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.select(F.struct(*kept).alias("row"), source_key(F.col(source_col)).alias("key"), size.cast("long").alias("size"), F.xxhash64(id_col).alias("first"), F.xxhash64(*plain).alias("second"))
    cells = cut(rows.groupBy("key", "size").agg(F.count("*").alias("n")))
    totals = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rounded = cut(round_cells(cells, solve_tilts(cells, share_targets(totals, weights, share, cap), cap), cap))
    dealt = deal_copies(rows, rounded, [F.col("first"), F.col("second")]).withColumn("taken", F.col("copies") * F.col("size"))
    return dealt.select("row.*", *ADDED)


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies, numbered by ``copy`` from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
