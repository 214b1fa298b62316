"""Finding and removing passages of a benchmark in training documents, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.llm.shared import ascii_lower, checked_broadcast, cut, shielded

#: Hits up to which the documents that have some are broadcast to the texts; more are joined by a shuffle.
BROADCAST_HITS = 200_000
#: Words are runs of digits, letters and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def _joined(left: str, right: str, shift: int) -> Column:
    """Hashes of windows made of a window of ``left`` and, ``shift`` words on, one of ``right``; those at the end are cut off later."""
    return F.zip_with(F.col(left), F.slice(F.col(right), F.lit(shift + 1), F.size(right)), lambda a, b: F.xxhash64(a, b))


def window_hashes(rows: DataFrame, words_col: str, lengths: list[int]) -> DataFrame:
    """Add ``__w<n>`` for every length: the hash of each window of n words, from hashes of windows half as long."""
    found, have = rows.withColumn("__w1", F.transform(words_col, lambda w: F.xxhash64(w))), {1}
    for n in lengths:
        parts = [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]
        for size in range(1, n.bit_length()):
            if 1 << size not in have:
                found, have = found.withColumn(f"__w{1 << size}", _joined(f"__w{1 << (size - 1)}", f"__w{1 << (size - 1)}", 1 << (size - 1))), have | {1 << size}
        done = parts[0]
        for part in parts[1:]:
            if done + part not in have:
                found, have = found.withColumn(f"__w{done + part}", _joined(f"__w{done}", f"__w{part}", done)), have | {done + part}
            done += part
    for n in lengths:
        found = found.withColumn(f"__w{n}", F.slice(f"__w{n}", F.lit(1), F.greatest(F.size(words_col) - n + 1, F.lit(0))))
    return found


def windows(rows: DataFrame, words_col: str, lengths: list[int], *keep: str) -> DataFrame:
    """(keep..., n, pos, hash): every window of every length, ``pos`` from 0."""
    arrays = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"__w{n}").alias("hashes")) for n in lengths])
    each = window_hashes(rows, words_col, lengths).select(*keep, F.explode(arrays).alias("w"))
    return each.select(*keep, F.col("w.n").alias("n"), F.posexplode("w.hashes").alias("pos", "hash"))


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> tuple[DataFrame, list[int]]:
    """(hash, n, window, items): each distinct window of the items with the ids that hold it, and the lengths that occur.

    An item of fewer than ``size`` words, but not none, is one window.
    """
    split = items.select(F.col(item_col).alias("item"), words(ascii_lower(F.col(text_col))).alias("words")).withColumn("n", F.least(F.size("words"), F.lit(size))).where("n > 0")
    lengths = sorted(r["n"] for r in split.select("n").distinct().collect())  # at most ``size`` numbers
    if not lengths:
        return items.sparkSession.createDataFrame([], "hash long, n int, window string, items array<string>"), []
    each = windows(split.withColumn("own", F.col("n")), "words", lengths, "item", "own", "words").where("n = own")
    named = each.withColumn("window", F.array_join(F.slice("words", F.col("pos") + 1, F.col("n")), " "))
    return named.groupBy("hash", "n", "window").agg(F.collect_set(F.col("item").cast("string")).alias("items")), lengths


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """Mark the words of documents that lie in a window of ``size`` words of an item.

    The items' window hashes are a broadcast hash set while they have at most
    ``BROADCAST_ROWS`` rows (checked; beyond that the join is shuffled); the
    hashes of all windows of all documents are scanned against it, and the hits'
    words are compared one by one, so equal hashes of unequal words do no harm.
    Few hits (counted) are broadcast to the texts, so that these need no shuffle.

    Adds ``n_words``, ``n_hit``, ``hit_words`` (their places, from 0), ``items``
    (ids as strings, sorted) and ``contaminated``, which replace input columns
    of these names. Null and empty texts have no words; null ids and repeated
    rows pass through; items without words are left out; without items no word
    is hit.
    """
    added = ["n_words", "n_hit", "hit_words", "items", "contaminated"]
    docs, back = shielded(docs, id_col, text_col)
    keyed = docs.drop(*added).withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))
    wanted, lengths = item_windows(items, item_col, item_text, size)
    split = keyed.withColumn("__words", words(ascii_lower(F.col(text_col))))
    if lengths:
        scanned = windows(split.select("__key", "__words"), "__words", lengths, "__key")
        found = scanned.join(checked_broadcast(wanted.withColumnRenamed("n", "own")), "hash").where("n = own")
        hits = found.groupBy("__key").agg(F.collect_set(F.struct("pos", "n", "window", "items")).alias("__hits"))
        hits = cut(hits)
        few = (hits.agg(F.sum(F.size("__hits"))).first()[0] or 0) <= BROADCAST_HITS
        split = split.join(F.broadcast(hits) if few else hits, "__key", "left")
    else:
        split = split.withColumn("__hits", F.expr("cast(null as array<struct<pos: int, n: int, window: string, items: array<string>>>)"))
    true = F.filter("__hits", lambda h: F.array_join(F.slice(F.col("__words"), h["pos"] + 1, h["n"]), " ") == h["window"])
    places = F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1))))
    none = F.array().cast("array<int>")
    checked = split.withColumn("n_words", F.size("__words").cast("long")).withColumn("__hits", F.when(F.col("__hits").isNotNull(), true))
    named = checked.withColumn("hit_words", F.coalesce(F.array_sort(places), none)).withColumn("items", F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("__hits", lambda h: h["items"])))), F.array().cast("array<string>")))
    counted = named.withColumn("n_hit", F.size("hit_words").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    return counted.select(*[c for c in keyed.columns if c != "__key"], *added).withColumnsRenamed(back)


def remove_documents(marked: DataFrame) -> DataFrame:
    """Keep the rows without a hit."""
    return marked.where(~F.col("contaminated"))


def remove_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Take the hit words, and what stands between them and the next word, out of the texts."""
    text = F.col(text_col)
    gaps, split = F.split(text, WORD, -1), words(text)
    pairs = F.zip_with(split, F.slice(gaps, F.lit(2), F.greatest(F.size(split), F.lit(1))), lambda w, g: F.concat(w, F.coalesce(g, F.lit(""))))
    kept = F.filter(pairs, lambda x, i: ~F.array_contains(F.col("hit_words"), i))
    return marked.withColumn(text_col, F.when(F.col("contaminated"), F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))).otherwise(text))
