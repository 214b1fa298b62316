"""Scoring texts by language models that are learnt from the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm import attention as A
from segflow.llm.shared import cut
from segflow.llm.tokens import TokenCache, index_chunks, tokenizer_path

#: The id after the last subword of a text; the vocabulary's own end.
END_ID = 49407
#: Windows of a training step, and of a scoring batch.
STEP = 256
#: Bytes of text that are counted and scored together, and whose windows are laid out at once.
BATCH_BYTES, LAYOUT_BYTES = 16 << 20, 4 << 20


#: Weight of an id's share of its class beside its counts after the previous subword's group.
PRIOR = 500.0


@dataclass
class Model:
    """Attention weights whose tables have a row for each id, each id's class and group, the rows of the nodes of the classes' trees, and each node's odds after each group."""

    weights: dict[str, np.ndarray]
    classes: np.ndarray
    groups: np.ndarray
    nodes: np.ndarray
    odds: np.ndarray

    def log10(self, ids: list[np.ndarray], tree: A.Tree) -> np.ndarray:
        """log10 probability of each text's ids and its end; ``tree`` is that of the classes."""
        start, none = len(self.classes), len(self.classes) + 1
        after = np.append(self.groups, [A.GROUPS - 1, A.GROUPS - 1])
        queries, keys, targets = A.blocks(ids, END_ID, start, none)
        found = np.zeros(targets.size)
        for at in range(0, len(queries), STEP):
            some = queries[at : at + STEP]
            logs, hidden, _, _ = A.forward(self.weights, some, keys[at : at + STEP], none)
            aim = targets[at : at + STEP].ravel()
            rows = np.flatnonzero(aim >= 0)
            which, node, right = tree.ways(aim[rows])
            which = rows[which]
            odds = A.steps_right(self.odds, self.nodes.take(node, axis=0), hidden.reshape(-1, A.WIDTH).take(which, axis=0), after[some.ravel()[which]], node)
            step = np.log1p(np.exp(-np.abs(odds))) + np.maximum(np.where(right, -odds, odds), 0)
            own = -np.bincount(which, step, len(aim))
            own[rows] += logs[rows, self.classes[aim[rows]]]
            found[at * A.BLOCK : at * A.BLOCK + len(aim)] = own
        sizes = [-(-(len(i) + 1) // A.BLOCK) * A.BLOCK for i in ids]
        return (np.add.reduceat(found, np.cumsum([0, *sizes[:-1]])) if sizes else np.zeros(0)) / np.log(10)


def layouts(sizes: list[int]) -> Iterator[slice]:
    """Runs of texts of about LAYOUT_BYTES; a longer text is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LAYOUT_BYTES, "right")))
        yield slice(at, end)
        at = end


_trees: dict[str, A.Tree] = {}


def vocabulary(path: str) -> tuple[TokenCache, np.ndarray, np.ndarray, A.Tree]:
    """(cache, classes, groups, tree) of all ids; the tree is made once in a Python worker."""
    cache = TokenCache.open(path)
    ends = np.append(cache.ends_word, np.zeros(max(0, END_ID + 1 - len(cache.ends_word)), bool))
    classes = A.id_classes(ends, END_ID)
    if path not in _trees:
        _trees[path] = A.Tree(classes)
    return cache, classes, A.id_groups(classes), _trees[path]


def node_odds(counts: np.ndarray, classes: np.ndarray, tree: A.Tree) -> np.ndarray:
    """Each node's log odds after each group: of the counts there, and of the share of all counts in the class with weight PRIOR."""
    share = counts.sum(0) + 1
    share = share / np.bincount(classes, share)[classes]
    return np.stack([tree.odds(n + PRIOR * share) for n in counts])


def _rows_of(vector: np.ndarray) -> np.ndarray:
    """Rows of WIDTH numbers, the last one filled up."""
    return np.append(vector, np.zeros(-len(vector) % A.WIDTH)).reshape(-1, A.WIDTH)


#: What a batch tells: rows of WIDTH numbers of its weights (kind 0), ids (2) and nodes (3), each with the weight it has in the mean, and counts (1).
_ROWS = [f"v{i}" for i in range(A.WIDTH)]


def fit(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> Model:
    """Train on every window of every text.

    Rows are dealt to batches of bounded size by their hash and sorted there,
    so the model depends on the texts and not on how the table is stored. Each
    batch takes steps over its own texts from the same start. The batches'
    weights are averaged by their number of tokens, the row of an id by how
    often each batch has it, that of a node by how often it is passed; ids are
    counted after each group of previous ids over all texts. All these are Spark
    aggregates whose results (the weights, a row for each id and node, a count
    for each id and group) do not grow with the input.
    """
    path = tokenizer or tokenizer_path()
    batches = 1 + (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BATCH_BYTES
    # By all columns, so that copies of one text are spread.
    batched = docs.select(F.pmod(F.xxhash64(*docs.columns), F.lit(batches)).alias("batch"), F.col(text_col).alias("text"))

    def train(part: pa.Table) -> pa.Table:
        cache, classes, groups, tree = vocabulary(path)
        raw = [(t or b"").lower() for t in part.sort_by("text").column("text").cast(pa.binary()).to_pylist()]
        counts, held = np.zeros((A.GROUPS, len(classes)), np.int64), []
        for run in layouts([len(t) for t in raw]):
            ids = cache.encode_words(*index_chunks(t.split() for t in raw[run]))
            after = np.concatenate([A.previous(groups, i) for i in ids]) * len(classes) + np.concatenate(ids)
            counts += np.bincount(after.astype(np.int64), minlength=counts.size).reshape(counts.shape)
            held.append([i.astype(np.uint16) for i in ids])
        total, texts = int(counts.sum()) + len(raw), len(raw)
        del raw
        trainer = A.Trainer(classes, groups, tree, node_odds(counts, classes, tree))
        for k, ids in enumerate(held):
            windows = A.blocks(ids, END_ID, len(classes), len(classes) + 1)
            order = np.random.default_rng(k).permutation(len(windows[0]))
            for first in range(0, len(order), STEP):
                trainer.step(*[w[order[first : first + STEP]] for w in windows])
        vector, seen, often = _rows_of(trainer.vector()), np.flatnonzero(counts), counts.sum(0)
        by_id = np.append(often, [texts, 0])
        rank = np.append(0, np.cumsum(often[tree.order]))
        by_node = rank[tree.high] - rank[tree.low]
        ids, nodes = np.flatnonzero(by_id), np.flatnonzero(by_node)
        parts = [(0, np.arange(len(vector)), np.full(len(vector), total), vector), (1, seen, counts.ravel()[seen], np.zeros((len(seen), A.WIDTH))), (2, ids, by_id[ids], trainer.ids[ids]), (3, nodes, by_node[nodes], trainer.nodes[nodes])]
        kind, place, weight = (np.concatenate([np.broadcast_to(p[i], len(p[1])) for p in parts]) for i in range(3))
        values = np.concatenate([p[3] * p[2][:, None] for p in parts]).astype(np.float32)
        return pa.table({"kind": pa.array(kind, pa.int32()), "place": pa.array(place, pa.int64()), "weight": pa.array(weight, pa.int64())} | {c: values[:, i].copy() for i, c in enumerate(_ROWS)})

    sums = [F.sum(c).alias(c) for c in ("weight", *_ROWS)]
    rows = batched.groupBy("batch").applyInArrow(train, f"kind int, place long, weight long, {', '.join(f'{c} float' for c in _ROWS)}").groupBy("kind", "place").agg(*sums).toArrow()
    kind, place, weight = (rows.column(c).to_numpy() for c in ("kind", "place", "weight"))
    means = np.stack([rows.column(c).to_numpy() for c in _ROWS], 1) / np.maximum(weight, 1)[:, None]
    _, classes, groups, tree = vocabulary(path)
    start = A.Trainer(classes, groups, tree, np.zeros((1, 1)))
    tables = {0: _rows_of(start.vector()), 2: start.ids, 3: start.nodes}
    for k, table in tables.items():
        table[place[kind == k]] = means[kind == k]
    counts = np.zeros((A.GROUPS, len(classes)))
    counts.ravel()[place[kind == 1]] = weight[kind == 1]
    vector = tables[0].ravel()[: len(start.vector())]
    weights = A.id_tables(A.from_vector(vector), vector[-start.mix.size :].reshape(start.mix.shape), start.ids, classes)
    return Model(weights, classes, groups, start.nodes, node_odds(counts, classes, tree))


def text_words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end (a line feed, which no word can be)."""
    return [*(text or b"").lower().split(), b"\n"]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def word_counts(batched: DataFrame) -> DataFrame:
    """(batch, word, n, count): each batch's distinct words, how often its training texts have them, and how often all have."""

    def count(part: pa.Table) -> pa.Table:
        training, others = Counter(), set()
        for text, learn in zip(part.column("text").cast(pa.binary()), part.column("learn").to_pylist()):
            words = text_words(text.as_py())
            if learn:
                training.update(words)
            else:
                others.update(words)
        words = [*training, *others.difference(training)]
        return pa.table({"batch": pa.array(np.full(len(words), part.column("batch")[0].as_py())), "word": pa.array(_hashes(words)), "n": pa.array(np.append(np.fromiter(training.values(), np.int64), np.zeros(len(words) - len(training), np.int64)))})

    each = batched.groupBy("batch").applyInArrow(count, "batch long, word long, n long")
    own = Window.partitionBy("word")
    return each.withColumn("count", F.sum("n").over(own)).withColumn("first", F.row_number().over(own.orderBy("batch")) == 1)


def score(docs: DataFrame, model: Model, held_out, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Score every text by word counts and by the attention model.

    Texts are dealt to batches of bounded size. A batch sends each of its
    distinct words once, gets their counts in all training texts (those where
    ``held_out`` is false) back, and scores its texts with them.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. Null and empty texts are the end alone; a null id is learnt from
    as the condition says; repeated rows count as often as they occur; an empty
    table gives none.
    """
    path, spark = tokenizer or tokenizer_path(), docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches = 1 + total // BATCH_BYTES
    batched = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(batches)).alias("batch"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out).alias("learn"))
    shared = spark.sparkContext.broadcast(model)

    def rate(texts: pa.Table, counted: pa.Table) -> pa.Table:
        model, (cache, _, _, tree) = shared.value, vocabulary(path)
        word, count = counted.column("word").to_numpy(), counted.column("count").to_numpy()
        order = np.argsort(word)
        word, count = word[order], count[order]
        raw = texts.column("text").cast(pa.binary())
        rows, distinct = index_chunks(text_words(t.as_py()) for t in raw)
        held = count[np.searchsorted(word, _hashes(distinct))] if distinct else count
        logged, known = np.log10(held + 1.0), held > 0
        tokens = [len(r) for r in rows]
        seen, logs = [int(known[r].sum()) for r in rows], [float(logged[r].sum()) for r in rows]
        ids = cache.encode_words([r[:-1] for r in rows], distinct)  # without the end
        scores = [model.log10(ids[run], tree) for run in layouts([3 * len(i) for i in ids])]
        del rows, ids, distinct
        first = counted.column("first").to_numpy(zero_copy_only=False)
        learnt = counted.filter(pa.array(first & (counted.column("count").to_numpy() > 0)))
        gap = [None] * len(raw)
        stats = pa.array([*gap, len(learnt)], pa.int64()), pa.array([*gap, int(counted.column("n").to_numpy().sum())], pa.int64())
        ids = pa.chunked_array([*texts.column("id").chunks, pa.nulls(1, texts.schema.field("id").type)])
        flags = pa.chunked_array([*texts.column("learn").chunks, pa.nulls(1, pa.bool_())])
        return pa.table({"id": ids, "learn": flags, "tokens": pa.array([*tokens, None], pa.int64()), "known": pa.array([*seen, None], pa.int64()), "logs": pa.array([*logs, None], pa.float64()), "score": pa.array([*np.concatenate([*scores, np.zeros(0)]).tolist(), None], pa.float64()), "vocabulary": stats[0], "learnt": stats[1]})

    kind = docs.schema[id_col].dataType.simpleString()
    rated = batched.groupBy("batch").cogroup(word_counts(batched).groupBy("batch")).applyInArrow(rate, f"id {kind}, learn boolean, tokens long, known long, logs double, score double, vocabulary long, learnt long")
    rated = cut(rated)
    sums = rated.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v"), F.coalesce(F.sum("learnt"), F.lit(0)).alias("n")).first()
    base = F.col("logs") - F.col("tokens") * float(np.log10(sums["n"] + sums["v"] + 1))
    return rated.where(F.col("tokens").isNotNull()).select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(sums["n"])).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
