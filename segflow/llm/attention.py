"""A small causal self-attention model over subword ids, in numpy.

What an id is to attention is what its class is and how the id itself differs
from it. Its probability is a factored softmax of the hidden state: over
classes, then along a binary tree over the ids of a class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Positions scored by a window, and positions before them that it also sees.
BLOCK, BEFORE = 16, 16
WIDTH = 8
#: Bins of a subword's rank in the vocabulary (by powers of two), for ids inside and at the end of words.
BINS = 16
#: Further classes: the end of a text, its start (input alone) and nothing (keys alone).
END, START, NONE = 2 * BINS, 2 * BINS + 1, 2 * BINS + 2
OUT, KEYS = END + 1, NONE + 1


def id_classes(ends_word: np.ndarray, end_id: int) -> np.ndarray:
    """A class for each id: bytes and merges by their rank, split by whether they end a word."""
    rank = np.arange(len(ends_word))
    rank = np.where(rank < 512, rank % 256, rank - 512)
    found = np.minimum(np.log2(rank + 1).astype(np.int64), BINS - 1) + BINS * ends_word.astype(np.int64)
    found[end_id] = END
    return found


#: Groups of four neighbouring classes each, and the start of a text.
GROUPS = END // 4 + 1


def id_groups(classes: np.ndarray) -> np.ndarray:
    """A group for each id, by its class."""
    return np.minimum(classes // 4, GROUPS - 1)


def previous(groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The group before each id of a text."""
    return np.concatenate([[GROUPS - 1], groups[ids[:-1]]])[: len(ids)]


def _shapes() -> dict[str, tuple[int, ...]]:
    return {"query": (KEYS, WIDTH), "key": (KEYS, WIDTH), "value": (KEYS, WIDTH), "own": (KEYS, WIDTH), "distance": (BLOCK + BEFORE,), "out": (WIDTH, OUT), "bias": (OUT,)}


def start_weights() -> dict[str, np.ndarray]:
    made = np.random.default_rng(7)
    return {k: (made.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in _shapes().items()}


def to_vector(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _shapes()])


def from_vector(vector: np.ndarray) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for k, s in _shapes().items():
        found[k] = np.asarray(vector[at : at + int(np.prod(s))], np.float32).reshape(s)
        at += int(np.prod(s))
    return found


#: How far back each key of a window is from each scored position; those ahead are masked.
_BACK = np.arange(BEFORE, BEFORE + BLOCK)[:, None] - np.arange(BEFORE + BLOCK)[None, :]
_MASK = _BACK >= 0


def blocks(classes: list[np.ndarray], end: int = END, start: int = START, none: int = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of all texts, as classes or ids: (queries, keys, targets), targets -1 where nothing is scored.

    A text's input is the start and its classes; every class and the end is the target of one position.
    """
    sizes = [-(-(len(c) + 1) // BLOCK) for c in classes]
    inputs, targets = np.full((sum(sizes), BLOCK), none, np.int32), np.full((sum(sizes), BLOCK), -1, np.int32)
    flat_in, flat_out, firsts, at = inputs.ravel(), targets.ravel(), [], 0
    for c, n in zip(classes, sizes):
        firsts.append(at // BLOCK)
        flat_in[at] = start
        flat_in[at + 1 : at + 1 + len(c)] = c
        flat_out[at : at + len(c)] = c
        flat_out[at + len(c)] = end
        at += n * BLOCK
    before = np.empty_like(inputs)
    before[1:] = inputs[:-1]
    before[firsts] = none
    return inputs, np.concatenate([before, inputs], axis=1), targets


_ONE = np.eye(KEYS, dtype=np.float32)


def attend(query: np.ndarray, key: np.ndarray, value: np.ndarray, own: np.ndarray, distance: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden, context, weight) of batched masked attention; ``absent`` tells keys that are nothing."""
    weight = query @ key.transpose(0, 2, 1)
    weight *= weight.dtype.type(WIDTH**-0.5)
    weight += np.where(_MASK, distance[np.maximum(_BACK, 0)], -1e4).astype(weight.dtype)
    some = np.flatnonzero(absent.any(1))
    weight[some] = np.where(absent[some][:, None, :], weight.dtype.type(-1e4), weight[some])
    np.minimum(weight, 60, out=weight)
    np.exp(weight, out=weight)
    weight /= np.maximum(weight.sum(-1, keepdims=True), 1e-20)
    context = weight @ value
    return np.tanh(own + context), context, weight


def attend_slopes(slope: np.ndarray, query: np.ndarray, key: np.ndarray, value: np.ndarray, hidden: np.ndarray, context: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slopes by (query, key, value, own, distance), given that by the hidden state."""
    inner = slope * (1 - hidden * hidden)
    change = inner @ value.transpose(0, 2, 1)
    change -= (inner * context).sum(-1, keepdims=True)
    change *= weight
    scale = change.dtype.type(WIDTH**-0.5)
    by_distance = np.bincount(_BACK[_MASK], change.sum(0)[_MASK], BLOCK + BEFORE)
    return change @ key * scale, change.transpose(0, 2, 1) @ query * scale, weight.transpose(0, 2, 1) @ inner, inner, by_distance


def class_logs(w: dict[str, np.ndarray], hidden: np.ndarray) -> np.ndarray:
    """Class log-probabilities, a row for each hidden state."""
    logits = hidden.reshape(-1, WIDTH) @ w["out"] + w["bias"]
    logits -= np.log(np.exp(np.clip(logits, -60, 60)).sum(-1, keepdims=True))
    return logits


def class_slopes(w: dict[str, np.ndarray], logs: np.ndarray, hidden: np.ndarray, aim: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Slopes of the mean negative log-probability of ``aim`` (-1: not scored): of the output's weights, and by the hidden states."""
    scored = aim >= 0
    slope, rows = np.exp(logs), np.flatnonzero(scored)
    slope[rows, aim[rows]] -= 1
    slope *= (scored / max(len(rows), 1)).astype(np.float32)[:, None]
    return {"out": hidden.reshape(-1, WIDTH).T @ slope, "bias": slope.sum(0)}, (slope @ w["out"].T).reshape(hidden.shape)


def forward(w: dict[str, np.ndarray], queries: np.ndarray, keys: np.ndarray, none: int = NONE) -> tuple[np.ndarray, ...]:
    """(class log-probabilities, hidden, context, weight) of windows whose places are looked up in the tables of ``w``. Rows are ordered by window, then position."""
    hidden, context, weight = attend(*(w[k].take(at, axis=0) for k, at in (("query", queries), ("key", keys), ("value", keys), ("own", queries))), w["distance"], keys == none)
    return class_logs(w, hidden), hidden, context, weight


def gradient(w: dict[str, np.ndarray], queries: np.ndarray, keys: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability of the targets, all of them classes."""
    logs, hidden, context, weight = forward(w, queries, keys)
    found, slope = class_slopes(w, logs, hidden, targets.ravel())
    slopes = attend_slopes(slope, w["query"][queries], w["key"][keys], w["value"][keys], hidden, context, weight)
    for name, own, places in zip(("query", "key", "value", "own"), slopes, (queries, keys, keys, queries)):
        found[name] = _ONE[places.ravel()].T @ own.reshape(-1, WIDTH)
    return found | {"distance": slopes[4]}


class Tree:
    """A balanced binary tree over the ids of each class, in their order; its nodes are told by the id, in the order of classes, that their right half begins with.

    ``starts`` and ``sizes`` tell where an id's way lies in ``nodes`` and
    ``rights``; ``low`` and ``high`` are where a node's ids begin and end.
    """

    def __init__(self, classes: np.ndarray):
        self.order = np.argsort(classes, kind="stable")
        n, sizes = len(classes), np.bincount(classes)
        last = np.cumsum(sizes)[classes]
        place, low, high = np.empty(n, np.int64), last - sizes[classes], last.copy()
        place[self.order] = np.arange(n)
        self.low, self.high, steps = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        while len(ids := np.flatnonzero(high - low > 1)):
            middle = (low[ids] + high[ids]) // 2
            self.low[middle], self.high[middle] = low[ids], high[ids]
            right = place[ids] >= middle
            steps.append((ids, middle, right))
            low[ids[right]], high[ids[~right]] = middle[right], middle[~right]
        ids, nodes, rights = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*steps)) if steps else np.empty((3, 0), np.int64)
        by_id = np.argsort(ids, kind="stable")
        self.nodes, self.rights = nodes[by_id].astype(np.int64), rights[by_id].astype(bool)
        self.sizes = np.bincount(ids.astype(np.int64), minlength=n)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def odds(self, mass: np.ndarray) -> np.ndarray:
        """Log odds of each node's right half by the mass (above 0) of each id."""
        below, node = np.append(0, np.cumsum(mass[self.order])), np.flatnonzero(self.high)
        found = np.zeros(len(mass), np.float32)
        found[node] = np.log(below[self.high[node]] - below[node]) - np.log(below[node] - below[self.low[node]])
        return found

    def ways(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, node, right): each id's steps one after the other, ``which`` of the ids they belong to."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(ids)), n), self.nodes.take(at), self.rights.take(at)


def _logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def steps_right(odds: np.ndarray, rows: np.ndarray, hidden: np.ndarray, groups: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Log odds of going right at nodes, whose ``rows`` are given, by the hidden state and the group before: those of the group (``odds``), moved by the hidden state."""
    return np.einsum("ij,ij->i", hidden, rows) + odds.ravel().take(groups * odds.shape[1] + node)


def _sums(places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, the sum of each one's rows); places are below 2^16."""
    if not len(places):
        return places, rows
    order = np.argsort(places.astype(np.uint16), kind="stable")
    ordered = places.take(order)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.add.reduceat(rows.take(order, axis=0), starts, axis=0)


#: The slopes' parts of a row of ``mix`` and of the class tables.
_PARTS = ("query", "own", "key", "value")


def id_tables(weights: dict[str, np.ndarray], mix: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """``weights`` whose tables have a row for each id, the start and nothing: its class's row, and what ``mix`` makes of its own."""
    moved = (ids @ mix).astype(np.float32)
    rows = np.append(classes, [START, NONE])
    return weights | {k: weights[k][rows] + moved[:, i * WIDTH : (i + 1) * WIDTH] for i, k in enumerate(_PARTS)}


def start_mix() -> np.ndarray:
    return np.random.default_rng(8).normal(0, 0.5, (WIDTH, 4 * WIDTH)).astype(np.float32)


@dataclass
class Trainer:
    """Adam over mini-batches of windows for what all ids share, scaled steps for the rows of the ids and nodes that a batch has.

    ``classes`` and ``groups`` are those of all ids; the start and nothing are
    the two places after them. ``odds`` are each node's after each group.
    """

    classes: np.ndarray
    groups: np.ndarray
    tree: Tree
    odds: np.ndarray
    rate: float = 0.02
    row_rate: float = 0.2
    steps: int = 0

    def __post_init__(self) -> None:
        self.weights, self.mix = start_weights(), start_mix()
        size = len(self.classes)
        self.by_input = np.append(self.classes, [START, NONE])
        self.after = np.append(self.groups, [GROUPS - 1, GROUPS - 1])
        self.ids, self.nodes = np.zeros((size + 2, WIDTH), np.float32), np.zeros((size, WIDTH), np.float32)
        self.id_squares, self.node_squares = np.zeros(size + 2, np.float32), np.zeros(size, np.float32)
        self.met, self.slot = np.zeros(size + 2, bool), np.zeros(size + 2, np.int64)
        self.mean = np.zeros(len(self.vector()))
        self.square = np.zeros_like(self.mean)

    def vector(self) -> np.ndarray:
        return np.append(to_vector(self.weights), self.mix.ravel())

    def slopes(self, queries: np.ndarray, keys: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
        """Of the mean negative log-probability of the target ids: by the vector, and (places, slopes) of the ids' and the nodes' rows."""
        w, none, half = self.weights, len(self.classes) + 1, 2 * WIDTH
        # Each id that the windows have is looked up once.
        self.met[keys] = True
        ids = np.flatnonzero(self.met)
        self.met[ids] = False
        self.slot[ids] = np.arange(len(ids))
        shape, classes, rows = (len(queries), -1, half), self.by_input[ids], self.ids[ids]
        known = np.concatenate([w[k] for k in _PARTS], 1)[classes] + rows @ self.mix
        q_at, k_at = self.slot[queries].ravel(), self.slot[keys].ravel()
        q_own, k_own = (np.ascontiguousarray(t).take(at, axis=0).reshape(shape) for t, at in ((known[:, :half], q_at), (known[:, half:], k_at)))
        query, own, key, value = q_own[..., :WIDTH], q_own[..., WIDTH:], k_own[..., :WIDTH], k_own[..., WIDTH:]
        hidden, context, weight = attend(query, key, value, own, w["distance"], keys == none)
        aim = targets.ravel()
        scored = np.flatnonzero(aim >= 0)
        found, slope = class_slopes(w, class_logs(w, hidden), hidden, np.where(aim >= 0, self.classes[np.maximum(aim, 0)], -1))
        # Along the trees.
        which, node, right = self.tree.ways(aim[scored])
        which = scored[which]
        states, held = hidden.reshape(-1, WIDTH).take(which, axis=0), self.nodes.take(node, axis=0)
        off = (_logistic(steps_right(self.odds, held, states, self.after[queries.ravel()[which]], node)) - right).astype(np.float32) / np.float32(max(len(scored), 1))
        if len(which):
            firsts = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            slope.reshape(-1, WIDTH)[which[firsts]] += np.add.reduceat(off[:, None] * held, firsts, axis=0)
        nodes = _sums(node, off[:, None] * states)
        by_query, by_key, by_value, by_own, found["distance"] = attend_slopes(slope, query, key, value, hidden, context, weight)
        by_row = np.zeros((len(ids), 2 * half), np.float32)
        for at, first, own in ((q_at, 0, (by_query, by_own)), (k_at, half, (by_key, by_value))):
            places, sums = _sums(at, np.concatenate(own, 2).reshape(-1, half))
            by_row[places, first : first + half] = sums
        by_class = _ONE[classes].T @ by_row
        found |= {k: by_class[:, i * WIDTH : (i + 1) * WIDTH] for i, k in enumerate(_PARTS)}
        return np.append(to_vector(found), (rows.T @ by_row).ravel()), (ids, by_row @ self.mix.T), nodes

    def step(self, queries: np.ndarray, keys: np.ndarray, targets: np.ndarray) -> None:
        self.steps += 1
        slope, ids, nodes = self.slopes(queries, keys, targets)
        self.mean = 0.9 * self.mean + 0.1 * slope
        self.square = 0.99 * self.square + 0.01 * slope**2
        slowed = 1 / (1 + self.steps / 100) ** 0.5
        change = (self.mean / (1 - 0.9**self.steps)) / (np.sqrt(self.square / (1 - 0.99**self.steps)) + 1e-8)
        vector = self.vector() - self.rate * slowed * change
        self.weights, self.mix = from_vector(vector), vector[-self.mix.size :].reshape(self.mix.shape).astype(np.float32)
        for (places, own), table, squares in ((ids, self.ids, self.id_squares), (nodes, self.nodes, self.node_squares)):
            squares[places] += np.einsum("ij,ij->i", own, own) / WIDTH
            table[places] -= self.row_rate * own / (np.sqrt(squares[places]) + np.float32(1e-8))[:, None]
