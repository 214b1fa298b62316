"""Subword ids of whole texts, with a bounded cache of the words met before."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from itertools import count
import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Cached chunks of a Python worker: so many new ones, and as many met before those.
CACHE_ROWS = 500_000
#: Python's split() of a str ends chunks at these, the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Its lower case depends on its place in Python, and not in the tokenizer.
_SIGMA = "\u03a3"
#: Punctuation that the tokenizer parts from letters before it, and that begins none of its special tokens or contractions.
_TAILS = ".,;:!?#$%&*"
_open: dict[str, TokenCache] = {}


def forget() -> None:
    """Drop the caches of this Python worker: another step's tasks follow in it, and need the memory."""
    _open.clear()


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenCache:
    """Ids of a text as little-endian 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its chunks between ASCII white space. A chunk of letters followed by
    punctuation is two words to the tokenizer, so these are coded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.merges = self.tokenizer.model
        # The byte alphabet: printable bytes stand for themselves, the others for the letters from 256 on.
        other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.alphabet = {b: 256 + i for i, b in enumerate(other)}
        self.ends_word = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def open(cls, path: str) -> TokenCache:
        """One cache for each tokenizer and Python worker."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def _whole(self, chunk: str) -> bytes:
        return _bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are letters alone: one word to the tokenizer, so its merges are asked directly, in its alphabet of bytes."""
        found: dict[str, bytes] = {}
        tokenize = self.merges.tokenize
        for word in words:
            if word.isascii():
                found[word] = _bytes([t.id for t in tokenize(word)])
            elif word.isalpha() and unicodedata.is_normalized("NFC", word):
                found[word] = _bytes([t.id for t in tokenize(word.encode().decode("latin-1").translate(self.alphabet))])
            else:
                found[word] = self._whole(word)
        return found

    def learn(self, chunks: set[str]) -> None:
        """Add chunks to the cache; what two generations of it have not met again is forgotten."""
        if len(self.known) + len(chunks) > CACHE_ROWS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        whole, lowered, tails, bodies = [], [], [], {}  # lists of texts alone, which Python need not search for cycles
        for chunk in chunks:
            if (ids := older.get(chunk)) is not None:
                known[chunk] = ids
            elif (body := chunk.rstrip(_TAILS)).isalpha() and _SIGMA not in body:
                lower = body.lower()
                if lower not in bodies:
                    bodies[lower] = known.get(lower) or older.get(lower)
                whole.append(chunk)
                lowered.append(lower)
                tails.append(chunk[len(body) :])
            else:
                known[chunk] = self._whole(chunk)
        bodies.update(self._letters([b for b, ids in bodies.items() if ids is None]))
        ends = {t: self._whole(t) if t else b"" for t in set(tails)}
        for chunk, lower, tail in zip(whole, lowered, tails):
            known[chunk] = bodies[lower] + ends[tail]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        found: list[bytes] = []
        for at in range(0, len(chunks), CACHE_ROWS):
            some = chunks[at : at + CACHE_ROWS]
            held = list(map(self.known.get, some))
            if None in held:
                self.learn({c for c, ids in zip(some, held) if ids is None})
                known = self.known
                held = [known[c] if ids is None else ids for c, ids in zip(some, held)]
            found += held
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        found: list[bytes] = []
        for at in range(0, len(texts), 500):
            some = [t or "" for t in texts[at : at + 500]]
            split = [t.split() for t in some]
            get = self.known.get
            ids = [list(map(get, s)) for s in split]
            part = [row for row, got in enumerate(ids) if None in got]
            if part:
                self.learn({c for row in part for c, x in zip(split[row], ids[row]) if x is None})
                known = self.known
                for row in part:
                    ids[row] = [known[c] if x is None else x for c, x in zip(split[row], ids[row])]
            found += [self._whole(t) if _ODD.search(t) else b"".join(x) for t, x in zip(some, ids)]
        return found

    def encode_words(self, rows: list[np.ndarray], vocabulary: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that ``index_chunks`` has taken apart, gathered for all of them at once."""
        ids = self.chunk_ids([c.decode("utf-8", "surrogatepass") for c in vocabulary])
        flat, sizes = np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        found = []
        for at in range(0, len(rows), 500):
            some = rows[at : at + 500]
            words = np.concatenate([*some, np.empty(0, np.int32)])
            n = sizes[words]
            ends = np.cumsum(n)
            gathered = flat[np.repeat(starts[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.append(0, ends)[np.cumsum([len(r) for r in some])]
            found += np.split(gathered, cuts[:-1])
        return found


def index_chunks(split: Iterable[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """(rows, vocabulary): each text's chunks as places in the list of distinct chunks."""
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    rows = [np.fromiter(map(index.__getitem__, s), np.int32, len(s)) for s in split]
    return rows, list(index)
