"""Encoding whole texts with a public tokenizer, each distinct piece of text once.

Texts are cut before single spaces and around single line feeds that stand
between characters that aren't white space. The pre-tokenizers of both
vocabularies cut there too, so encoding piece by piece gives the ids of the
whole text. Pieces are told apart by two independent 64-bit hashes (together
128 bits), and only pieces not met before go to the tokenizers library.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd

#: Bytes of pieces and their ids remembered between batches. A memory bound only: the memory is emptied and filled anew.
MAX_BYTES = 48 << 20
#: Bytes of text worked on at once (a longer text is worked on alone).
BATCH_BYTES = 1_000_000


def text_slices(frames, column: str, limit: int = BATCH_BYTES, encodes: bool = False):
    """Cut Arrow batches into slices of about ``limit`` bytes of text (a longer text is a slice of its own).

    Work that doesn't encode frees what an earlier stage's encoders have left in the worker. Before and
    after, memory that the worker no longer uses goes back to the system: its neighbours need it.
    """
    import pyarrow.compute as pc

    if not encodes:
        _kept().clear()
    give_back()
    for f in frames:
        upto = np.cumsum(pc.binary_length(f.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < f.num_rows:
            before = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + limit, "right")))
            yield f.slice(a, b - a)
            a = b
        del f, upto
    give_back()


def piece_starts(buf: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Offsets at which a piece starts, in a buffer of concatenated UTF-8 texts."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero((buf == 32) | (buf == 10))
    at = at[(at > 3) & (at < n - 1)]
    prev, prev2, prev3, nxt = buf[at - 1], buf[at - 2], buf[at - 3], buf[at + 1]
    # white space outside ASCII starts with C2, E1, E2 or E3: next to such bytes nothing is cut
    ok = (prev > 32) & (nxt > 32) & ~((prev >= 0x80) & ((prev2 == 0xC2) | ((prev3 >= 0xE1) & (prev3 <= 0xE3))))
    ok &= ~((nxt == 0xC2) | ((nxt >= 0xE1) & (nxt <= 0xE3)))
    at = at[ok]
    cut[at] = True
    cut[at[buf[at] == 10] + 1] = True
    cut[text_starts[text_starts < n]] = True
    return np.flatnonzero(cut[:n])


_PROBES = ("word", " word", "Straße", " Éclair", " naïveté", " The", "ЖЖ", " ñandúes")
# Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """``encode`` texts to ids; ``path`` is a tokenizers JSON file."""

    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.max_bytes = max_bytes
        self._draw(4096)
        self.model = self.tok.model
        norm = self.tok.normalizer
        self.lower = norm is not None and norm.normalize_str("AbZ") == "abz"
        self.plain = norm is None or self.lower or norm.normalize_str("AbZ") == "AbZ"
        self.space = self._plan()
        self.marks = {m: self.tok.encode(m, add_special_tokens=False).ids for m in ".,"}
        self._clear()

    def _draw(self, n: int):
        """Fixed odd multipliers for the characters of a piece, for two hashes."""
        self.weights = [np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (7, 8)]

    def _clear(self):
        # pieces met: their hashes in order of the first, and the row that holds their ids
        self.h1, self.h2, self.row = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.ids = np.empty(1 << 20, np.uint32)
        self.first = np.empty(1 << 18, np.int32)
        self.count = np.empty(1 << 18, np.int32)
        self.used, self.rows = 0, 0

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 if it wasn't met."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), self.row[at], -1)

    def _plan(self):
        """How a lone word reaches the model: its space as a byte, or dropped; None if neither holds."""
        for space in ("\u0120", ""):
            if all(self._word(space, w) == self.tok.encode(w, add_special_tokens=False).ids for w in _PROBES):
                return space
        return None

    def _word(self, space: str, piece: str) -> list[int] | None:
        """Ids of a piece that is one word of letters (after an optional space); None if it isn't."""
        word = piece[1:] if piece[0] == " " else piece
        if not word.isascii() or not self.plain:
            word = self.tok.normalizer.normalize_str(word) if self.tok.normalizer else word
        elif self.lower:
            word = word.lower()
        if not word.isalpha():
            return None
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(space + word if piece[0] == " " else word)]

    def _learn(self, new: list[str], bases: list[int]) -> int:
        """Encode pieces not met before; ``bases`` holds the rows of pieces less their last mark (-1: not met)."""
        encoded: list = [None] * len(new)
        slow = []
        fresh: dict[str, list[int]] = {}
        for i, (piece, known) in enumerate(zip(new, bases)):
            tail = piece[-1] if len(piece) > 2 and piece[-1] in self.marks else ""
            base = piece[:-1] if tail else piece
            got = fresh.get(base)
            if got is None and tail and known >= 0:
                got = self.ids[self.first[known] : self.first[known] + self.count[known]].tolist()
            if got is None and self.space is not None:
                got = self._word(self.space, base)
            if got is None or (tail and not base[1:].isalpha()):
                slow.append(i)
                continue
            fresh[base] = got
            encoded[i] = got + self.marks[tail] if tail else got
        if slow:
            for i, e in zip(slow, self.tok.encode_batch_fast([new[i] for i in slow], add_special_tokens=False)):
                encoded[i] = e.ids
        lens = np.fromiter(map(len, encoded), np.int32, len(encoded))
        total, n0 = int(lens.sum()), self.rows
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n0 + len(new) > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
        self.first[n0 : n0 + len(new)] = self.used + np.cumsum(lens) - lens
        self.count[n0 : n0 + len(new)] = lens
        self.used += total
        self.rows += len(new)
        return n0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        text_starts = np.cumsum(lens) - lens
        data = b"".join(texts)
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(data, np.uint8)
        starts = piece_starts(buf, text_starts[lens > 0])
        size = np.diff(np.append(starts, len(buf)))
        longest = int(size.max())
        if longest > len(self.weights[0]):
            self._draw(longest)
            self._clear()  # the first multipliers stay, but their number shapes the draw
        place = np.arange(len(buf), dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
        letters = buf.astype(np.uint64) + np.uint64(1)
        h1, h2 = (np.add.reduceat(letters * w[place], starts) for w in self.weights)
        group, uniques = pd.factorize(h1)
        rep = np.empty(len(uniques), np.int64)
        rep[group[::-1]] = np.arange(len(group) - 1, -1, -1)
        odd = np.flatnonzero(h2 != h2[rep[group]])  # two pieces of one first hash
        if len(odd):
            group[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        if 28 * self.rows + 4 * self.used > self.max_bytes:  # hashes, row, place and number of ids; the ids
            self._clear()
        found = self._find(h1[rep], h2[rep])
        new = np.flatnonzero(found < 0)
        if len(new):
            r = rep[new]
            begin, last = starts[r], starts[r] + size[r] - 1
            # the hash of a piece less its last character is a subtraction away
            less = (h[r] - letters[last] * w[size[r] - 1] for h, w in zip((h1, h2), self.weights))
            bases = self._find(*less)
            n0 = self._learn([data[a : b + 1].decode("utf-8") for a, b in zip(begin.tolist(), last.tolist())], bases.tolist())
            found[new] = n0 + np.arange(len(new))
            order = np.argsort(h1[r])
            at = np.searchsorted(self.h1, h1[r][order])
            self.h1, self.h2 = np.insert(self.h1, at, h1[r][order]), np.insert(self.h2, at, h2[r][order])
            self.row = np.insert(self.row, at, found[new][order].astype(np.int32))
        row = found[group]
        n_ids = self.count[row].astype(np.int64)
        ends = np.cumsum(n_ids)
        flat = self.ids[np.repeat(self.first[row].astype(np.int64) - (ends - n_ids), n_ids) + np.arange(int(ends[-1]))]
        # ids per text: pieces never span texts
        upto = np.concatenate([[0], ends])
        first_piece = np.searchsorted(starts, text_starts)
        last_piece = np.searchsorted(starts, text_starts + lens)
        return flat, upto[last_piece] - upto[first_piece]


def _kept() -> dict:
    # functions travel to the workers by value, so module globals are new in each task;
    # what a worker keeps between its tasks lies in a module object of its own
    return sys.modules.setdefault("_sparkclust_worker", ModuleType("_sparkclust_worker")).__dict__.setdefault("encoders", {})


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between the tasks of a worker until work that doesn't encode."""
    kept = _kept()
    for other in kept.keys() - {path}:
        del kept[other]
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def give_back() -> None:
    """Return unused memory of the Arrow pool and, where it can, of the C library to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as byte strings, null as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]
