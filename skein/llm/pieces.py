"""Pieces of text (words, mostly) with the token ids of each, kept by a Python worker across batches and tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Pieces kept by a worker; beyond it the store starts anew, which changes no result.
MOST_PIECES = 500_000


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[start : start + size] of the codes, one after another, and their sizes."""
    n = size[codes]
    at = np.repeat(start[codes] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return pool[at], n


class Pieces:
    """A store from a piece to its ids; `encode` gives the ids of new pieces: flat, and how many for each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_PIECES):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, flat, and the number for each piece."""
        if len(self.code) > self.most:
            self._clear()
        codes = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            self._learn(dict.fromkeys(map(pieces.__getitem__, missing.tolist())))
            codes[missing] = np.fromiter((self.code[pieces[k]] for k in missing.tolist()), np.int64, len(missing))
        return gather(self.pool, self.start, self.size, codes)

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ids(), for an Arrow array of pieces without nulls: each different piece of it is looked up once."""
        found = pieces.dictionary_encode()
        ids, size = self.ids(found.dictionary.to_pylist())
        at = found.indices.to_numpy()
        return gather(ids, np.cumsum(size) - size, size, at)

    def _learn(self, new: Iterable[str]) -> None:
        new = list(new)
        flat, size = self.encode(new)
        n = len(self.code)
        self.start, self.size = self._room(self.start, n + len(new)), self._room(self.size, n + len(new))
        self.pool = self._room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(new)] = size
        self.start[n : n + len(new)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.code.update(zip(new, range(n, n + len(new)), strict=True))


def by_text(ids: np.ndarray, size: np.ndarray, pieces_of: list[int]) -> list[np.ndarray]:
    """Cuts flat ids into texts, given the number of pieces of each text."""
    ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(np.asarray(pieces_of, np.int64))]
    return np.split(ids, ends[:-1]) if len(ends) else []
