"""Ids of distinct words, each encoded once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class WordTable:
    """Words met so far and their ids: one flat array, a start and a length per word.

    ``encode`` gives the ids of many words one after another and how many each has. When the table would exceed ``limit``
    words it starts anew; what it returns is the same either way.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict = {}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def batch(self, texts: list[list]) -> list[np.ndarray]:
        """The ids of each text, given as its words in order. Words not met yet are encoded together."""
        words = list(chain.from_iterable(texts))
        place = self._find(words)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = list({words[i] for i in missing.tolist()})
            if self.place and len(self.place) + len(new) > self.limit:
                self._clear()
                missing, new = np.arange(len(words)), list(set(words))
            ids, lengths = self.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
            place[missing] = self._find([words[i] for i in missing.tolist()])
        length = self.length[place]
        ids = ragged(self.flat, self.start[place], length)
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *map(len, texts)])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What this worker process made for ``key`` in its first task that asked."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what earlier tasks of this worker process have kept; an operator that keeps nothing begins with it."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
