"""Word shingles of whole texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tillscope.llm.common import ASCII_LOWER, mixed

SLICE_BYTES = 480_000  # texts hashed together; one longer text is hashed alone

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(20240502).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[size] = (both[0], both[1])
    up, down = _powers[size]
    return up[:n], down[:n]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, down): the hash of bytes i to j is ``(p[j] - p[i]) * down[i]``, wherever they stand."""
    up, down = powers(len(data) + 1)
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[:-1], out=p[1:])
    return p, down


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE_BYTES:
            yield first, i
            first, held = i, 0
        held += len(text)
    if len(texts) > first:
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text in order, and how many words each text has. Letters A to Z count as small."""
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(ASCII_LOWER), dtype=np.uint8)
    gap = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13))])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    p, down = prefix_hashes(data)
    words = mixed((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.bincount(np.searchsorted(bounds, starts, side="right"), minlength=len(texts))


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and how many each has.

    Letters A to Z count as small. A text of fewer words than ``width`` has its whole sequence as one shingle; one without
    words has none.
    """
    words, count = word_hashes(texts)
    text_of = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        total[: len(words) - k] += words[k:] * _PLACE[k]
    whole = place + width <= count[text_of]
    hashes, owner = mixed(total[whole]), text_of[whole]
    if ((count > 0) & (count < width)).any():
        few = np.flatnonzero((count > 0) & (count < width))
        first = (np.cumsum(count) - count)[few]
        short = np.array([(words[a : a + n] * _PLACE[:n]).sum() for a, n in zip(first, count[few], strict=True)], dtype=np.uint64) + count[few].astype(np.uint64) * _PLACE[40]
        hashes, owner = np.concatenate([hashes, mixed(short)]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)
