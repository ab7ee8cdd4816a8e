"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, blind tries for what is still equal there."""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 5  # of 8 bytes each


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """The first bytes of each suffix as big-endian words, filled up with zeros behind its end."""
    offsets = np.arange(8 * words)
    places = starts[:, None] + offsets
    grid = np.where(places < ends[:, None], data[np.minimum(places, len(data) - 1)], 0).astype(np.uint8)
    return np.ascontiguousarray(grid).view(">u8").astype(np.uint64)


def shallow_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, all segments of a level at once: the order, and the first place of each group of equal words.

    Every round splits each open segment at its middle element's word into smaller, equal and larger; the equal part goes
    on with the next word.
    """
    n, depth_end = words.shape
    order, segment, depth = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while n:
        size = np.bincount(segment, minlength=len(depth))
        open_segments = (size > 1) & (depth < depth_end)
        if not open_segments.any():
            break
        first = np.cumsum(size) - size
        at = np.flatnonzero(open_segments[segment])
        own = segment[at]
        key = words[order[at], depth[own]]
        pivot = words[order[first + size // 2], np.minimum(depth, depth_end - 1)][own]
        side = np.ones(n, dtype=np.int64)
        side[at] = 1 + (key > pivot) - (key < pivot).astype(np.int64)
        move = np.argsort(segment * 3 + side, kind="stable")
        order, label = order[move], (segment * 3 + side)[move]
        new = np.r_[True, label[1:] != label[:-1]]
        segment = np.cumsum(new) - 1
        heads = label[new]
        depth = depth[heads // 3] + ((heads % 3 == 1) & open_segments[heads // 3])
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if n else np.zeros(0, np.int64)
    return order, starts


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to agree."""
    end = min(len(a), len(b))
    while known < end:
        step = min(known + 64, end)
        if a[known:step] != b[known:step]:
            while a[known] == b[known]:
                known += 1
            return known
        known = step
    return end


class BlindTrie:
    """A trie over suffixes whose inner nodes know only the depth at which their suffixes differ and the bytes found there.

    A suffix walks down by these bytes alone, is compared once with the leaf it ends at, and is then attached at the depth
    where the two differ.
    """

    def __init__(self, first: int, suffixes: list[bytes]) -> None:
        self.suffixes = suffixes
        self.root: list = [None, [first]]  # [depth, children] or [None, equal suffixes]

    def insert(self, i: int, known: int) -> None:
        text, node = self.suffixes[i], self.root
        while node[0] is not None:
            byte = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = self.suffixes[node[1][0]]
        depth = common_prefix(text, other, known)
        if depth == len(text) == len(other):
            node[1].append(i)
            return
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][text[node[0]]]
        ours, theirs = (s[depth] if depth < len(s) else -1 for s in (text, other))
        if node[0] == depth:
            node[1][ours] = [None, [i]]
        else:
            node[1] = {theirs: [node[0], node[1]], ours: [None, [i]]}
            node[0] = depth

    def walk(self) -> list[tuple[int, int]]:
        """(suffix, common prefix with the one before) in order; the first has 0."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                out.append((node[1][0], before))
                out += [(i, len(self.suffixes[i])) for i in node[1][1:]]
            else:
                children = sorted(node[1].items())
                stack += [(child, node[0] if k else before) for k, (_, child) in reversed(list(enumerate(children)))]
        return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shallow: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``data[start:end]`` in order, and each one's common prefix with the one before.

    Common prefixes are counted exactly inside groups that agree on the ``shallow`` words; between groups, where they are
    shorter than that, 0 stands for them.
    """
    order, groups = shallow_order(_words(data, starts, ends, shallow))
    common = np.zeros(len(order), dtype=np.int64)
    raw = data.tobytes()
    sizes = np.diff(np.r_[groups, len(order)])
    for first, size in zip(groups[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        members = order[first : first + size]
        suffixes = [raw[a:b] for a, b in zip(starts[members].tolist(), ends[members].tolist(), strict=True)]
        known = min(8 * shallow, min(map(len, suffixes)))
        trie = BlindTrie(0, suffixes)
        for i in range(1, size):
            trie.insert(i, known if len(suffixes[i]) >= known else 0)
        walked = trie.walk()
        order[first : first + size] = members[[i for i, _ in walked]]
        common[first : first + size] = [c for _, c in walked]
    return order, common
