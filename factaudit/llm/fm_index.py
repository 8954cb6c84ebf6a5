"""A full-text index after Burrows and Wheeler in numpy, searched backward for many patterns at once.

The index keeps the transform of a text in the order of its symbols (the places of each symbol, in one
sorted array), and the text number of each suffix.  A backward step narrows the range of suffixes that
start with a pattern by one symbol to the left; with the sorted places it is a binary search, whatever
the size of the alphabet.  One step is taken for all open (pattern, end) lanes together.

Texts and patterns carry a key each: symbols are told apart by key, so a pattern finds only texts of
its own key, and one index serves a whole shard of keys.
"""

from __future__ import annotations

import numpy as np


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)


class BackwardIndex:
    """Index over texts; symbol 0 ends each text, so that no match runs across two of them."""

    def __init__(self, texts: list[str], keys: np.ndarray):
        self.keys = np.unique(keys)
        flat = [_points(t) for t in texts]
        self.alphabet = np.unique(np.concatenate(flat)) if sum(map(len, flat)) else np.zeros(1, dtype=np.int64)
        parts, owners = [], []
        for i, (p, k) in enumerate(zip(flat, np.searchsorted(self.keys, keys))):
            symbols = np.searchsorted(self.alphabet, p) + 1 + k * len(self.alphabet)
            parts.append(np.append(symbols, 0))
            owners.append(np.full(len(p) + 1, i, dtype=np.int32))
        text = np.concatenate(parts) if parts else np.zeros(1, dtype=np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(1, dtype=np.int32)
        order = _suffix_array(text)
        self.size = len(text)
        self.doc = owner[order]
        self.last = text[order - 1]
        self.places = np.sort(self.last * self.size + np.arange(self.size))

    def encode(self, text: str, key: int) -> np.ndarray:
        """Symbols of a pattern; -1 where no indexed text of any key has the character."""
        p = _points(text)
        k = np.searchsorted(self.keys, key)
        if k >= len(self.keys) or self.keys[k] != key:
            return np.full(len(p), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, p), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == p, at + 1 + k * len(self.alphabet), -1)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.places, symbol * self.size + low), np.searchsorted(self.places, symbol * self.size + high)


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank.max() == n - 1 or width >= n:
            return order
        width *= 2


def maximal_matches(index: BackwardIndex, patterns: list[str], keys: np.ndarray, least: int, wide: int):
    """Arrays (pattern, start, end, text) of matches that cannot be extended to the left in their text.

    For each end of a pattern the match is extended symbol by symbol; the texts that fall away at a
    step have their maximal match there.  A match shorter than half of its pattern is reported only
    while at most ``wide`` places have it: a longer or rarer one tells the same pair.  Patterns that
    find nothing under this rule report all their matches.
    """
    codes = [index.encode(p, k) for p, k in zip(patterns, keys)]
    found = _extend(index, codes, np.arange(len(codes)), least, wide)
    without = np.setdiff1d(np.arange(len(codes)), found[0])
    rest = _extend(index, [codes[i] for i in without], without, least, index.size)
    return tuple(np.concatenate([a, b]) for a, b in zip(found, rest))


def _extend(index, codes, numbers, least, wide):
    out = [[], [], [], []]
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    if len(codes) and lengths.sum():
        flat = np.concatenate(codes)
        offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(codes)), lengths)
        place = np.arange(len(flat)) - offset[owner]
        lanes, low, high = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int64), np.full(len(flat), index.size, dtype=np.int64)
        size = 0  # symbols matched so far, the same for all open lanes
        while len(lanes):
            at = place[lanes] - size
            symbol = np.where(at >= 0, flat[offset[owner[lanes]] + np.maximum(at, 0)], -1)
            if size >= least:
                report = (high - low <= wide) | (2 * size >= lengths[owner[lanes]])
                n = (high - low)[report]
                lane = np.repeat(np.flatnonzero(report), n)
                spot = low[lane] + np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
                ends_here = index.last[spot] != symbol[lane]
                lane, spot = lane[ends_here], spot[ends_here]
                mine = lanes[lane]
                for column, values in zip(out, (numbers[owner[mine]], place[mine] + 1 - size, place[mine] + 1, index.doc[spot])):
                    column.append(values)
            known = symbol > 0
            lanes, low, high, symbol = lanes[known], low[known], high[known], symbol[known]
            low, high = index.step(low, high, symbol)
            goes = low < high
            lanes, low, high = lanes[goes], low[goes], high[goes]
            size += 1
    return tuple(np.concatenate(c).astype(np.int64) if c else np.zeros(0, dtype=np.int64) for c in out)
