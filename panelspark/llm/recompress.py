"""Locally consistent parsing of word sequences: runs and pairs are named, round after round.

A name is a hash of what it stands for, so that equal substrings get equal names on every machine; a
pair of neighbouring names is joined if the round's bit of the left one is 0 and of the right one 1.
Which names a stretch of words gets inside therefore depends on the words around only near its ends:
every name carries the span of words it was decided by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from panelspark.llm.common import mix64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xA0761D6478BD642F)
_SECOND = np.uint64(0xE7037ED1A0B428DB)

#: Rounds of pairs. Names grow by a third a round; after 12 they are about as long as a window of 35.
ROUNDS = 12


@dataclass
class Names:
    """Names of one round that can tell windows apart, by position: what they are and the span
    ``[low, high)`` of words that decided them. Both ends rise."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def parse(words: np.ndarray, wall: np.ndarray, reach: int) -> list[Names]:
    """Names made in each round, from single words and runs on, whose span is at most ``reach`` words.

    ``words`` are hashes of words, texts divided by positions where ``wall`` is set; no name crosses
    a wall, and a name decided by a wall has it in its span.
    """
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | wall[1:] | wall[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    length = (end - start).astype(np.uint64)
    name, blocked = mix64(words[start] + length * _GOLD), wall[start]
    low, high = start - 1, end + 1  # a run is known by its neighbours
    rounds = []

    def note(chosen: np.ndarray) -> None:
        chosen &= (high - low <= reach) & ~blocked
        rounds.append(Names(name[chosen], low[chosen], high[chosen]))

    note(np.ones(len(name), bool))
    # As many rounds for every input: which round names a window must not depend on other texts.
    while len(name) > 1 and len(rounds) <= ROUNDS:
        level = np.uint64(len(rounds))
        salt = np.uint64((len(rounds) * int(_FIRST)) & 0xFFFFFFFFFFFFFFFF)
        bit = (mix64(name + salt) >> np.uint64(63)).astype(bool)
        joins = ~bit[:-1] & bit[1:] & ~blocked[:-1] & ~blocked[1:]
        left = np.append(joins, False)
        right = np.append(False, joins)
        after_high, before_low = np.append(high[1:], high[-1] + 1), np.append(low[0] - 1, low[:-1])
        # What stays alone stays so because of the neighbour it might have joined.
        new_low = np.where(~left & ~right & bit, before_low, low)
        new_high = np.where(~left & ~right & ~bit, after_high, high)
        at = np.flatnonzero(left)
        name = name.copy()
        name[at] = mix64(mix64(name[at] + level) * _GOLD + name[at + 1])
        new_high[at] = high[at + 1]
        keep = ~right
        name, low, high, blocked, fresh = name[keep], new_low[keep], new_high[keep], blocked[keep], left[keep]
        note(fresh)
    return rounds


class Ranges:
    """Hashes of any range of words, twice 64 bits."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.back = [], []
        for p in (_FIRST | np.uint64(1), _SECOND | np.uint64(1)):
            power = np.full(n + 1, p, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            inverse = np.full(n + 1, np.uint64(pow(int(p), -1, 1 << 64)), np.uint64)
            inverse[0] = 1
            self.back.append(np.multiply.accumulate(inverse))
            self.sums.append(np.append(np.uint64(0), np.cumsum(mix64(words ^ p) * power[:-1], dtype=np.uint64)))

    def hash(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return mix64((self.sums[which][end] - self.sums[which][start]) * self.back[which][start])


@dataclass
class Anchors:
    """Groups of neighbouring windows ``first`` to ``last`` that contain the same name: equal windows
    contain equal names. ``extent`` is the hash of all words of the group."""

    name: np.ndarray
    extent: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(words: np.ndarray, wall: np.ndarray, window: int, ranges: Ranges) -> Anchors:
    """For each window of ``window`` words without a wall, the leftmost name of the highest round that
    only words of the window have decided; a window inside a long run, which has none, is named by
    its words. Neighbours with the same name make a group."""
    none = Anchors(*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)
    if len(words) < window:
        return none
    walls = np.append(0, np.cumsum(wall))
    starts = np.flatnonzero(walls[window:] == walls[:-window])
    if not len(starts):
        return none
    name, tag = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    left, base = np.arange(len(starts)), 0
    for names in reversed(parse(words, wall, window)):
        if len(names.name) and len(left):
            at = starts[left]
            j = np.searchsorted(names.low, at)
            inside = j < len(names.low)
            inside[inside] &= names.high[j[inside]] <= at[inside] + window
            hit, found = left[inside], j[inside]
            name[hit], tag[hit] = names.name[found], base + found
            left = left[~inside]
        base += len(names.name)
    name[left], tag[left] = ranges.hash(starts[left], starts[left] + window, 1), base + left
    cut = np.append(True, (tag[1:] != tag[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = starts[cut]
    last = starts[np.append(np.flatnonzero(cut)[1:] - 1, len(starts) - 1)]
    return Anchors(name[cut], ranges.hash(first, last + window) ^ (last - first).astype(np.uint64) * _GOLD, first, last)
