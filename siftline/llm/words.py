"""Caches for what is computed once per word and looked up often, inside a Python worker."""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: Entries of one generation of a cache; longer words are computed each time. Two generations take about 90 MB at most.
ENTRIES, LONGEST = 220_000, 64

_current: list = []


def sole(cache: WordCache) -> WordCache:
    """The cache, after emptying the one that the same worker used before, if another: a worker serves stage after stage."""
    if not _current or _current[0] is not cache:
        forget()
        _current[:] = [cache]
    return cache


def forget() -> None:
    """Empty the cache that the worker used before, and let go of it: for tasks without one, and where one is of no use to the next task."""
    for other in _current:
        other.young, other.old = {}, {}
    _current.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class WordCache:
    """word -> compute([word])[0], for many words at a time. What was not asked for during a whole generation is forgotten."""

    def __init__(self, compute, entries: int = ENTRIES):
        self.compute, self.entries, self.young, self.old = compute, entries, {}, {}

    def all(self, words: list) -> list:
        """The value of each word, in order."""
        young, old = self.young, self.old
        long = []
        if missing := set(words).difference(young):
            new = []
            for w in missing:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
            young.update(zip(new, self.compute(new)))
            long = [w for w in new if len(w) > LONGEST]
        got = list(map(young.__getitem__, words))
        for w in long:
            del young[w]
        if len(young) > self.entries:
            self.old, self.young = young, {}
        return got


def slices(total: int, sizes: list[int], most: int):
    """Ranges of consecutive items whose sizes add up to at most `most`, or of one larger item."""
    start = held = 0
    for i in range(total):
        if held and held + sizes[i] > most:
            yield start, i
            start, held = i, 0
        held += sizes[i]
    if start < total:
        yield start, total
