"""The words of many texts at once, as numbers: a text costs one lookup for each run without white space."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

MOST, LETTERS = 400_000, 20_000_000
#: Characters of the texts that are looked up together; between these the worker may forget.
TOGETHER = 4_000_000


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts in their order, as many at once as ``TOGETHER`` holds, at least one."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > TOGETHER:
            yield texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield texts[lo:]


class Words:
    """Numbers of words, and of the words between white space, remembered by the worker. ``split`` gives the words of a
    text, of which none holds white space."""

    def __init__(self, split: Callable[[str], list[str]]) -> None:
        self.split = split
        self.clear()

    def clear(self) -> None:
        self._runs = _Runs(self.split)
        self.words = self._runs.words  # by number

    def full(self) -> bool:
        """Whether it is time to forget. (The words of one call are kept together.)"""
        return len(self._runs) > MOST or len(self.words) > MOST or self._runs.letters > LETTERS

    def numbers(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the numbers of all of them in their order."""
        ids, upto = array("q"), array("q", [0])
        get, add = self._runs.__getitem__, ids.extend
        for t in texts:
            add(map(get, t.split()))
            upto.append(len(ids))
        ends = np.array(self._runs.ends, np.int64)
        at = np.array(ids, np.int64)
        first, n = ends[at], ends[at + 1] - ends[at]
        before = np.concatenate([[0], np.cumsum(n)])
        flat = np.array(self._runs.flat, np.int64).take(np.arange(before[-1]) + np.repeat(first - before[:-1], n))
        return np.diff(before[np.array(upto, np.int64)]), flat


class _Runs(dict):
    """By a run without white space: its place in ``ends``, the borders of its words' numbers in ``flat``."""

    def __init__(self, split: Callable[[str], list[str]]) -> None:
        self.split, self.words, self.known = split, [], {}
        self.flat, self.ends, self.letters = array("q"), array("q", [0]), 0

    def __missing__(self, run: str) -> int:
        at = self[run] = len(self.ends) - 1
        for w in self.split(run):
            n = self.known.get(w)
            if n is None:
                n = self.known[w] = len(self.words)
                self.words.append(w)
            self.flat.append(n)
        self.ends.append(len(self.flat))
        self.letters += len(run)
        return at
