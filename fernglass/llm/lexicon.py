"""A minimal acyclic transducer from words to token ids, and exact byte-pair merging for other words (problem 8).

The lexicon is a minimal deterministic acyclic automaton over the bytes of the frequent words
(built incrementally from the sorted words, equal suffixes shared). Every edge carries the number
of words that come before it, so the numbers along a word's path add up to the word's place in
sorted order, and that place leads to its ids. It is one flat file of numpy arrays: the driver
compiles it, Spark hands the file to every executor, each Python worker maps it into memory (one
copy of the pages for all workers of a machine) and looks up all unknown words of a batch at once.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable

import numpy as np


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equals.

    A heap over a linked list: n log n for any length."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; its right neighbour starts at end[i]
    prev = list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue  # one of the two has been merged since
        alive[j] = False
        end[i] = to
        if to < n:
            prev[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def compile_lexicon(words: Iterable[bytes], ids_of, path: str) -> int:
    """Write the automaton of ``words`` to ``path``; ``ids_of(word)`` gives the ids. Returns the number of words."""
    words = sorted({w for w in words if w})
    # states as mutable edge lists until they are frozen; a frozen state is known by its (final, edges) signature
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        sig = (final, tuple(edges))
        at = register.get(sig)
        if at is None:
            at = register[sig] = len(frozen)
            frozen.append(sig)
        return at

    stack: list[list] = [[False, []]]  # the path of the last word: [final, edges to frozen states]
    last = b""
    for w in [*words, None]:
        common = 0
        if w is not None:
            limit = min(len(w), len(last))
            while common < limit and w[common] == last[common]:
                common += 1
        while len(stack) - 1 > common:
            final, edges = stack.pop()
            stack[-1][1].append((last[len(stack) - 1], freeze(final, edges)))
        if w is None:
            break
        for _ in w[common:]:
            stack.append([False, []])
        stack[-1][0] = True
        last = w
    root = freeze(*stack[0])

    count = np.zeros(len(frozen), np.int64)
    for i, (final, edges) in enumerate(frozen):  # children are frozen before their parents
        count[i] = int(final) + sum(count[to] for _, to in edges)
    key, target, before = [], [], []
    for i, (final, edges) in enumerate(frozen):
        n = int(final)
        for label, to in edges:
            key.append(i * 256 + label)
            target.append(to)
            before.append(n)
            n += count[to]
    ids = [ids_of(w) for w in words]
    arrays = {
        "key": np.array(key, np.int64),
        "target": np.array(target, np.int32),
        "before": np.array(before, np.int32),
        "final": np.array([f for f, _ in frozen], np.uint8),
        "start": np.cumsum([0, *map(len, ids)]).astype(np.int64),
        "ids": np.array([x for i in ids for x in i], np.int32),
    }
    head, at = {"root": root, "words": len(words), "arrays": {}}, 0
    for k, a in arrays.items():
        head["arrays"][k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    return len(words)


class Lexicon:
    """The mapped automaton."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        self.root, self.words = head["root"], head["words"]
        size = os.path.getsize(path)
        for k, (kind, length, at) in head["arrays"].items():
            setattr(self, k, np.memmap(path, kind, "r", 8 + n + at, (length,)) if length and 8 + n + at < size else np.empty(0, kind))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1: all words walk the automaton together, byte by byte."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.key):
            return out
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root, np.int64)
        place = np.zeros(len(words), np.int64)
        live = np.flatnonzero(lens > 0)
        step = 0
        while len(live):
            k = state[live] * 256 + flat[starts[live] + step]
            e = np.searchsorted(self.key, k)
            e[e == len(self.key)] = 0
            ok = self.key[e] == k
            live, e = live[ok], e[ok]
            place[live] += self.before[e]
            state[live] = self.target[e]
            step += 1
            done = lens[live] == step
            ended = live[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = place[ended]
            live = live[~done]
        return out

    def get(self, place: int) -> tuple[int, ...]:
        return tuple(self.ids[self.start[place] : self.start[place + 1]].tolist())
