"""A linear-chain conditional random field with two labels over hashed binary features, in numpy.

Sequences come as flat arrays: ``feats`` (hashed features of all nodes in a row), ``starts`` (where
each node's features begin) and ``lens`` (nodes of each sequence). Training maximises the
regularised conditional likelihood with exact forward-backward gradients; decoding is Viterbi. All
sequences of a batch advance together, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray  # of label 1 against label 0, for each hashed feature
    trans: np.ndarray  # 2 x 2
    begin: np.ndarray  # 2
    end: np.ndarray  # 2

    def scores(self, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """n x 2 unary scores; every node has at least one feature."""
        s = np.add.reduceat(self.weights[feats], starts) if len(starts) else np.empty(0)
        return np.stack([np.zeros_like(s), s], 1)

    def decode(self, feats: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The best label of every node."""
        unary = self.scores(feats, starts)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        n = len(lens)
        back = np.zeros((len(unary), 2), np.int8)
        best = np.zeros((n, 2))
        for t in range(int(lens.max()) if n else 0):
            on = np.flatnonzero(lens > t)
            u = unary[first[on] + t]
            if t == 0:
                best[on] = u + self.begin
            else:
                cand = best[on][:, :, None] + self.trans[None]
                back[first[on] + t] = cand.argmax(1)
                best[on] = cand.max(1) + u
        labels = np.zeros(len(unary), np.int8)
        on = np.flatnonzero(lens > 0)
        state = np.zeros(n, np.int8)
        state[on] = (best[on] + self.end).argmax(1)
        for t in range(int(lens.max()) - 1 if n else -1, -1, -1):
            on = np.flatnonzero(lens > t)
            at = first[on] + t
            labels[at] = state[on]
            state[on] = back[at, state[on]]
        return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(feats: np.ndarray, starts: np.ndarray, lens: np.ndarray, labels: np.ndarray, dim: int, steps: int = 100, l2: float = 0.1, rate: float = 0.15) -> Crf:
    """Fit by Adam on the full gradient. ``labels``: 0 or 1 for every node."""
    crf = Crf(np.zeros(dim), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    if not len(lens) or not len(labels):
        return crf
    n, longest = len(lens), int(lens.max())
    first = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    node_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(feats))))
    on = [np.flatnonzero(lens > t) for t in range(longest)]
    empirical_trans, empirical_begin, empirical_end = np.zeros((2, 2)), np.zeros(2), np.zeros(2)
    for t in range(longest):
        y = labels[first[on[t]] + t]
        if t == 0:
            empirical_begin += np.bincount(y, minlength=2)
        else:
            np.add.at(empirical_trans, (labels[first[on[t]] + t - 1], y), 1)
    empirical_end += np.bincount(labels[(first + lens - 1)[lens > 0]], minlength=2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (crf.weights, crf.trans, crf.begin, crf.end)]
    for step in range(1, steps + 1):
        unary = crf.scores(feats, starts)
        alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))  # by node: sequences of any length take what they hold
        for t in range(longest):
            at = first[on[t]] + t
            alpha[at] = unary[at] + (crf.begin if t == 0 else _lse(alpha[at - 1][:, :, None] + crf.trans[None], 1))
        for t in range(longest - 1, -1, -1):
            last = lens[on[t]] == t + 1
            beta[first[on[t][last]] + t] = crf.end
            rest = first[on[t][~last]] + t
            if len(rest):
                nxt = unary[rest + 1] + beta[rest + 1]
                beta[rest] = _lse(crf.trans[None] + nxt[:, None, :], 2)
        z = np.zeros(n)
        some = on[0] if longest else np.empty(0, int)
        z[some] = _lse(alpha[first[some]] + beta[first[some]], 1)
        p1 = np.zeros(len(unary))
        g_trans, g_begin, g_end = -empirical_trans.copy(), -empirical_begin.copy(), -empirical_end.copy()
        for t in range(longest):
            at = first[on[t]] + t
            p = np.exp(alpha[at] + beta[at] - z[on[t], None])
            p1[at] = p[:, 1]
            if t == 0:
                g_begin += p.sum(0)
            else:
                nxt = unary[at] + beta[at]
                g_trans += np.exp(alpha[at - 1][:, :, None] + crf.trans[None] + nxt[:, None, :] - z[on[t], None, None]).sum(0)
            last = lens[on[t]] == t + 1
            g_end += p[last].sum(0)
        g_weights = np.bincount(feats, (p1 - labels)[node_of], minlength=dim)
        for x, g, (m, v) in zip((crf.weights, crf.trans, crf.begin, crf.end), (g_weights, g_trans, g_begin, g_end), moments, strict=True):
            g = (g + l2 * x) / n
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return crf
