"""Linear-chain conditional random field over many sequences at once, in numpy.

Sequences are cut into segments of SEGMENT steps that advance together. A segment of a longer sequence first gets
its transfer matrix; the matrices give, exactly, the forward message that enters each segment and the backward
message that enters from the other side; then all segments are run forward and backward. So a text of a million
words takes no more rounds than one of SEGMENT words.
"""

from __future__ import annotations

import numpy as np

#: Steps of a segment, and steps between normalisations of messages.
SEGMENT, NORMAL = 512, 8


class Chains:
    """Forward-backward over sequences. scores: a row of label scores a step; lengths: steps of each sequence (not
    0); move: scores of transitions; begin: scores of first labels."""

    def __init__(self, scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.x = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
        self.a, self.begin = np.exp(move - move.max()), np.exp(begin - begin.max())
        self.labels = len(begin)
        parts = -(-lengths // SEGMENT)
        first = np.cumsum(lengths) - lengths
        self.sequence = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(self.sequence)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[self.sequence] + nth * SEGMENT
        size = np.minimum(lengths[self.sequence] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.sequence, self.start, self.size = self.sequence[order], start[order], size[order]
        place = np.empty(len(order), np.int64)  # by sequence and part
        place[order] = np.arange(len(order))
        self.place, self.parts, self.head = place, parts, np.cumsum(parts) - parts
        self.active = np.searchsorted(-self.size, -np.arange(1, (self.size.max() if len(size) else 0) + 1), side="right")

    def _transfers(self, chosen: np.ndarray) -> np.ndarray:
        """The matrix of each chosen segment (ascending): from the message that enters to the one after its last step."""
        p = np.zeros((len(chosen), self.labels, self.labels))
        p[:, range(self.labels), range(self.labels)] = self.x[self.start[chosen]]
        start, size = self.start[chosen], self.size[chosen]
        for t in range(1, int(size.max())):
            n = int(np.searchsorted(-size, -t))
            p[:n] = (p[:n] @ self.a) * self.x[start[:n] + t][:, None, :]
            if t % NORMAL == 0:
                p[:n] /= p[:n].max((1, 2))[:, None, None]
        return p / p.max((1, 2))[:, None, None]

    def _messages(self) -> tuple[np.ndarray, np.ndarray]:
        """For each segment, the forward message on its first step and the backward message on its last."""
        into = np.tile(self.begin, (len(self.size), 1))
        after = np.ones((len(self.size), self.labels))
        if len(long := np.flatnonzero(self.parts > 1)):
            several = np.zeros(len(self.size), bool)
            several[self.place[np.concatenate([np.arange(self.head[k], self.head[k] + self.parts[k]) for k in long])]] = True
            chosen = np.flatnonzero(several)
            transfer = np.empty((len(self.size), self.labels, self.labels))
            transfer[chosen] = self._transfers(chosen)
            for k in range(1, int(self.parts.max())):
                own = long[self.parts[long] > k]
                here, before = self.place[self.head[own] + k], self.place[self.head[own] + k - 1]
                m = np.einsum("ni,nij->nj", into[before], transfer[before]) @ self.a
                into[here] = m / m.sum(1, keepdims=True)
            for k in range(int(self.parts.max()) - 2, -1, -1):
                own = long[self.parts[long] > k + 1]
                here, behind = self.place[self.head[own] + k], self.place[self.head[own] + k + 1]
                m = np.einsum("nij,nj->ni", transfer[behind], after[behind]) @ self.a.T
                after[here] = m / m.sum(1, keepdims=True)
        return into, after

    def marginals(self, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each step; and, if `pairs`, expected counts of transitions over all steps."""
        into, after = self._messages()
        alpha, x, a = np.empty_like(self.x), self.x, self.a
        m = into * x[self.start]
        alpha[self.start] = m = m / m.sum(1, keepdims=True)
        for t in range(1, len(self.active)):
            at = self.start[: self.active[t]] + t
            m = (m[: len(at)] @ a) * x[at]
            if t % NORMAL == 0:
                m /= m.sum(1, keepdims=True)
            alpha[at] = m
        out, counts = alpha, np.zeros_like(a)
        beta = after
        entering = np.ones((len(self.size), self.labels))
        for t in range(len(self.active) - 1, -1, -1):
            n = int(self.active[t])
            at, ended = self.start[:n] + t, int(self.active[t + 1]) if t + 1 < len(self.active) else 0
            b = np.concatenate([entering[:ended], beta[ended:n]])
            forward = alpha[at]
            g = forward * b
            out[at] = g / g.sum(1, keepdims=True)
            c = x[at] * b
            if t:
                entering = c @ a.T
                if t % NORMAL == 0:
                    entering /= entering.sum(1, keepdims=True)
                if pairs:
                    f = alpha[at - 1]
                    z = np.einsum("ni,ij,nj->n", f, a, c)
                    counts += np.einsum("ni,nj->ij", f / z[:, None], c) * a
        return out, counts


def fit(flat: np.ndarray, of_word: np.ndarray, words: int, sequences: list[tuple[np.ndarray, np.ndarray]], labels: int, buckets: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bucket by label), transition scores and begin scores by Adam on the mean log-likelihood. flat and
    of_word: buckets of all features and the word of each; sequences: word numbers and labels of each step, of
    SEGMENT steps at most."""
    used, flat = np.unique(flat, return_inverse=True)
    word, gold = np.concatenate([w for w, _ in sequences]), np.concatenate([y for _, y in sequences])
    lengths = np.array([len(w) for w, _ in sequences])
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(word), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    seen = np.bincount(gold[inner - 1] * labels + gold[inner], minlength=labels * labels).reshape(labels, labels)
    truth = np.zeros((len(word), labels))
    truth[np.arange(len(word)), gold] = 1
    parameters = [np.zeros((len(used), labels)), np.zeros((labels, labels)), np.zeros(labels)]
    m, v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        weights, move, begin = parameters
        scores = np.stack([np.bincount(of_word, weights[flat, k], words) for k in range(labels)], 1)
        p, pairs = Chains(scores[word], lengths, move, begin).marginals(pairs=True)
        off = (p - truth) / len(word)
        by_word = np.stack([np.bincount(word, off[:, k], words) for k in range(labels)], 1)
        g = np.stack([np.bincount(flat, by_word[of_word, k], len(used)) for k in range(labels)], 1) + decay * weights / len(word)
        for k, grad in enumerate((g, (pairs - seen) / len(word), off[first].sum(0))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad * grad
            parameters[k] = parameters[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros((buckets, labels), np.float32)
    weights[used] = parameters[0]
    return weights, parameters[1], parameters[2]
