"""A linear-chain conditional random field in numpy.

Training minimises the L2-regularised negative log-likelihood of a small
labelled table by full-batch Adam with forward-backward expectations; decoding
runs Viterbi over many sequences at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # from x to
    start: np.ndarray

    def rows(self, features: list[str]) -> np.ndarray:
        """Summed weights of the known features, one value per label."""
        at = [self.index[f] for f in features if f in self.index]
        return self.weights[at].sum(0) if at else np.zeros(len(self.labels))


def marginals(e: np.ndarray, lens: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each label of each token, expected count of each move) by forward-backward in scaled probabilities.

    ``e``: sequences x tokens x labels, of which the first ``lens`` tokens count; every sequence has one at least.
    """
    n, size, k = e.shape
    mask = np.arange(size)[None, :] < lens[:, None]
    x, m = np.exp(e - e.max(-1, keepdims=True)), np.exp(moves)
    alpha, beta, scale = np.empty_like(x), np.ones_like(x), np.ones((n, size))
    for t in range(size):
        now = (alpha[:, t - 1] @ m if t else np.exp(start - start.max())[None]) * x[:, t]
        scale[:, t] = now.sum(1)
        alpha[:, t] = now / scale[:, t, None]
    for t in range(size - 2, -1, -1):
        back = (x[:, t + 1] * beta[:, t + 1]) @ m.T / scale[:, t + 1, None]
        beta[:, t] = np.where(mask[:, t + 1, None], back, 1)
    p = alpha * beta * mask[:, :, None]
    after = x[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * mask[:, 1:, None]
    return p, alpha[:, :-1].reshape(-1, k).T @ after.reshape(-1, k) * m


def train(sequences: list[tuple[list[list[str]], list[str]]], labels: list[str], steps: int = 120, l2: float = 0.02, rate: float = 0.15, forbidden: tuple[tuple[str, str], ...] = ()) -> Crf:
    """Fit on (features of each token, label of each token) sequences; ``forbidden`` moves get a very low weight."""
    sequences = [s for s in sequences if s[0]]
    index: dict[str, int] = {}
    for feats, _ in sequences:
        for token in feats:
            for f in token:
                index.setdefault(f, len(index))
    where = {x: i for i, x in enumerate(labels)}
    n, size, k = len(sequences), max((len(s[0]) for s in sequences), default=0), len(labels)
    lens = np.array([len(s[0]) for s in sequences], int)
    mask = np.arange(size)[None, :] < lens[:, None]
    gold = np.zeros((n, size), int)
    flat, owner = [], []
    for i, (feats, tags) in enumerate(sequences):
        gold[i, : len(tags)] = [where[t] for t in tags]
        for t, token in enumerate(feats):
            flat += [index[f] for f in token]
            owner += [i * size + t] * len(token)
    flat, owner = np.array(flat, int), np.array(owner, int)
    w, a, s = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    block = np.zeros((k, k))
    for x, y in forbidden:
        block[where[x], where[y]] = -30.0
    tokens = np.nonzero(mask)
    counted = np.zeros((k, k))
    np.add.at(counted, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a, s)]
    order = np.argsort(flat, kind="stable")
    heads = np.searchsorted(flat[order], np.arange(len(index)))
    for step in range(1, steps + 1):
        e = np.stack([np.bincount(owner, w[flat, j], n * size) for j in range(k)], -1).reshape(n, size, k)
        diff, ga = marginals(e, lens, a + block, s) if n else (np.zeros((0, 0, k)), np.zeros((k, k)))
        diff[(*tokens, gold[tokens])] -= 1
        ga -= counted
        d = diff.reshape(-1, k)[owner[order]]
        gw = np.add.reduceat(d, heads, 0) if len(d) else np.zeros_like(w)
        gs = diff[:, :1].sum((0, 1))
        for p_, g, mom in zip((w, a, s), (gw, ga, gs), moments):
            g = g / max(1, n) + l2 * p_ / max(1, n)
            mom[0] = 0.9 * mom[0] + 0.1 * g
            mom[1] = 0.99 * mom[1] + 0.01 * g * g
            p_ -= rate * (mom[0] / (1 - 0.9**step)) / (np.sqrt(mom[1] / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, index, w, a + block, s)


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best label of each token. ``emissions``: all sequences end to end, tokens x labels."""
    n, k = emissions.shape
    out = np.zeros(n, np.int8)
    lengths = np.asarray(lengths, int)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    first, lengths = first[order], lengths[order]
    back = np.zeros((n, k), np.int8)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences with more than t tokens
    score = (emissions[first] + start).astype(np.float32)
    moves = moves.astype(np.float32)
    for t in range(1, lengths[0]):
        m = alive[t]
        at = first[:m] + t
        paths = score[:m, :, None] + moves
        best = paths.argmax(1)
        back[at] = best
        score[:m] = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + emissions[at]
    tag = score.argmax(1).astype(np.int8)
    for t in range(lengths[0] - 1, -1, -1):
        m = alive[t]
        at = first[:m] + t
        out[at] = tag[:m]
        if t:
            tag[:m] = back[at, tag[:m]]
    return out
