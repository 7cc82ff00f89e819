"""Linear-chain conditional random field over dense feature vectors, vectorised over many sequences."""

from __future__ import annotations

import numpy as np


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _distinct(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequences without repetitions, and how often each occurs."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    first: dict[bytes, int] = {}
    often: list[int] = []
    kept: list[int] = []
    for i, (a, t) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        key = x[a : a + t].tobytes() + y[a : a + t].tobytes()
        at = first.setdefault(key, len(kept))
        if at == len(kept):
            kept.append(i)
            often.append(0)
        often[at] += 1
    rows = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in kept]) if kept else np.zeros(0, dtype=np.int64)
    return x[rows], y[rows], lengths[kept], np.array(often, dtype=float)


class CRF:
    def __init__(self, tags: list[str], n_features: int) -> None:
        self.tags = list(tags)
        k = len(tags)
        self.w = np.zeros((n_features, k))
        self.move = np.zeros((k, k))
        self.begin = np.zeros(k)
        self.end = np.zeros(k)

    def _pad(self, lengths: np.ndarray) -> np.ndarray:
        """Index of each (sequence, position) among all clauses laid end to end; -1 is padding."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        t = np.arange(lengths.max(initial=1))
        return np.where(t[None, :] < lengths[:, None], starts[:, None] + t[None, :], -1)

    def _pass(self, u: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores, and the log partition of each sequence."""
        n, t = at.shape
        k = len(self.tags)
        e = np.where((at >= 0)[:, :, None], u[at], 0.0)
        alpha = np.zeros((n, t, k))
        beta = np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + self.begin
        for i in range(1, t):
            alpha[:, i] = np.where((at[:, i] >= 0)[:, None], e[:, i] + _logsumexp(alpha[:, i - 1][:, :, None] + self.move[None], 1), alpha[:, i - 1])
        last = lengths - 1
        beta[np.arange(n), last] = self.end
        for i in range(t - 2, -1, -1):
            inner = _logsumexp(self.move[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where((i < last)[:, None], inner, beta[:, i])
        z = _logsumexp(alpha[np.arange(n), last] + self.end, 1)
        return alpha, beta, z

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each tag at each clause. Sequences are taken by length, so that a long one doesn't pad the others."""
        out = np.zeros((len(x), len(self.tags)))
        if not len(x):
            return out
        u = x @ self.w
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * lengths[order[j]] <= max(4096, lengths[order[i]]):
                j += 1
            some = order[i:j]
            own = lengths[some]
            rows = np.concatenate([np.arange(starts[s], starts[s] + lengths[s]) for s in some])
            at = self._pad(own)
            alpha, beta, z = self._pass(u[rows], at, own)
            p = np.exp(alpha + beta - z[:, None, None])
            out[rows[at[at >= 0]]] = p[at >= 0]
            i = j
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int = 450, rate: float = 0.1, l2: float = 1e-4) -> None:
        """Maximum likelihood with a quadratic penalty, full gradient, Adam. Sequences of one length are taken together: no padding. Sequences with the same features and tags are computed once and count as often as they occur."""
        k, n = len(self.tags), len(lengths)
        x, y, lengths, often = _distinct(x, y, lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        groups = [(np.full(int((lengths == t).sum()), t), starts[lengths == t][:, None] + np.arange(t)[None, :], often[lengths == t]) for t in np.unique(lengths).tolist()]
        per_clause = np.repeat(often, lengths)[:, None]
        gold = np.zeros((len(x), k))
        gold[np.arange(len(x)), y] = 1
        gold_move = np.zeros((k, k))
        for _, at, many in groups:
            np.add.at(gold_move, (y[at[:, :-1]].ravel(), y[at[:, 1:]].ravel()), np.repeat(many, at.shape[1] - 1))
        gold_begin = np.bincount(y[starts], weights=often, minlength=k)
        gold_end = np.bincount(y[starts + lengths - 1], weights=often, minlength=k)
        names = ("w", "move", "begin", "end")
        m = {a: np.zeros_like(getattr(self, a)) for a in names}
        s = {a: np.zeros_like(getattr(self, a)) for a in names}
        for step in range(1, steps + 1):
            u = x @ self.w
            p = np.zeros((len(x), k))
            moves = np.zeros((k, k))
            for own, at, many in groups:
                alpha, beta, z = self._pass(u, at, own)
                p[at] = np.exp(alpha + beta - z[:, None, None])
                if at.shape[1] > 1:
                    pair = alpha[:, :-1, :, None] + self.move + (u[at[:, 1:]] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
                    moves += (np.exp(pair) * many[:, None, None, None]).sum(axis=(0, 1))
            g = {
                "w": x.T @ ((p - gold) * per_clause) / n + l2 * self.w,
                "move": (moves - gold_move) / n + l2 * self.move,
                "begin": ((p[starts] * often[:, None]).sum(axis=0) - gold_begin) / n + l2 * self.begin,
                "end": ((p[starts + lengths - 1] * often[:, None]).sum(axis=0) - gold_end) / n + l2 * self.end,
            }
            for a in names:
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                s[a] = 0.99 * s[a] + 0.01 * g[a] ** 2
                setattr(self, a, getattr(self, a) - rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(s[a] / (1 - 0.99**step)) + 1e-8))
