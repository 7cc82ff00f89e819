"""Byte convolutional network for language identification: multi-width filters, max pooling and softmax, in numpy.

Texts become lower-case UTF-8 bytes in windows of fixed length. Training is on the driver over a bounded sample of
sentences; inference runs in batches wherever the rows are.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd

WINDOW = 96
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
EMBED = 8
_SPAN = max(WIDTHS)
#: Windows that are scored together. A run of bytes that occurs in several of them is convolved once.
CHUNK = 2048


def to_windows(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows (n x window, 0 is padding), the text of each window, and its share of bytes in use. Whole texts, cut into successive windows of about equal length."""
    rows, owner, used = [], [], []
    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "ignore")
        n = max(1, -(-len(raw) // window))
        step = -(-len(raw) // n) if raw else 1
        for k in range(n):
            part = raw[k * step : (k + 1) * step]
            rows.append(part.ljust(window, b"\0"))
            owner.append(i)
            used.append(len(part))
    data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, window) if rows else np.zeros((0, window), dtype=np.uint8)
    return data, np.array(owner, dtype=np.int64), np.array(used, dtype=np.int64)


class ByteCNN:
    """Parameters: embed (256 x EMBED), kernel (SPAN * EMBED x filters, zero beyond a filter's width), bias, out, out_bias."""

    def __init__(self, classes: list[str], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.classes = list(classes)
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((_SPAN, EMBED, n), dtype=np.float32)
        for j, w in enumerate(WIDTHS):
            self.mask[:w, :, j * FILTERS : (j + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(_SPAN * EMBED, n)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "kernel": (rng.normal(0, 0.25, (_SPAN * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, dtype=np.float32),
            "out": rng.normal(0, 0.1, (n, len(classes))).astype(np.float32),
            "out_bias": np.zeros(len(classes), dtype=np.float32),
        }
        self.p["embed"][0] = 0

    def _convolved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at each place (n x window x filters), and the padded bytes."""
        padded = np.concatenate([x, np.zeros((len(x), _SPAN - 1), dtype=np.uint8)], axis=1)
        e = self.p["embed"][padded]
        cols = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1)  # n, window, EMBED, SPAN
        cols = np.ascontiguousarray(cols.transpose(0, 1, 3, 2)).reshape(-1, _SPAN * EMBED)
        return (cols @ self.p["kernel"]).reshape(len(x), x.shape[1], -1), padded

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        conv, padded = self._convolved(x)
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0, :] + self.p["bias"]
        return np.maximum(top, 0), at, padded

    def _tables(self) -> list[np.ndarray]:
        """What each byte adds to the filter responses, by its place in the run. Filters stand by width; from place 2 on, those too narrow to reach it are left out."""
        kernel = self.p["kernel"].reshape(_SPAN, EMBED, -1)
        return [np.ascontiguousarray((self.p["embed"] @ kernel[k])[:, sum(FILTERS for w in WIDTHS if w <= k) :]) for k in range(_SPAN)]

    def _responses(self, x: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses of each distinct run of SPAN bytes (runs x filters), and the run at each place (n x window).

        Language uses few runs of bytes over and over: each is convolved once, by looking up what its bytes add, and places refer to it.
        """
        n, width = x.shape
        padded = np.concatenate([x, np.zeros((n, _SPAN - 1), dtype=np.uint8)], axis=1).astype(np.uint64)
        code = padded[:, :width].copy()
        for k in range(1, _SPAN):
            code |= padded[:, k : width + k] << np.uint64(8 * k)
        at, runs = pd.factorize(code.ravel())
        grams = np.ascontiguousarray(np.asarray(runs, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :_SPAN].T).astype(np.intp)
        r = np.take(tables[0], grams[0], axis=0)
        for t, byte in zip(tables[1:], grams[1:], strict=True):
            r[:, r.shape[1] - t.shape[1] :] += np.take(t, byte, axis=0)
        return r, at.reshape(n, width)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of each window; chunks bound the memory."""
        out = np.zeros((len(x), len(self.classes)), dtype=np.float32)
        tables = self._tables()
        for i in range(0, len(x), CHUNK):
            r, at = self._responses(x[i : i + CHUNK], tables)
            top = np.take(r, at[:, 0], axis=0)
            here = np.empty_like(top)
            for j in range(1, x.shape[1]):
                np.take(r, at[:, j], axis=0, out=here, mode="clip")
                np.maximum(top, here, out=top)
            z = np.maximum(top + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
            z -= z.max(axis=1, keepdims=True)
            out[i : i + CHUNK] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Sum of the window log probabilities of each text, windows weighted by their bytes in use."""
        x, owner, used = to_windows(texts)
        order = np.argsort(used, kind="stable")
        lp = np.zeros((len(x), len(self.classes)), dtype=np.float32)
        for i in range(0, len(order), CHUNK):
            # short windows are computed with short ones: what lies behind all of them is padding
            part = order[i : i + CHUNK]
            width = min(WINDOW, max(8, int(used[part].max(initial=1))))
            lp[part] = self.log_probs(x[part, :width])
        total = np.zeros((len(texts), len(self.classes)))
        np.add.at(total, owner, lp * np.maximum(0.1, np.minimum(1.0, used / 24.0))[:, None])
        return total

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, seed: int = 0, batch: int = 64) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, epochs * max(1, -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                g = self._gradient(x[part], y[part])
                t += 1
                lr = rate * (1 - t / (steps + 1)) + 1e-4
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.99 * s[k] + 0.01 * d * d
                    self.p[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
                self.p["kernel"] *= self.mask
                self.p["embed"][0] = 0

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, at, padded = self._pooled(x)
        z = h @ self.p["out"] + self.p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        dh = (q @ self.p["out"].T) * (h > 0)
        # max pooling: each filter learns from one place per window
        n, f = dh.shape
        spots = at[:, :, None] + np.arange(_SPAN)[None, None, :]
        codes = padded[np.arange(n)[:, None, None], spots]  # n, f, SPAN
        seen = self.p["embed"][codes].reshape(n, f, _SPAN * EMBED)
        d_kernel = np.einsum("nf,nfk->kf", dh, seen, optimize=True) * self.mask
        d_seen = dh[:, :, None] * self.p["kernel"].T[None, :, :]
        cells = codes.reshape(-1, 1).astype(np.int64) * EMBED + np.arange(EMBED)
        d_embed = np.bincount(cells.ravel(), weights=d_seen.ravel(), minlength=256 * EMBED).reshape(256, EMBED).astype(np.float32)
        return {"embed": d_embed, "kernel": d_kernel.astype(np.float32), "bias": dh.sum(axis=0), "out": h.T @ q, "out_bias": q.sum(axis=0)}


def spoil(text: str, rng: np.random.Generator) -> str:
    """A copy as exports and scanners leave it: accents lost, letters read as digits, start or end cut off."""
    kind = rng.integers(0, 4)
    if kind == 0:
        return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    if kind == 1:
        return text.translate(str.maketrans("oliesOLIES", "0113501135"))
    a, b = sorted(rng.integers(0, len(text) + 1, 2))
    return text[a:b] if b - a >= 20 else text
