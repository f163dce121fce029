"""The little that two numpy classifiers share: Adam, max pooling over convolutions, softmax."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0) -> None:
        self.params, self.rate, self.decay, self.step = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            size = np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step) / size + self.decay * self.params[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class PooledConvolutions:
    """Embedded symbols, filters of several widths, the maximum of each over all places, a dense layer.

    ``ids`` is (batch, places), or (batch, places, parts) where the embedding of a place is the sum of its
    parts'; symbol 0 pads, and its embedding is held at zero. Parameters are plain
    arrays, so a model is a dict that can be sent to the executors.
    """

    def __init__(self, symbols: int, dim: int, widths: tuple[int, ...], filters: int, classes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.widths = widths
        f = np.float32
        self.p = {"E": rng.normal(0, 0.3, (symbols, dim)).astype(f)}
        self.p["E"][0] = 0
        for w in widths:
            self.p[f"W{w}"] = rng.normal(0, (2 / (w * dim)) ** 0.5, (w * dim, filters)).astype(f)
            self.p[f"b{w}"] = np.zeros(filters, f)
        self.p["V"] = rng.normal(0, 0.3, (filters * len(widths), classes)).astype(f)
        self.p["c"] = np.zeros(classes, f)

    def _columns(self, ids: np.ndarray, w: int) -> np.ndarray:
        x = self.p["E"][ids] if ids.ndim == 2 else self.p["E"][ids].sum(axis=2)
        n, places, dim = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, places - w + 1, w * dim), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        pooled, kept = [], []
        for w in self.widths:
            cols = self._columns(ids, w)
            z = cols @ self.p[f"W{w}"] + self.p[f"b{w}"]
            at = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
            kept.append((cols, at))
        h = np.maximum(np.concatenate(pooled, 1), 0)
        return h @ self.p["V"] + self.p["c"], [h, kept]

    def gradients(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, dict]:
        logits, (h, kept) = self.forward(ids)
        p = softmax(logits)
        n = len(ids)
        each = np.ones(n, np.float32) if weights is None else weights
        loss = float(-(each * np.log(p[np.arange(n), labels] + 1e-9)).mean())
        d = p.copy()
        d[np.arange(n), labels] -= 1
        d *= (each / n)[:, None]
        g = {"V": h.T @ d, "c": d.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = (d @ self.p["V"].T) * (h > 0)
        dim = self.p["E"].shape[1]
        for k, (w, (cols, at)) in enumerate(zip(self.widths, kept, strict=True)):
            f = at.shape[1]
            part = dh[:, k * f : (k + 1) * f]
            best = cols[np.arange(n)[:, None], at]
            g[f"W{w}"] = np.einsum("bfk,bf->kf", best, part, optimize=True)
            g[f"b{w}"] = part.sum(0)
            symbols = ids[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            dx = (self.p[f"W{w}"].T[None] * part[:, :, None]).reshape(n, f, w, dim)
            if ids.ndim == 2:
                np.add.at(g["E"], symbols.reshape(-1), dx.reshape(-1, dim))
            else:
                for part_ids in np.moveaxis(symbols, -1, 0):
                    np.add.at(g["E"], part_ids.reshape(-1), dx.reshape(-1, dim))
        g["E"][0] = 0
        return loss, g
