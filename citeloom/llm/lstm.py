"""A bidirectional LSTM sequence labeller in numpy: embedded inputs, training by Adam, batched inference.

A step of a sequence is described by a bag of hashed words, the elements that open or close at it (their
running sum is the tag path) and a vector of flags.  Words and path elements have trained embeddings.
Sequences of any length are read whole, so every label sees the whole document in both directions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Steps:
    """One sequence: flags (steps x flags); words with the step they belong to; path changes with step and sign."""

    flags: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    path_sign: np.ndarray

    def __len__(self) -> int:
        return len(self.flags)


class Batch:
    """Sequences laid side by side, padded to the longest: time x sequences, cells numbered time-major."""

    def __init__(self, steps: list[Steps]):
        self.b, self.t = len(steps), max(map(len, steps))
        self.mask = np.zeros((self.t, self.b, 1), dtype=np.float32)
        self.flags = np.zeros((self.t, self.b, steps[0].flags.shape[1]), dtype=np.float32)
        for k, s in enumerate(steps):
            self.mask[: len(s), k] = 1
            self.flags[: len(s), k] = s.flags
        flat = lambda name, at: (np.concatenate([getattr(s, name) for s in steps]), np.concatenate([getattr(s, at) * self.b + k for k, s in enumerate(steps)]))
        self.words, self.word_cell = flat("words", "word_at")
        self.path, self.path_cell = flat("path", "path_at")
        self.path_sign = np.concatenate([s.path_sign for s in steps]).astype(np.float32)
        self.word_share = (1.0 / np.maximum(np.bincount(self.word_cell, minlength=self.t * self.b), 1)[self.word_cell]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _add(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` per target row."""
    out = np.zeros((rows, values.shape[1]), dtype=np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        target = at[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        out[target[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class BiLSTM:
    """Parameters: e (words), p (path elements); f, b (either direction: input + hidden + 1 x 4H); v (2H + 1 x labels)."""

    def __init__(self, n_words: int, n_paths: int, n_flags: int, n_labels: int, n_hidden: int, sizes: tuple[int, int] = (24, 12), seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n_hidden = n_hidden
        n_in = sizes[0] + sizes[1] + n_flags
        self.p = {"e": rng.normal(0, 0.3, (n_words, sizes[0])), "p": rng.normal(0, 0.3, (n_paths, sizes[1])), "v": rng.normal(0, 0.1, (2 * n_hidden + 1, n_labels))}
        for d in "fb":
            self.p[d] = rng.normal(0, 1.0 / np.sqrt(n_in + n_hidden), (n_in + n_hidden + 1, 4 * n_hidden))
            self.p[d][-1, n_hidden : 2 * n_hidden] = 1.0  # forget gates start open
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    @classmethod
    def of(cls, weights: dict[str, np.ndarray]) -> BiLSTM:
        """The labeller with given weights."""
        self = cls.__new__(cls)
        self.p = {k: np.asarray(x, dtype=np.float32) for k, x in weights.items()}
        self.n_hidden = (len(self.p["v"]) - 1) // 2
        return self

    def _inputs(self, batch: Batch) -> np.ndarray:
        cells = batch.t * batch.b
        words = _add(cells, batch.word_cell, self.p["e"][batch.words] * batch.word_share[:, None])
        turns = _add(cells, batch.path_cell, self.p["p"][batch.path] * batch.path_sign[:, None])
        path = np.tanh(np.cumsum(turns.reshape(batch.t, batch.b, -1), axis=0))
        return np.concatenate([words.reshape(batch.t, batch.b, -1), path, batch.flags], axis=2)

    def _run(self, w: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: T x B x D in reading order; mask: T x B x 1, 0 on padding, where the state stays."""
        t, b, d = x.shape
        n = self.n_hidden
        drive = (x.reshape(t * b, d) @ w[:d] + w[-1]).reshape(t, b, 4 * n)
        wh = w[d : d + n]
        h = c = np.zeros((b, n), dtype=np.float32)
        out = np.empty((t, b, n), dtype=np.float32)
        cache = []
        for s in range(t):
            a = drive[s] + h @ wh
            gates = _sigmoid(a[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(a[:, 3 * n :])
            c1 = f * c + i * g
            tc = np.tanh(c1)
            m = mask[s]
            if keep:
                cache.append((i, f, o, g, c, tc, h))
            c = m * c1 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[s] = h
        return out, cache

    def forward(self, batch: Batch, keep: bool = False):
        x = self._inputs(batch)
        hf, cf = self._run(self.p["f"], x, batch.mask, keep)
        hb, cb = self._run(self.p["b"], x[::-1], batch.mask[::-1], keep)
        z = np.concatenate([hf, hb[::-1], np.ones((batch.t, batch.b, 1), dtype=np.float32)], axis=2)
        return z @ self.p["v"], z, cf, cb, x

    def _back(self, w, x, mask, cache, dout):
        """Gradients of the weights and of the inputs of one direction."""
        t, b, d = x.shape
        n = self.n_hidden
        da_all = np.empty((t, b, 4 * n), dtype=np.float32)
        dh = np.zeros((b, n), dtype=np.float32)
        dc = np.zeros((b, n), dtype=np.float32)
        wh = w[d : d + n]
        dw = np.zeros_like(w)
        for s in range(t - 1, -1, -1):
            i, f, o, g, c0, tc, h0 = cache[s]
            m = mask[s]
            dh_all = dout[s] + dh
            dh1, dc_in = m * dh_all, m * dc
            dct = dc_in + dh1 * o * (1 - tc * tc)
            da = np.concatenate(
                [dct * g * i * (1 - i), dct * c0 * f * (1 - f), dh1 * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1
            )
            da_all[s] = da
            dw[d : d + n] += h0.T @ da
            dh = da @ wh.T + (1 - m) * dh_all
            dc = dct * f + (1 - m) * dc
        flat = da_all.reshape(t * b, 4 * n)
        dw[:d] = x.reshape(t * b, d).T @ flat
        dw[-1] = flat.sum(0)
        return dw, (flat @ w[:d].T).reshape(t, b, d)

    def gradient(self, batch: Batch, y: np.ndarray) -> tuple[dict[str, np.ndarray], float, float]:
        """Gradients of the mean log loss, the loss, and the share of right labels."""
        z, feats, cf, cb, x = self.forward(batch, keep=True)
        z = z - z.max(axis=2, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=2, keepdims=True)
        total = batch.mask.sum()
        right = float(((prob.argmax(2) == y) * batch.mask[:, :, 0]).sum() / total)
        mine = np.take_along_axis(prob, y[:, :, None], 2)
        loss = float(-(np.log(mine + 1e-12) * batch.mask).sum() / total)
        np.put_along_axis(prob, y[:, :, None], mine - 1, 2)
        dz = prob * batch.mask / total
        cells = batch.t * batch.b
        grad = {"v": feats.reshape(cells, -1).T @ dz.reshape(cells, -1)}
        dfeat = dz @ self.p["v"].T
        n = self.n_hidden
        grad["f"], dx = self._back(self.p["f"], x, batch.mask, cf, dfeat[:, :, :n])
        grad["b"], dxb = self._back(self.p["b"], x[::-1], batch.mask[::-1], cb, dfeat[::-1, :, n : 2 * n])
        dx = dx + dxb[::-1]
        ne, np_ = self.p["e"].shape[1], self.p["p"].shape[1]
        dwords = dx[:, :, :ne].reshape(cells, ne)
        grad["e"] = _add(len(self.p["e"]), batch.words, dwords[batch.word_cell] * batch.word_share[:, None])
        path = x[:, :, ne : ne + np_]
        dturn = np.cumsum((dx[:, :, ne : ne + np_] * (1 - path * path))[::-1], axis=0)[::-1].reshape(cells, np_)
        grad["p"] = _add(len(self.p["p"]), batch.path, dturn[batch.path_cell] * batch.path_sign[:, None])
        return grad, loss, right

    def train(self, batches, steps: int, rate: float = 0.008) -> float:
        """``batches`` yields (batch, labels), ``steps`` of them; the rate falls to a twentieth.  Returns the
        share of right labels over the last tenth."""
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        shares = []
        for step, (batch, y) in enumerate(batches, 1):
            grad, _, right = self.gradient(batch, y)
            shares.append(right)
            now = rate * max(0.05, 1 - step / max(1, steps))
            for k, g in grad.items():
                g = np.clip(g, -0.5, 0.5)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return float(np.mean(shares[-max(1, len(shares) // 10) :]))

    def label(self, sequences: list[Steps], cells: int = 60_000) -> list[np.ndarray]:
        """Labels of each sequence; batches hold about ``cells`` steps of like length."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(sequences[order[end]]) <= cells:
                end += 1
            part = order[at:end]
            z = self.forward(Batch([sequences[i] for i in part]))[0].argmax(2)
            for b, i in enumerate(part):
                out[i] = z[: len(sequences[i]), b]
            at = end
        return out
