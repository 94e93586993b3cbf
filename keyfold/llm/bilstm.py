"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Everything is in double precision, the rate is low and falls, and trained weights are
rounded to a coarse grid, so that machines whose kernels add up in another order
end in the same model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

HIDDEN = 16
#: Adam's rate at the start; it falls to a hundredth of it.
RATE = 0.1
#: Trained weights are multiples of this.
GRID = 1 / 256
ILLEGAL = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Tags of windows of character classes. Windows have one length; a batch
    is (windows, length). ``allowed``: which tag may follow which."""

    def __init__(self, n_classes: int, allowed: np.ndarray, hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        n_tags, h = len(allowed), hidden
        self.hidden, self.allowed = h, allowed

        def start(*shape: int) -> np.ndarray:
            return rng.standard_normal(shape) * 0.3 / np.sqrt(max(1, shape[0] / 4))
        # forwards and backwards side by side; the input weights are one row a class:
        # the gates' input, forget, output and cell parts
        self.p = {"e": np.stack([start(n_classes, 4 * h) for _ in range(2)]), "u": np.stack([start(h, 4 * h) for _ in range(2)]),
                  "o": start(2 * h, n_tags), "b": np.zeros(n_tags),
                  "t": np.where(allowed, 0.0, -2.0)}
        self.p["e"][:, :, h:2 * h] += 1.0

    def _run(self, x: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (length, windows, 2 * hidden) of both directions."""
        n, length = x.shape
        u, k = self.p["u"], self.hidden
        h, c = np.zeros((2, n, k)), np.zeros((2, n, k))
        out = np.empty((length, n, 2 * k))
        first, second = self.p["e"][0][x.T], self.p["e"][1][x.T[::-1]]
        for t in range(length):
            z = h @ u
            z[0] += first[t]
            z[1] += second[t]
            gates = _sigmoid(z[:, :, :3 * k])
            g = np.tanh(z[:, :, 3 * k:])
            before, c = c, gates[:, :, k:2 * k] * c + gates[:, :, :k] * g
            th = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gates, g, th))
            h = gates[:, :, 2 * k:] * th
            out[t, :, :k], out[length - 1 - t, :, k:] = h
        return out

    def _back(self, x: np.ndarray, kept: list, grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
        u, k = self.p["u"], self.hidden
        length = x.shape[1]
        back = u.transpose(0, 2, 1)
        dh, dc = np.zeros((2, len(x), k)), np.zeros((2, len(x), k))
        dz = np.empty((length, 2, len(x), 4 * k))
        for t in range(length - 1, -1, -1):
            h, before, gates, g, th = kept[t]
            i, f, o = gates[:, :, :k], gates[:, :, k:2 * k], gates[:, :, 2 * k:]
            dh[0] += grad[t, :, :k]
            dh[1] += grad[length - 1 - t, :, k:]
            dc = dc + dh * o * (1 - th * th)
            z = dz[t]
            z[:, :, :k], z[:, :, k:2 * k], z[:, :, 2 * k:3 * k], z[:, :, 3 * k:] = dc * g, dc * before, dh * th, dc * i
            z[:, :, :3 * k] *= gates * (1 - gates)
            z[:, :, 3 * k:] *= 1 - g * g
            out["u"] += h.transpose(0, 2, 1) @ z
            dh, dc = z @ back, dc * f
        for d, order in enumerate((x.T, x.T[::-1])):
            np.add.at(out["e"][d], order.ravel(), dz[:, d].reshape(-1, 4 * k))

    def emissions(self, x: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tag scores (length, windows, tags) and the hidden states under them."""
        both = self._run(x, keep)
        return both @ self.p["o"] + self.p["b"], both

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        n, length = x.shape
        keep: list = []
        s, both = self.emissions(x, keep)
        trans = self.p["t"]
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for t in range(1, length):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + s[t]
        for t in range(length - 2, -1, -1):
            beta[t] = _lse(trans[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        g = y.T
        gold = np.take_along_axis(s, g[:, :, None], 2)[:, :, 0].sum(0) + trans[g[:-1], g[1:]].sum(0)
        ds = np.exp(alpha + beta - z[None, :, None])
        np.put_along_axis(ds, g[:, :, None], np.take_along_axis(ds, g[:, :, None], 2) - 1, 2)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        pair = np.exp(alpha[:-1, :, :, None] + trans + (s[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
        grads["t"] += pair.sum((0, 1))
        np.add.at(grads["t"], (g[:-1].ravel(), g[1:].ravel()), -1)
        ds /= n
        grads["t"] /= n
        grads["o"] = np.tensordot(both, ds, axes=([0, 1], [0, 1]))
        grads["b"] = ds.sum((0, 1))
        self._back(x, keep, ds @ self.p["o"].T, grads)
        return float((z - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 100, seed: int = 2,
              score: Callable[[], float] | None = None) -> list[float]:
        """Adam over shuffled batches; the loss of each epoch. With ``score``
        the weights of the epoch that scores best are kept (of equals the last)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        step, losses = 0, []
        total = epochs * max(1, -(-len(x) // batch))
        best, kept = -np.inf, self.p
        for _ in range(epochs):
            order, seen = rng.permutation(len(x)), []
            for a in range(0, len(x), batch):
                step += 1
                value, grads = self.loss(x[order[a:a + batch]], y[order[a:a + batch]])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                rate = RATE * min(1.0, 5.0 / (norm + 1e-9)) * (0.01 + 0.99 * 0.5 * (1 + np.cos(np.pi * step / total)))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-4)
                seen.append(value)
            losses.append(float(np.mean(seen)))
            if score is not None:
                raw = self.p
                self.p = {k: np.round(w / GRID) * GRID for k, w in raw.items()}
                got = score()
                if got >= best:
                    best, kept = got, self.p
                self.p = raw
        self.p = kept if score is not None else {k: np.round(w / GRID) * GRID for k, w in self.p.items()}
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (windows, length) and how far each one's score is above tag 0's."""
        n, length = x.shape
        s, _ = self.emissions(x)
        trans = np.where(self.allowed, self.p["t"], ILLEGAL)
        best, back = s[0], np.empty((length, n, s.shape[2]), np.int8)
        for t in range(1, length):
            paths = best[:, :, None] + trans[None]
            back[t] = paths.argmax(1)
            best = paths.max(1) + s[t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        margin = np.take_along_axis(s, tags.T[:, :, None].astype(np.int64), 2)[:, :, 0] - s[:, :, 0]
        return tags, margin.T
